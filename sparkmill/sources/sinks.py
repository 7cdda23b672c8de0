"""Sinks: Spark's committers make each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def ordered(df: DataFrame, declared: list[str]) -> DataFrame:
    """The declared columns first, missing ones null, then the others as they come; columns that start with an underscore go."""
    extra = [c for c in df.columns if c not in declared and not c.startswith("_")]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in declared], *extra)


def predictions_csv(df: DataFrame, path: str, declared: list[str]) -> None:
    """A header is written for an empty table too."""
    rows = ordered(df, declared)
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def judged(df: DataFrame) -> DataFrame:
    """The struct judge_scores as columns of its own, and whether it was parsed."""
    return df.select(*[c for c in df.columns if c != "judge_scores"], "judge_scores.*", F.col("judge_scores").isNotNull().alias("judge_parse_ok"))


def batch(df: DataFrame, path: str, number: int) -> None:
    """A batch is a partition of the table: writing one again replaces it and leaves the others."""
    df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def vectors(df: DataFrame, path: str, id_col: str, vector_col: str) -> int:
    """Write an index as Parquet; all vectors must have one length. Returns the number of vectors."""
    state = df.agg(F.count("*").alias("n"), F.min(F.size(vector_col)).alias("low"), F.max(F.size(vector_col)).alias("high"), F.count_if(F.col(vector_col).isNull()).alias("missing")).first()
    if state.missing or state.low != state.high:
        raise ValueError(f"vectors of {state.low} to {state.high} components, {state.missing} missing")
    df.select(id_col, vector_col).write.mode("overwrite").parquet(path)
    return state.n
