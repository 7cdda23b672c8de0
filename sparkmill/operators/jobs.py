"""Keyed batch jobs: what is pending, what was scored before, which row of a key stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(work: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    return work.join(scored.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def covered(work: DataFrame, scored: DataFrame, strict: str, relaxed: str, strict_only: bool = False) -> DataFrame:
    """work with match: strict, relaxed or none."""
    s = scored.select(strict).distinct().withColumn("_s", F.lit(1))
    r = scored.select(relaxed).distinct().withColumn("_r", F.lit(1))
    rows = work.join(s, strict, "left").join(r, relaxed, "left")
    match = F.when(F.col("_s") == 1, "strict").when((F.col("_r") == 1) & F.lit(not strict_only), "relaxed").otherwise("none")
    return rows.withColumn("match", match).drop("_s", "_r")


def keep_last(rows: DataFrame, key: list[str], order: list[str], last: bool = True) -> DataFrame:
    """One row a key, the last in order (or the first): an aggregation, so repeated keys shrink before the shuffle."""
    pick = F.max_by if last else F.min_by
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(pick(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in others])


def combined(*tables: DataFrame) -> DataFrame:
    """All rows under the union of the columns; text that a table lacks is empty."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.fillna("", [c for c, t in rows.dtypes if t == "string"])


def first_incomplete(rows: DataFrame, batch: str, done: str, floor: int = 0) -> DataFrame:
    """The smallest batch, at or after floor, with a row that isn't done."""
    return rows.groupBy(batch).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("complete")).where(~F.col("complete") & (F.col(batch) >= floor)).agg(F.min(batch).alias("next_batch"))


def stratified(rows: DataFrame, stratum: str, total: int, order: list) -> DataFrame:
    """An equal share of each stratum, the rest to the first strata; what small strata leave is topped up in the same order."""
    strata = rows.groupBy(stratum).agg(F.count("*").alias("_have"))
    k, n = F.row_number().over(Window.orderBy(stratum)) - 1, F.count("*").over(Window.partitionBy())
    quota = strata.withColumn("_quota", (F.floor(F.lit(total) / n) + (k < F.lit(total) % n).cast("int")).cast("long"))
    marked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).join(quota, stratum).withColumn("_in", F.col("_k") <= F.col("_quota"))
    # a stratum can give the top-up no more than its next `total` rows
    likely = marked.where(F.col("_k") <= F.col("_quota") + total)
    ordered = likely.withColumn("_at", F.row_number().over(Window.orderBy(F.desc("_in"), *order)))
    return ordered.where(F.col("_at") <= total).select(*rows.columns, F.col("_in").alias("in_quota"))
