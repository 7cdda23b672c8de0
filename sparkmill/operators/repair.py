"""Keyed repair of a partitioned table: only partitions with a row that really changes are written again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_rows(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of stored whose key changes has, under other values; null equals null."""
    values = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in values])
    return stored.join(new, key).where(differs)


def repair(spark: SparkSession, path: str, changes: DataFrame, key: list[str], partition: list[str]) -> int:
    """Give the rows of the table at path the values that changes has for their key; returns how many partitions were written.

    changes: key and the columns to set, one row a key; a null value is set as null. A repeated key in changes is an error, as is one of its columns that the table lacks. Keys that the
    table lacks are left out. The partitions to write are those of rows whose values differ, found by a join on
    the key and no more than the table has; they alone are read again, and replace themselves by dynamic overwrite, while the files of all others
    keep their names. A repair that fails before its commit leaves the table as it was, and one that is run twice writes nothing the second time.
    """
    stored = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in key]
    if set(changes.columns) - set(stored.columns) or set(partition) & set(values):
        raise ValueError("changes may have the table's columns other than its partitions only")
    if not changes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a key is repeated in the changes")
    touched = changed_rows(stored, changes, key).select(*partition).distinct().collect()  # partitions, not rows
    if not touched:
        return 0
    new = changes.select(*key, F.struct(*values).alias("_new"), F.lit(True).alias("_set"))
    here = F.lit(False)
    for row in touched:
        here = here | reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in partition])
    rows = stored.where(here).join(new, key, "left")
    fixed = rows.select(*[F.when(F.col("_set"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns])
    fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    return len(touched)
