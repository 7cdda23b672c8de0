"""Scans with declared schemas, and missing values made null where they enter."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkmill.sources.shared import written


def missing_as_null(df: DataFrame) -> DataFrame:
    """Blank text and NaN become null: inside the engine there is one missing value."""
    for c, t in df.dtypes:
        if t == "string":
            df = df.withColumn(c, F.when(F.trim(c) != "", F.col(c)))
        elif t in ("double", "float"):
            df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


def jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_rows(spark: SparkSession, path: str, rows: str | None = None) -> DataFrame:
    """A document that is a list of rows, or an object with the rows under the field `rows` (the first list of objects, if not named)."""
    whole = spark.read.text(path, wholetext=True).select(F.substring(F.trim(F.regexp_replace("value", r"^\uFEFF?\s+", "")), 1, 1).alias("c"))
    df = spark.read.option("multiLine", True).json(path)
    if whole.where("c <> '['").isEmpty():
        return df
    name = rows or next((f.name for f in df.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"), None)
    if name is None or name not in df.columns:
        raise ValueError(f"{path} holds no list of rows")
    return df.select(F.explode(name).alias("_r")).select("_r.*")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant scan: text from text, chunk or content, source from source or id; a line that isn't an object is a text itself."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    j = F.from_json("value", "text string, chunk string, content string, source string, id string", {"mode": "PERMISSIVE"})
    bare = F.when(F.col("value").rlike('^".*"$'), F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]).otherwise(F.col("value"))
    rows = lines.withColumn("j", F.when(F.col("value").rlike(r"^\s*\{"), j))
    body = F.coalesce("j.text", "j.chunk", "j.content")
    return rows.select(F.coalesce(body, bare).alias("text"), F.when(body.isNull(), "").otherwise(F.coalesce("j.source", "j.id", F.lit(""))).alias("source"))


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quoted line breaks, every column text; missing is the empty text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.fillna("")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """By extension: CSV, or JSON with the rows under `rows`."""
    return predictions_csv(spark, path) if path.endswith(".csv") else json_rows(spark, path, "rows")


def batch_files(spark: SparkSession, path: str, glob: str = "*_batch_*.csv") -> DataFrame:
    """All batch files below path, without combined ones, with the file each row is from."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path)
    return df.withColumn("source_file", F.col("_metadata.file_name")).where(~F.contains("source_file", F.lit("_combined")))


def newest_run(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries below path, in order of the number that ends their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    number = F.regexp_extract("path", r"(\d+)\.json$", 1).try_cast("long")
    return files.select("path", number.alias("run"), F.sha2("content", 256).alias("sha256")).orderBy("run", "path")


def keyed_lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def reference_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of texts by query, as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("query", "reference"))


def corpus_profile(lines: DataFrame, marker: str = "pubmedqa_") -> DataFrame:
    return lines.agg(F.count("*").alias("n"), F.count_if(F.contains("source", F.lit(marker))).alias("n_marked"))


# --- positions --------------------------------------------------------------------------------


def positioned(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A Parquet table with each row's place in it, from 0: files in the order of their names, rows in the order of their file.

    Files are counted first, one row a file; no row is moved.
    """
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before, starts = 0, []
    for r in df.groupBy("_file").agg(F.max("_row").alias("last")).orderBy("_file").collect():
        starts.append((r["_file"], before))
        before += r["last"] + 1
    first = spark.createDataFrame(starts, "_file string, _first long")
    return df.join(first, "_file").withColumn(position, F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")


def positional_join(spark: SparkSession, left: str, right: str, position: str = "position") -> DataFrame:
    """Rows of two Parquet tables side by side, by their places; the query fails if one has more rows. Their other columns must differ."""
    a, b = positioned(spark, left, position).withColumn("_left", F.lit(True)), positioned(spark, right, position).withColumn("_right", F.lit(True))
    both = a.join(b, position, "full")
    even = F.assert_true(F.col("_left").isNotNull() & F.col("_right").isNotNull(), F.lit("the tables have different numbers of rows"))
    return both.where(even.isNull()).drop("_left", "_right")


# --- a scan that stops ------------------------------------------------------------------------


def capped_scan(spark: SparkSession, paths: list[str], make: Callable[[DataFrame], DataFrame], target: int, first: int = 1, growth: int = 4) -> tuple[DataFrame, int]:
    """The first `target` rows that make gives for Parquet files, in the files' order, and how many files were read.

    Files are read in waves, each so many times as large as the one before, until there are enough rows; files after the last wave are never opened. make
    gets rows with _file and _row and keeps both, and adds _n, which numbers the rows that it makes of one. So the result is the same whatever the waves.
    """
    taken, read, have, wave, order = None, 0, 0, first, {p: k for k, p in enumerate(paths)}
    while read < len(paths) and have < target:
        some = paths[read : read + wave]
        parts = None
        for p in some:
            one = spark.read.parquet(p).select("*", F.lit(order[p]).alias("_file"), F.col("_metadata.row_index").alias("_row"))
            parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
        made = written(make(parts), "scanned")
        n = made.count()
        if have + n > target:
            made = made.orderBy("_file", "_row", "_n").limit(target - have)
        taken = made if taken is None else taken.unionByName(made, allowMissingColumns=True)
        read, have, wave = read + len(some), have + n, wave * growth
    if taken is None:
        raise ValueError("no files, or a target of no rows")
    return taken, read


# --- XML --------------------------------------------------------------------------------------

# The tags whose texts count, in lower case, and the shortest text.
XML_TAGS = ["abstracttext", "sec", "p", "title", "articletitle"]
XML_LEAST = 30


def xml_texts(spark: SparkSession, path: str, tags: list[str] | None = None, least: int = XML_LEAST) -> DataFrame:
    """path, text, ok: of each XML file the texts of some tags that are longer than `least`, in order, with blank lines between. A broken file has an empty text and ok false.

    A tag's text is what stands before its first child; namespaces don't count. A file is one row of a task.
    """
    wanted = set(tags or XML_TAGS)

    def run(batches):
        import xml.etree.ElementTree as ET

        for rows in batches:
            out = []
            for name, content in zip(rows["path"], rows["content"]):
                try:
                    found = [(e.tag.rpartition("}")[2].lower(), (e.text or "").strip()) for e in ET.fromstring(content).iter() if isinstance(e.tag, str)]
                    out.append((name, "\n\n".join(t for tag, t in found if tag in wanted and len(t) > least), True))
                except ET.ParseError:
                    out.append((name, "", False))
            yield pd.DataFrame(out, columns=["path", "text", "ok"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, ok boolean")


def enriched(base: Column, extra: Column) -> Column:
    """The extra text where it is over 1.2 times as long as the base."""
    return F.when(F.length(F.coalesce(extra, F.lit(""))) > 1.2 * F.length(F.coalesce(base, F.lit(""))), extra).otherwise(base)
