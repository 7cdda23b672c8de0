"""Corpus building: windows, paragraphs, leak guard, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.sources.shared import spread, written


def offsets(texts: Column) -> Column:
    """For each of an array's texts the characters of those before it."""
    lengths = F.transform(texts, F.length)
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, n: a + n))


def word_windows(docs: DataFrame, size: int = 300, step: int = 246, least: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Overlapping windows of words: doc_id, chunk, source (bare for the first window), n_words, char_offset (of the bodies before), text.

    A row makes its own windows, so nothing is shuffled; offsets add up within the row's array.
    """
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))).select("doc_id", T.words(F.col("_t")).alias("_w"))
    rows = rows.withColumn("_b", F.filter(F.transform(starts, lambda s: F.struct(F.least(F.lit(size), F.size("_w") - s).alias("n"), F.array_join(F.slice("_w", s + 1, size), " ").alias("t"))), lambda b: b["n"] >= least))
    rows = rows.select("doc_id", "_b", offsets(F.col("_b.t")).alias("_o")).select("doc_id", F.posexplode(F.arrays_zip("_b", "_o")).alias("chunk", "_c"))
    source = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("chunk") > 0, F.concat(F.lit("_"), F.col("chunk").cast("string"))).otherwise(""))
    return rows.select("doc_id", "chunk", source.alias("source"), F.col("_c._b.n").alias("n_words"), F.col("_c._o").alias("char_offset"), F.col("_c._b.t").alias("text"))


def packed_ranges(lengths: Column, budget: int, overlap: int) -> Column:
    """Ranges [a, b) of paragraphs, given their lengths, that are packed in order while they fit the budget.

    A range that is full is closed before the paragraph that doesn't fit; the next one begins with the closed one's last
    paragraphs, as many as fit the overlap and one at least. The fold's state is where the open range begins, how long it
    is, and the ranges closed; what it looks back at is one range, so a row's work grows with its paragraphs.
    """
    kind = "struct<a:int,held:int,out:array<struct<a:int,b:int>>>"
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("held"), F.array().cast("array<struct<a:int,b:int>>").alias("out")).cast(kind)

    def tail(closed: Column) -> Column:
        """n last paragraphs and their length."""
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("held"), F.lit(False).alias("full"))
        over = lambda s, x: s["full"] | ((s["held"] + x > overlap) & (s["n"] > 0))
        return F.aggregate(F.reverse(closed), none, lambda s, x: F.when(over(s, x), F.struct(s["n"].alias("n"), s["held"].alias("held"), F.lit(True).alias("full"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["held"] + x).alias("held"), F.lit(False).alias("full"))))

    def step(s: Column, k: Column) -> Column:
        own = F.get(lengths, k)
        kept = tail(F.slice(lengths, s["a"] + 1, k - s["a"]))
        closed = F.struct((k - kept["n"]).alias("a"), (kept["held"] + own).alias("held"), F.array_append(s["out"], F.struct(s["a"].alias("a"), k.alias("b"))).alias("out")).cast(kind)
        return F.when((s["held"] + own > budget) & (k > s["a"]), closed).otherwise(F.struct(s["a"].alias("a"), (s["held"] + own).alias("held"), s["out"].alias("out")).cast(kind))

    n = F.size(lengths)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.when(n > 0, F.array_append(s["out"], F.struct(s["a"].alias("a"), n.alias("b")))).otherwise(s["out"]))


def packed_paragraphs(docs: DataFrame, budget: int = 512, overlap: int = 100, least_chars: int = 40, least: int = 40) -> DataFrame:
    """doc_id, source, chunk_id, segment, part, n_words, char_offset, text: paragraphs packed to a budget of words, a tail of each chunk repeated in the next.

    Paragraphs are lines longer than least_chars; a text without any is one paragraph, a blank one has no chunk. Segments over
    the budget (one long paragraph, or a tail with one) are cut into windows of it that overlap as much. Segments and
    windows under least words go, though they count where segments are numbered. A row packs itself; nothing is shuffled.
    """
    bare = lambda t: F.regexp_replace(t, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    text = bare(F.coalesce(F.col("text"), F.lit("")))
    lines = F.filter(F.transform(F.split("_t", "\n"), bare), lambda p: F.length(p) > least_chars)
    rows = spread(docs.select("doc_id", "text")).select("doc_id", text.alias("_t")).where("_t <> ''")
    rows = rows.withColumn("_p", lines).withColumn("_p", F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.array("_t")))
    rows = rows.withColumn("_n", F.transform("_p", lambda p: F.size(T.words(p)))).withColumn("_r", packed_ranges(F.col("_n"), budget, overlap))
    rows = rows.select("doc_id", F.posexplode(F.transform("_r", lambda r: F.array_join(F.slice("_p", r["a"] + 1, r["b"] - r["a"]), "\n\n"))).alias("segment", "_s"))
    rows = rows.withColumn("_w", T.words(F.col("_s"))).withColumn("whole", F.size("_w") <= budget)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(max(1, budget - overlap)))
    windows = F.transform(starts, lambda s: F.struct(F.least(F.lit(budget), F.size("_w") - s).alias("n"), F.array_join(F.slice("_w", s + 1, budget), " ").alias("t")))
    own = F.array(F.struct(F.size("_w").alias("n"), F.col("_s").alias("t")))
    rows = rows.withColumn("_b", F.filter(F.when(F.col("whole"), own).otherwise(windows), lambda b: b["n"] >= least))
    rows = rows.select("doc_id", "segment", "whole", "_b", offsets(F.col("_b.t")).alias("_o")).select("doc_id", "segment", "whole", F.posexplode(F.arrays_zip("_b", "_o")).alias("part", "_c"))
    name = lambda *more: F.concat_ws("_", F.lit("doc"), F.col("doc_id").cast("string"), *[F.col(c).cast("string") for c in more])
    first = (F.col("segment") == 0) & (F.col("whole") | (F.col("part") == 0))
    source = F.when(first, name()).when(F.col("whole"), name("segment")).otherwise(name("segment", "part"))
    chunk = F.concat(source, F.lit("_c"), F.when(F.col("whole"), F.col("segment")).otherwise(F.col("part")).cast("string"))
    return rows.select("doc_id", source.alias("source"), chunk.alias("chunk_id"), "segment", "part", F.col("_c._b.n").alias("n_words"), F.col("_c._o").alias("char_offset"), F.col("_c._b.t").alias("text"))


def paragraphs(docs: DataFrame, least: int = 40) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.where(F.length(F.trim("text")) >= least).select("doc_id", "pos", F.trim("text").alias("text"))


def leak_guard(docs: DataFrame, held: DataFrame, least: int = 80) -> DataFrame:
    """docs without those whose fingerprint a held-out text has; shorter texts are exempt."""
    marked = docs.withColumn("_f", F.when(F.length(T.collapsed(F.col("text"))) >= least, T.fingerprint(F.col("text"))))
    return marked.join(held.select(T.fingerprint(F.col("text")).alias("_f")).distinct(), "_f", "left_anti").drop("_f")


def numbered_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Row number and batch over a global order, without one task for all rows: counts of ranges first."""
    # written, so that counts and rows see the same ranges
    ranged = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(before, "_p").withColumn("row_index", at.cast("long")).withColumn("batch", F.floor(F.col("row_index") / size)).drop("_p", "_before")
