"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import bpe, embedding_dedup, filter_audit, html_extract, language_id, line_dedup, mixing, ngram_join, pii, quality, resharding, run_detection, toxicity
from sparkmill.llm.common import fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    index = toxicity.learn(docs.where(~held_out), labels)
    return toxicity.score_documents(docs, index, extra={"held_out": held_out})


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    return language_id.identify(docs, docs.where(~held_out), extra={"held_out": held_out})


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kinds", F.to_json("kinds"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


#: The shards that op11's documents lie in, by a hash of their ids, before they are dealt to so many of equal bytes.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op11_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = resharding.lay_out(table(spark, sf_dir, "documents"), OLD_SHARDS)
    new = resharding.reshard(spark, old, NEW_SHARDS)
    own = {"size": "size", "crc": "text_crc32", "shard": "shard"}
    rows = new.rows(spark, ["doc_id", *(new.prefix + c for c in own)]).withColumnsRenamed({new.prefix + a: b for a, b in own.items()})
    slots = resharding.numbered(rows)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers of a text of n words: every tenth id's text repeats with a period from some word on."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_detection.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted)
    best = run_detection.strongest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("part"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audit(filter_audit.with_labels(filter_audit.judged(docs), labels))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_ngram_join": op2_ngram_join,
        "op3_line_dedup": op3_line_dedup,
        "op4_language_id": op4_language_id,
        "op5_mixing": op5_mixing,
        "op6_pii": op6_pii,
        "op7_quality": op7_quality,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_bpe": op9_bpe,
        "op10_html_extract": op10_html_extract,
        "op11_reshard": op11_reshard,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.oracle_sql(), "op13_filter_audit": filter_audit.ORACLE_SQL}
