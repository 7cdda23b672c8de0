"""A training corpus from raw documents: toxicity, line dedup, near-duplicate join, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from sparkmill.llm.common import fold, table, written
from sparkmill.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the labels' held-out fold isn't learnt from."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.learn(raw.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, index, keep=tuple(c for c in docs.columns if c != "doc_id"), names=("_score", "_predicted", "_evidence"))
    return scored.where(F.col("_predicted") == 0).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, without the lines that spread over sites."""
    return with_length(line_dedup.remove_boilerplate(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"), n=5, percent=80)
    kept = written(groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("_rows")), "kept-ids")
    rows = docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("_rows > 1").isEmpty():
        return rows
    # an id may repeat: the row whose text hashes lowest stays for it
    first = rows.select("doc_id", F.xxhash64("text").alias("_h")).groupBy("doc_id").agg(F.min("_h").alias("_h"))
    return rows.withColumn("_h", F.xxhash64("text")).join(first, ["doc_id", "_h"], "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document twice, whole, in part, or not at all."""
    return with_length(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # less is remembered than by the query alone: the stages before leave an executor less memory
    return bpe.encode_documents(docs.select("doc_id", "text"), tokenizer_path(), remembered=(40_000, 40_000))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars anew, for texts that may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages that learn and encode can't be said in SQL.
ORACLE_SQL = None
