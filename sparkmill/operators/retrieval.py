"""Retrieval for whole batches of queries: dense ranking, fusion, gates, packing, metrics; BM25 and lexical ranking are in topk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.functions import text as T

K1, B, RRF_K = 1.5, 0.75, 60


def ranked(scored: DataFrame, by: list, k: int, query: str = "query_id") -> DataFrame:
    """The k best a query by an order that has no ties; the limit applies on both sides of the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*by))).where(F.col("rank") <= k)


def lexical_score(query: Column, body: Column, q: Column, b: Column) -> Column:
    """Jaccard, plus 0.08 for each of at most 40 shared tokens, plus 0.02 for each query token of five characters or more inside the body."""
    shared = F.size(F.array_intersect(q, b))
    inside = F.size(F.filter(q, lambda t: (F.length(t) >= 5) & F.contains(F.lower(body), t)))
    return F.round(T.jaccard(q, b) + 0.08 * F.least(shared, F.lit(40)) + 0.02 * inside, 6)


def fuse(*lists: DataFrame, k: int = 10, c: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists (query_id, id, rank); ties by the first list's rank, then the second's."""
    rows = None
    for n, one in enumerate(lists):
        part = one.select("query_id", "id", "rank", F.lit(n).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (c + F.col("rank"))), 6).alias("score"), *[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n}") for n in range(len(lists))])
    return ranked(scored, [F.desc("score"), *[F.col(f"rank_{n}").asc_nulls_last() for n in range(len(lists))], "id"], k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Bytes of query vectors that are sent to the tasks at once.
DENSE_BLOCK_BYTES = 64 << 20


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block_queries: int = 256, others_only: bool = True) -> DataFrame:
    """Exact inner product of each query (query_id, v) with each vector (id, v); either may have corpus, which must then agree.

    Queries are dealt to as many blocks as keep one below a size; a block's queries go past all vectors, and a block of queries and a batch of vectors are multiplied as matrices. Each batch gives k rows a
    query, so what is shuffled is k rows a query and batch. others_only leaves out a vector with the query's own id.
    """
    import numpy as np
    import pyarrow as pa

    def with_corpus(df: DataFrame) -> DataFrame:
        return df if "corpus" in df.columns else df.withColumn("corpus", F.lit(""))

    q = with_corpus(queries).where("v is not null").select("query_id", "corpus", "v")
    vectors = with_corpus(vectors).select("id", "corpus", "v")
    size = q.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    blocks = 1 + size // DENSE_BLOCK_BYTES
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), q.schema["query_id"].dataType.simpleString()

    def scored(shared):
        def run(batches):
            qids, corpora, qm = shared.value
            for batch in batches:
                own, place = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
                if not batch.num_rows:
                    continue
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                for corpus in set(corpora) & set(place):
                    here, there = np.flatnonzero(corpora == corpus), np.flatnonzero(place == corpus)
                    ids = own[there]
                    for at in range(0, len(here), block_queries):
                        some = here[at : at + block_queries]
                        s = np.round(qm[some] @ x[there].T, 6)
                        for q_at, row in zip(some, s):
                            best = np.lexsort((ids, -row))[: k + 1]
                            yield pa.RecordBatch.from_arrays([pa.array([qids[q_at]] * len(best)), pa.array(ids[best]), pa.array(row[best])], names=["query_id", "id", "score"])

        return vectors.mapInArrow(run, f"query_id {query_type}, id {id_type}, score double")

    found = None
    for block in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # a stated query set, below the size
        if part.num_rows:
            held = (part.column("query_id").to_pylist(), np.array(part.column("corpus").to_pylist(), object), np.array(part.column("v").to_pylist(), np.float64))
            one = scored(vectors.sparkSession.sparkContext.broadcast(held))
            found = one if found is None else found.union(one)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"query_id {query_type}, id {id_type}, score double")
    return ranked(found.where("query_id <> id") if others_only else found, [F.desc("score"), "id"], k)


def hit_score(hit: Column) -> Column:
    """The first score that a hit has; lexical scores don't count."""
    return F.coalesce(hit["reranker"], hit["dense"], hit["combined"], F.lit(0.0))


def packed(blocks: Column, most: int, margin: int = 80, least: int = 80) -> Column:
    """Blocks taken in order while they fit, with two characters between; the first that doesn't fit is cut to what is left, if that is enough, and ends it."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(a: Column, b: Column) -> Column:
        fits, left = a["used"] + F.length(b) + 2 <= most, most - a["used"] - margin
        cut = F.when(left > least, F.array_append(a["out"], F.substr(b, F.lit(1), left))).otherwise(a["out"])
        return (
            F.when(a["done"], a)
            .when(fits, F.struct(F.array_append(a["out"], b).alias("out"), (a["used"] + F.length(b) + 2).alias("used"), F.lit(False).alias("done")))
            .otherwise(F.struct(cut.alias("out"), a["used"].alias("used"), F.lit(True).alias("done")))
        )

    return F.aggregate(blocks, start, step, lambda a: a["out"])


def greedy_distinct(bodies: Column, most_alike: float | Column = 0.88) -> Column:
    """Places of the texts kept, in order, when one is dropped that is too like any kept before it."""
    start = F.array().cast("array<struct<at:int,t:array<string>>>")
    numbered = F.transform(bodies, lambda b, i: F.struct(i.alias("at"), F.array_distinct(T.tokens(b, 3)).alias("t")))
    keep = F.aggregate(numbered, start, lambda a, b: F.when(F.exists(a, lambda k: T.jaccard(k["t"], b["t"]) >= most_alike), a).otherwise(F.array_append(a, b)))
    return F.transform(keep, lambda k: k["at"])


def retrieval_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hits: query_id, source, rank; gold: query_id, gold. Recall@k and MRR a query; a hit matches gold that it equals or extends by an underscore."""
    match = (F.col("source") == F.col("gold")) | F.startswith("source", F.concat("gold", F.lit("_")))
    found = gold.join(hits, "query_id", "left").withColumn("m", F.when(match, F.col("rank"))).groupBy("query_id", "gold").agg(F.min("m").alias("m"))
    return found.groupBy("query_id").agg(
        F.count("*").alias("n_gold"), F.min("m").cast("long").alias("first_rank"), *[F.round(F.count_if(F.col("m") <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.coalesce(1 / F.min("m"), F.lit(0.0)), 6).alias("mrr")
    )
