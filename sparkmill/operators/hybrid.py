"""Hybrid retrieval for a batch of queries: dense and BM25 lists fused, gated, reranked, cleaned and packed into evidence.

A query's parameters are columns of its row, so one plan serves queries of several corpora and profiles: rankings are made once to the
largest depth that any profile asks for, and cut for each query by its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators import topk
from sparkmill.operators.retrieval import RRF_K, dense, ranked
from sparkmill.operators.topk import in_corpus

# The retrieval profiles. k hits of `fetch` candidates, the dense gate, the characters of a context, the
# over-fetch of lexical hits, the weight of the lexical score in a blend, and the likeness above which a hit is dropped.
DEFAULT = {"k": 3, "fetch": 20, "min_dense": 0.35, "max_chars": 2000, "times": 6, "weight": 0.22, "most_alike": 0.88}
GOLD = DEFAULT | {"min_dense": 0.12, "times": 8, "fetch": 30}
PRIMARY = DEFAULT | {"k": 6, "max_chars": 7500, "times": 12, "weight": 0.40, "min_dense": 0.08, "most_alike": 0.85}

METRIC_HITS = 50
STUB_CHARS = 1200


def with_profile(queries: DataFrame, profile: dict) -> DataFrame:
    """queries with a column for each parameter; those that a query has already stay."""
    return queries.withColumns({name: F.lit(value) for name, value in profile.items() if name not in queries.columns})


def deepest(queries: DataFrame, value: Column) -> int:
    return queries.agg(F.max(value)).first()[0] or 1


def fused(dense_list: DataFrame, sparse_list: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, rrf, rank, dense, bm25: reciprocal ranks added up; of equal sums the better dense rank first, then the better BM25 rank.

    Each list is cut at the query's fetch before it counts. A document that only one list has is kept with a null for the other.
    """
    depth = queries.select("query_id", F.greatest("fetch", "k").alias("depth"))
    cut = lambda rows: rows.join(depth, "query_id").where("rank <= depth")
    a = cut(dense_list).select("query_id", "id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
    b = cut(sparse_list).select("query_id", "id", F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full").withColumn("rrf", F.round(part("dense_rank") + part("bm25_rank"), 6))
    order = [F.desc("rrf"), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "id"]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def gated(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits near enough to the query, or in the BM25 list; all of a query that has none. Numbered anew and cut at fetch."""
    own = Window.partitionBy("query_id")
    h = hits.join(queries.select("query_id", "min_dense", F.greatest("fetch", "k").alias("depth")), "query_id")
    h = h.withColumn("_in", (F.coalesce("dense", F.lit(0.0)) >= F.col("min_dense")) | F.col("bm25").isNotNull())
    h = h.withColumn("_any", F.bool_or("_in").over(own)).where("_in or not _any")
    return h.withColumn("place", F.row_number().over(own.orderBy("rank"))).where("place <= depth").drop("_in", "_any", "min_dense", "depth")


def lexical_pair_scores(queries: list[str], bodies: list[str]) -> list[float]:
    """The lexical score of each query and body; a stand-in for a model that scores pairs."""
    import re

    words = re.compile(r"[a-z0-9]{3,}").findall
    out = []
    for query, body in zip(queries, bodies):
        low = (body or "").lower()
        q, b = set(words((query or "").lower())), set(words(low))
        inside = sum(len(t) >= 5 and t in low for t in q)
        o = len(q & b)
        out.append(round(o / max(len(q | b), 1) + 0.08 * min(o, 40) + 0.02 * inside, 6))
    return out


def rerank(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] = lexical_pair_scores, batch: int = 32) -> DataFrame:
    """candidates: query_id, query, k, id, place, body. query_id, id, reranker, rank, reranked: the k best of a query by the scorer, ties by place.

    The scorer gets lists of queries and bodies, so many at once. Where it fails for a query, that query's first k stand in their order with score 0
    and the others aren't touched. A query of no more than k candidates keeps its order and has no score. A query's candidates are one row of a task: as many as were fetched.
    """
    id_type, query_type = candidates.schema["id"].dataType.simpleString(), candidates.schema["query_id"].dataType.simpleString()
    lists = candidates.groupBy("query_id", "query", "k").agg(F.array_sort(F.collect_list(F.struct("place", "id", "body"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for query_id, query, k, hits in zip(*(c.to_pylist() for c in rows.columns)):
                ids = [h["id"] for h in hits]
                if len(ids) <= k:
                    out += [(query_id, i, None, n + 1, False) for n, i in enumerate(ids)]
                    continue
                try:
                    scores: list[float] = []
                    for at in range(0, len(hits), batch):
                        some = hits[at : at + batch]
                        scores += [float(x) for x in scorer([query] * len(some), [h["body"] or "" for h in some])]
                    order = sorted(range(len(ids)), key=lambda n: -scores[n])[:k]
                except Exception:  # whatever a model raises, the query keeps its fused order
                    order, scores = list(range(k)), [0.0] * len(ids)
                out += [(query_id, ids[n], scores[n], at + 1, True) for at, n in enumerate(order)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=schema)

    names = ["query_id", "id", "reranker", "rank", "reranked"]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("query_id", kinds[query_type]), ("id", kinds[id_type]), ("reranker", pa.float64()), ("rank", pa.int32()), ("reranked", pa.bool_())])
    return lists.mapInArrow(run, f"query_id {query_type}, id {id_type}, reranker double, rank int, reranked boolean")


def clean(text: Column) -> Column:
    """Without the index's own tags, each run of white space one space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i){T.EDGE}(?:idx|source|dense|lexical|combined)=[^ \t\n\r\f\x0B,]+", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\x0B]+", " "))


def evidence(passages: DataFrame, queries: DataFrame, least: int = 12) -> DataFrame:
    """passages: query_id, rank, body. query_id, block: numbered passages packed to the query's max_chars; a sentence that an earlier passage has, or under `least` characters, goes.

    A passage that doesn't fit is cut to what is left, if that is over 80 characters, and marked; the first that can't be ends the block.
    """
    s = passages.select("query_id", "rank", F.posexplode(T.sentences(F.col("body"))).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).withColumn("key", F.lower("sentence"))
    first = s.where(F.length("key") >= least).groupBy("query_id", "key").agg(F.min(F.struct("rank", "pos", "sentence")).alias("f")).select("query_id", "f.*")
    texts = first.groupBy("query_id", "rank").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "sentence")))["sentence"], " ").alias("p"))
    lists = texts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda x: x["p"]).alias("ps")).join(queries.select("query_id", "max_chars"), "query_id")
    lead = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        whole = F.concat(lead(x["i"]), x["p"])
        left = F.col("max_chars") - a["used"] - 20
        cut = F.concat(lead(x["i"]), F.substr(x["p"], F.lit(1), left), F.lit("..."))
        took = lambda b: F.struct(F.array_append(a["out"], b).alias("out"), (a["used"] + F.length(b) + 2).alias("used"), F.lit(False).alias("done"))
        stop = F.struct(a["out"].alias("out"), a["used"].alias("used"), F.lit(True).alias("done"))
        return F.when(a["done"], a).when(a["used"] + F.length(whole) + 2 <= F.col("max_chars"), took(whole)).when(left > 80, took(cut)).otherwise(stop)

    numbered = F.transform("ps", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    return lists.select("query_id", F.array_join(F.aggregate(numbered, start, step, lambda a: a["out"]), "\n").alias("block"))


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]] | None = lexical_pair_scores, lists: topk.Postings | None = None) -> tuple[DataFrame, DataFrame]:
    """docs: id, text; vectors: id, v; queries: query_id, text, v and the parameters; all may have corpus.

    Returns the final hits (query_id, id, rank, method, dense, bm25, reranker, body) and the fused list for metrics (query_id, id, rank), of METRIC_HITS at most. A query without a
    vector has no hits. Without a scorer, or with k candidates or fewer, hits keep the fused order.
    """
    docs, vectors, queries = in_corpus(docs), in_corpus(vectors), in_corpus(queries).where("v is not null")
    depth = deepest(queries, F.greatest("fetch", "k"))
    p = lists or topk.postings(docs, queries)
    hits = fused(dense(vectors, queries, depth, others_only=False), topk.bm25(p, depth).join(queries.select("query_id"), "query_id", "left_semi"), queries)
    kept = gated(hits, queries)
    rows = queries.select("query_id", "corpus", F.col("text").alias("query"), "k")
    candidates = kept.join(rows, "query_id").join(docs.select("corpus", "id", F.col("text").alias("body")), ["corpus", "id"])
    if scorer:
        best = rerank(candidates, scorer)
    else:
        best = candidates.where("place <= k").select("query_id", "id", F.lit(None).cast("double").alias("reranker"), F.col("place").alias("rank"), F.lit(False).alias("reranked"))
    lists_met = kept.groupBy("query_id").agg(F.bool_or(F.col("bm25").isNotNull()).alias("_sparse"))
    method = F.concat(F.when(F.col("_sparse"), "hybrid").otherwise("dense"), F.when(F.col("reranked"), "+rerank").otherwise(""))
    final = best.join(candidates.select("query_id", "id", "dense", "bm25", clean(F.col("body")).alias("body")), ["query_id", "id"]).join(lists_met, "query_id")
    final = final.where("body <> ''").select("query_id", "id", "rank", method.alias("method"), "dense", "bm25", "reranker", "body")
    return final, hits.where(F.col("rank") <= METRIC_HITS).select("query_id", "id", "rank")


def lexical_hits(docs: DataFrame, queries: DataFrame, lists: topk.Postings | None = None) -> DataFrame:
    """query_id, id, rank, score, body: lexical hits, more than k fetched as the profile says, the too alike dropped, k kept."""
    docs, queries = in_corpus(docs), in_corpus(queries)
    p = lists or topk.postings(docs, queries)
    depth = F.greatest(F.col("k") * F.greatest("times", F.lit(1)), F.col("k") + 4)
    hits = topk.lexical(docs, queries, p, deepest(queries, depth)).join(queries.select("query_id", "corpus", "k", "most_alike", depth.alias("depth")), "query_id").where("rank <= depth")
    with_body = hits.join(docs.select("corpus", "id", F.col("text").alias("body")), ["corpus", "id"])
    h = with_body.groupBy("query_id", "k", "most_alike").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "body"))).alias("h"))
    kept = F.slice(F.transform(topk.greedy_distinct(F.col("h.body"), F.col("most_alike")), lambda i: F.element_at("h", i + 1)), F.lit(1), F.col("k"))
    return h.select("query_id", F.posexplode(kept).alias("at", "hit")).select("query_id", "hit.id", (F.col("at") + 1).alias("rank"), "hit.score", "hit.body")


def context(queries: DataFrame, hybrid_hits: DataFrame, lexical: DataFrame) -> DataFrame:
    """query_id, block, origin: hybrid evidence, else lexical, else the query itself; nothing for a query that asks for none (use_rag false)."""
    a = evidence(hybrid_hits, queries).where("block <> ''").withColumnRenamed("block", "_hybrid")
    b = evidence(lexical, queries).where("block <> ''").withColumnRenamed("block", "_lexical")
    rows = queries.join(a, "query_id", "left").join(b, "query_id", "left")
    use = F.col("use_rag") if "use_rag" in queries.columns else F.lit(True)
    stub = F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, STUB_CHARS)
    origin = F.when(~use, "none").when(F.col("_hybrid").isNotNull(), "hybrid").when(F.col("_lexical").isNotNull(), "lexical").otherwise("stub")
    block = F.when(~use, "").otherwise(F.coalesce("_hybrid", "_lexical", stub))
    return rows.select("query_id", block.alias("block"), origin.alias("origin"))
