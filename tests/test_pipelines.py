"""Bounded top-k, hybrid retrieval, resumable scoring, repair, rank statistics and packing: golden cases, failures and plans."""

import itertools
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators import corpus, hybrid, repair, retrieval, scoring_job, stats, topk
from sparkmill.operators.scoring_job import ScoringJob
from sparkmill.plans import queries as plans


def texts(rng, n, words=300):
    """Texts of Zipf-like words, so that some tokens are in nearly all of them."""
    return [" ".join(f"word{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, words))) for _ in range(n)]


# --- bounded top-k ----------------------------------------------------------------------------


def brute_bm25(docs, queries, k):
    import math

    toks = {i: re.findall("[a-z0-9]{3,}", (t or "").lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for qid, text in queries:
        scores = []
        for i, t in toks.items():
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x in re.findall("[a-z0-9]{3,}", (text or "").lower()) if x in t)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), -i))
        out += [(qid, -i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def brute_lexical(docs, queries, k):
    out = []
    for qid, text in queries:
        q = set(re.findall("[a-z0-9]{3,}", (text or "").lower()))
        scores = []
        for i, t in docs:
            b = set(re.findall("[a-z0-9]{3,}", (t or "").lower()))
            if q & b:
                o = len(q & b)
                scores.append((-round(o / len(q | b) + 0.08 * min(o, 40) + 0.02 * sum(len(x) >= 5 and x in t.lower() for x in q), 6), -len(t), i))
        out += [(qid, i, -s, r + 1) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(1)
    docs = list(enumerate([*texts(rng, 600), None, "", "word1", "word1", "xxword12yy"]))
    queries = [(k, t) for k, t in enumerate([*texts(rng, 12, 60), None, "", "word1", "zzz", "word12 word13"])]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    return docs, queries, d, q, topk.postings(d, q)


def same(got, want):
    assert [(a, b, r) for a, b, _, r in sorted(got)] == [(a, b, r) for a, b, _, r in sorted(want)]
    assert [s for *_, s, _ in sorted(got)] == pytest.approx([s for *_, s, _ in sorted(want)], abs=2e-6)


def test_bounded_bm25_equals_brute_force(searched):
    docs, queries, _, _, p = searched
    same([tuple(r) for r in topk.bm25(p).select("query_id", "id", "score", "rank").collect()], brute_bm25(docs, queries, 10))


def test_bounded_lexical_equals_brute_force(searched):
    docs, queries, d, q, p = searched
    same([tuple(r) for r in topk.lexical(d, q, p).select("query_id", "id", "score", "rank").collect()], brute_lexical(docs, queries, 10))


def test_few_candidates_are_scored(spark):
    """Of documents that all share common words with all queries, few are looked at in full."""
    rng = random.Random(2)
    common = " ".join(f"common{k}" for k in range(6))
    rare = lambda n: " ".join(f"{rng.randrange(8000):04d}" for _ in range(n))
    docs = [(i, f"{common} {rare(30)}") for i in range(3000)]
    queries = [(k, f"{common} {rare(8)}") for k in range(10)]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    p = topk.postings(d, q)
    pairs = len(docs) * len(queries)
    weighted = topk.impacts(p)
    assert topk.bm25_candidates(p, weighted, 10).count() < pairs / 20
    assert topk.lexical_candidates(p, 10).count() < pairs / 20
    same([tuple(r) for r in topk.bm25(p).select("query_id", "id", "score", "rank").collect()], brute_bm25(docs, queries, 10))
    same([tuple(r) for r in topk.lexical(d, q, p).select("query_id", "id", "score", "rank").collect()], brute_lexical(docs, queries, 10))


def test_blocks_stay_small(spark):
    """A token that a whole corpus has is parted into blocks, of like impact and bounded size."""
    d = spark.range(20_000).select("id", F.concat(F.lit("every "), F.repeat(F.lit("pad "), (F.col("id") % 50).cast("int"))).alias("text"))
    q = spark.createDataFrame([(0, "every")], "query_id long, text string")
    blocks = topk.impact_blocks(topk.impacts(topk.postings(d, q)))
    sizes = [r[0] for r in blocks.where("token = 'every'").select(F.size("list")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * topk.BLOCK


def test_corpora_do_not_mix(spark):
    docs = [("a", i, f"alpha beta{i}") for i in range(5)] + [("b", i, f"alpha gamma{i}") for i in range(3)]
    d = spark.createDataFrame(docs, "corpus string, id long, text string")
    q = spark.createDataFrame([(1, "a", "alpha beta1 gamma1"), (2, "b", "alpha beta1 gamma1")], "query_id long, corpus string, text string")
    p = topk.postings(d, q)
    hits = {(r.query_id, r.id): r.score for r in topk.bm25(p).collect()}
    alone = {(x, r.id): r.score for x, c in ((1, "a"), (2, "b")) for r in topk.bm25(topk.postings(d.where(F.col("corpus") == c).drop("corpus"), q.where(F.col("corpus") == c).drop("corpus"))).collect()}
    assert hits == alone and len(hits) == 8
    assert {r.query_id: r.id for r in topk.lexical(d, q, p, 1).collect()} == {1: 1, 2: 1}


def test_passages_of_any_length_are_found(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "cat"), (3, None), (4, ""), (5, "concatenate the sat")], "doc_id long, text string")
    items = [(0, "cat sat on the mat"), (1, "cat sat"), (2, "cat"), (3, ""), (4, None), (5, "t sat on t"), (6, "nowhere to be"), (7, " ")]
    got = plans.passages_inside(docs, spark.createDataFrame(items, "query_id long, passage string")).collect()
    want = {(q, i) for q, p in items if p is not None for i, t in ((1, "the cat sat on the mat"), (2, "cat"), (4, ""), (5, "concatenate the sat")) if p in t}
    assert {tuple(r) for r in got} == want


# --- hybrid -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus_of_vectors(spark):
    rng = random.Random(3)
    bodies = texts(rng, 60, 40)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in bodies]
    vectors = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in vectors]
    docs = spark.createDataFrame(list(enumerate(bodies)), "id long, text string")
    q = [(k, bodies[k + 7], vectors[k] if k < 5 else None) for k in range(7)] + [(7, "zzz yyy", vectors[9]), (8, "zzz yyy", None), (9, None, None)]
    return bodies, vectors, docs, spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>"), spark.createDataFrame(q, "query_id long, text string, v array<double>"), q


def brute_hybrid(bodies, vectors, q, k, fetch, min_dense):
    out = {}
    sparse = {}
    for a, b, s, r in brute_bm25(list(enumerate(bodies)), [(x[0], x[1]) for x in q], max(fetch, k)):
        sparse.setdefault(a, {})[b] = (s, r)
    for qid, text, v in q:
        if v is None:
            continue
        dense = sorted((-round(sum(x * y for x, y in zip(v, w)), 6), i) for i, w in enumerate(vectors))[: max(fetch, k)]
        dense = {i: (-s, r + 1) for r, (s, i) in enumerate(dense)}
        sp = sparse.get(qid, {})
        far = 10**9
        fused = sorted((-round((1 / (60 + dense[i][1]) if i in dense else 0) + (1 / (60 + sp[i][1]) if i in sp else 0), 6), dense.get(i, (0, far))[1], sp.get(i, (0, far))[1], i) for i in dense.keys() | sp.keys())
        ids = [x[-1] for x in fused]
        kept = [i for i in ids if dense.get(i, (0,))[0] >= min_dense or i in sp] or ids
        kept = kept[: max(fetch, k)]
        if len(kept) > k:
            scores = hybrid.lexical_pair_scores([text] * len(kept), [bodies[i] for i in kept])
            kept = [kept[n] for n in sorted(range(len(kept)), key=lambda n: -scores[n])[:k]]
        out[qid] = kept
    return out


@pytest.mark.parametrize(("k", "fetch", "min_dense"), [(3, 20, 0.35), (3, 20, 2.0), (5, 4, 0.0), (2, 60, 0.3)])
def test_hybrid_equals_brute_force(spark, corpus_of_vectors, k, fetch, min_dense):
    bodies, vectors, docs, v, q, raw = corpus_of_vectors
    hits, ranking = hybrid.retrieve(docs, v, hybrid.with_profile(q, hybrid.DEFAULT | {"k": k, "fetch": fetch, "min_dense": min_dense}))
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
        assert r.method == ("dense" if r.query_id == 7 else "hybrid") + ("+rerank" if fetch > k or r.query_id != 7 and fetch * 2 > k and r.reranker is not None else "")
    assert got == brute_hybrid(bodies, vectors, raw, k, fetch, min_dense)
    assert ranking.groupBy("query_id").count().agg(F.max("count")).first()[0] <= hybrid.METRIC_HITS


def failing(queries, bodies):
    if "zzz" in queries[0]:
        raise RuntimeError("the model is out of memory")
    return hybrid.lexical_pair_scores(queries, bodies)


def test_a_failing_reranker_keeps_the_fused_order(spark, corpus_of_vectors):
    _, _, docs, v, q, _ = corpus_of_vectors
    asked = hybrid.with_profile(q, hybrid.DEFAULT)
    right = {(r.query_id, r.id): r.rank for r in hybrid.retrieve(docs, v, asked)[0].collect()}
    plain = {(r.query_id, r.id): r.rank for r in hybrid.retrieve(docs, v, asked, scorer=None)[0].collect()}
    got = hybrid.retrieve(docs, v, asked, scorer=failing)[0].collect()
    assert {(r.query_id, r.id): r.rank for r in got if r.query_id != 7} == {k: x for k, x in right.items() if k[0] != 7}
    assert {(r.query_id, r.id): r.rank for r in got if r.query_id == 7} == {k: x for k, x in plain.items() if k[0] == 7}
    assert {r.reranker for r in got if r.query_id == 7} == {0.0}


def test_profiles_are_columns(spark, corpus_of_vectors):
    """Queries of two profiles in one batch get what each gets alone."""
    bodies, vectors, docs, v, q, raw = corpus_of_vectors
    small, large = hybrid.DEFAULT | {"k": 1, "fetch": 5}, hybrid.PRIMARY | {"k": 4, "fetch": 15}
    both = hybrid.with_profile(q.where("query_id < 3"), small).unionByName(hybrid.with_profile(q.where("query_id >= 3"), large))
    got = {}
    for r in sorted(hybrid.retrieve(docs, v, both)[0].collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    want = brute_hybrid(bodies, vectors, raw[:3], 1, 5, small["min_dense"]) | brute_hybrid(bodies, vectors, raw[3:], 4, 15, large["min_dense"])
    assert got == want


def test_fallback_chain(spark, corpus_of_vectors):
    _, _, docs, v, q, raw = corpus_of_vectors
    asked = hybrid.with_profile(q.withColumn("use_rag", F.col("query_id") != 0), hybrid.DEFAULT)
    hits, _ = hybrid.retrieve(docs, v, asked)
    got = {r.query_id: r for r in hybrid.context(asked, hits, hybrid.lexical_hits(docs, asked)).collect()}
    assert {k: r.origin for k, r in got.items()} == {0: "none", **dict.fromkeys(range(1, 5), "hybrid"), 5: "lexical", 6: "lexical", 7: "hybrid", 8: "stub", 9: "stub"}
    assert got[0].block == "" and got[8].block == "zzz yyy" and got[9].block == ""
    assert got[5].block.startswith("[1] ") and len(got[5].block) <= 2000


def test_evidence_drops_repeated_sentences_and_packs(spark):
    passages = [(1, 1, "A first sentence here. Short. A second sentence here."), (1, 2, "a first sentence here. A third sentence here!"), (1, 3, "tiny."), (2, 1, "x" * 300), (2, 2, "y" * 300), (2, 3, "z" * 30)]
    p = spark.createDataFrame(passages, "query_id long, rank int, body string")
    q = spark.createDataFrame([(1, 2000), (2, 450), (3, 10)], "query_id long, max_chars int")
    got = {r.query_id: r.block for r in hybrid.evidence(p, q).collect()}
    assert got[1] == "[1] A first sentence here. A second sentence here.\n[2] A third sentence here!"
    assert got[2] == "[1] " + "x" * 300 + "\n[2] " + "y" * (450 - 306 - 20) + "..."
    assert 3 not in got


def test_dense_in_blocks_equals_one_block(spark, corpus_of_vectors, monkeypatch):
    _, _, _, v, q, _ = corpus_of_vectors
    one = sorted(tuple(r) for r in retrieval.dense(v, q, 4).collect())
    monkeypatch.setattr(retrieval, "DENSE_BLOCK_BYTES", 100)
    assert sorted(tuple(r) for r in retrieval.dense(v, q, 4).collect()) == one and len(one) == 24
    assert retrieval.dense(v, q.where("v is null"), 4).count() == 0


# --- scoring job ------------------------------------------------------------------------------


@pytest.fixture
def work(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}" if k % 7 else None) for k in range(95)], "key int, text string")
    scoring_job.batched(rows, ["key"], 10).write.parquet(str(tmp_path / "work"))
    return spark.read.parquet(str(tmp_path / "work"))


def by_length(rows):
    return rows.withColumn("score", F.length("text").cast("double"))


def table_of(job):
    return sorted((r.key, r.batch, r.score) for r in job.rows().collect())


def test_job_killed_between_data_and_manifest(spark, tmp_path, work, monkeypatch):
    identity, root = {"model": "m", "seed": None, "batch_size": 10}, str(tmp_path / "job")
    whole = ScoringJob(spark, str(tmp_path / "other"), identity)
    whole.score(work, by_length)
    want = table_of(whole)
    assert len(want) == 95 and whole.complete() == {"identity": identity, "batches": 10, "rows": 95, "failed": 14}
    commit = ScoringJob._commit

    def killed(self, manifest):
        if manifest["batch"] == 3:
            raise KeyboardInterrupt
        commit(self, manifest)

    monkeypatch.setattr(ScoringJob, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        ScoringJob(spark, root, identity).score(work, by_length, together=2)
    monkeypatch.setattr(ScoringJob, "_commit", commit)
    job = ScoringJob(spark, root, {"model": "m", "batch_size": 10})  # a key that is missing is null
    assert job.resumed and job.next_batch(10) == 3 and job.complete() is None
    assert {b for _, b, _ in table_of(job)} == {0, 1, 2}
    assert len(list(Path(root).rglob("batch=3/*.parquet"))) == 1  # written, but nobody's
    before = {str(f) for f in Path(root).rglob("*.parquet")}
    assert job.score(work, by_length, together=4) == 7
    assert table_of(job) == want and job.complete()["rows"] == 95
    assert before <= {str(f) for f in Path(root).rglob("*.parquet")}
    assert ScoringJob(spark, root, identity).score(work, by_length) == 0


def test_job_of_another_identity_starts_fresh(spark, tmp_path, work):
    root = str(tmp_path / "job")
    ScoringJob(spark, root, {"model": "m", "seed": 1}).score(work, by_length, most=2)
    for other in ({"model": "m", "seed": 2}, {"model": "m"}, {"model": "m", "seed": "1"}, {"model": "m", "seed": 1, "tag": "x"}, {"model": "m", "seed": True}):
        job = ScoringJob(spark, root, other)
        assert not job.resumed and job.next_batch(10) == 0
    assert ScoringJob(spark, root, {"seed": 1, "model": "m", "tag": None}).next_batch(10) == 2


def test_job_floor_drop_and_gaps(spark, tmp_path, work):
    job = ScoringJob(spark, str(tmp_path / "job"), {"a": 1})
    job.score(work, by_length, floor=6)
    assert sorted(job.commits()) == [6, 7, 8, 9] and job.next_batch(10) == 0 and job.next_batch(10, floor=6) is None
    job.score(work, by_length)
    want = table_of(job)
    job.drop(4)
    assert job.next_batch(10) == 4 and job.complete() is None and len(table_of(job)) == 85
    job.score(work, lambda rows: by_length(rows).withColumn("score", F.col("score") + 100))
    assert [x for x in table_of(job) if x[1] != 4] == [x for x in want if x[1] != 4] and all(s is None or s > 100 for _, b, s in table_of(job) if b == 4)


def test_job_takes_prior_scores_along(spark, tmp_path, work):
    prior = spark.createDataFrame([(3, 0.5), (4, None), (50, 0.25), (500, 1.0)], "key int, score double")
    job = ScoringJob(spark, str(tmp_path / "job"), {"a": 1})
    job.score(work, scoring_job.carried(work, prior, ["key"], by_length))
    got = {k: s for k, _, s in table_of(job)}
    assert len(got) == 95 and got[3] == 0.5 and got[4] == 6.0 and got[50] == 0.25


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(k % 5, str(k)) for k in range(50)], "a int, b string")
    assert scoring_job.fingerprint(df, "a", "b") == scoring_job.fingerprint(df.orderBy(F.desc("b")).repartition(7), "a", "b")
    assert scoring_job.fingerprint(df, "a") != scoring_job.fingerprint(df.union(df.limit(1)), "a") and scoring_job.fingerprint(df.where("1 = 0"), "a").startswith("0-")


# --- repair -----------------------------------------------------------------------------------


def files_by_partition(path):
    out = {}
    for f in Path(path).rglob("*.parquet"):
        out.setdefault(f.parent.name, set()).add(f.name)
    return out


def test_repair_writes_changed_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, f"p{k % 4}", float(k) if k % 3 else None, "x") for k in range(40)] + [(100, None, 1.0, "x")]
    spark.createDataFrame(rows, "k int, part string, v double, more string").write.partitionBy("part").parquet(path)
    before = files_by_partition(path)
    # p1 changes, p2 gets what it has (null for null, too), p3 a key that isn't there
    changes = spark.createDataFrame([(1, -1.0), (5, None), (6, None), (2, 2.0), (777, 9.0)], "k int, v double")
    assert repair.repair(spark, path, changes, ["k"], ["part"]) == 1
    after = files_by_partition(path)
    assert {p for p in before if before[p] != after[p]} == {"part=p1"}
    want = {k: (-1.0 if k == 1 else None if k == 5 else v, p, m) for k, p, v, m in rows}
    assert {r.k: (r.v, r.part, r.more) for r in spark.read.parquet(path).collect()} == want
    assert repair.repair(spark, path, changes, ["k"], ["part"]) == 0 and files_by_partition(path) == after
    assert repair.repair(spark, path, spark.createDataFrame([(100, 5.0)], "k int, v double"), ["k"], ["part"]) == 1
    assert spark.read.parquet(path).where("k = 100").first().v == 5.0 and spark.read.parquet(path).count() == 41
    with pytest.raises(ValueError):
        repair.repair(spark, path, spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double"), ["k"], ["part"])
    with pytest.raises(ValueError):
        repair.repair(spark, path, spark.createDataFrame([(1, "q")], "k int, nowhere string"), ["k"], ["part"])


def test_choice_scores(spark):
    choices = F.array(F.lit("a blue cat"), F.lit("blue dog"), F.lit(" "))
    cases = [("A", "A", 1.0, 1.0), ("a", "B", 0.4, 0.0), ("C", "A", 0.0, 0.0), ("", "", 0.0, 0.0), (None, "A", 0.0, 0.0), ("Z", "Z", 0.0, 1.0)]
    for p, g, f1, label in cases:
        r = spark.range(1).select(T.choice_scores(F.lit(p).cast("string"), F.lit(g), choices).alias("s")).first().s
        assert (r.token_f1, r.token_f1_label) == (f1, label)


# --- rank statistics --------------------------------------------------------------------------


def mean_ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in values]


def windows_without_keys(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Window \[", line) and not re.search(r"windowspecdefinition\((?!.*\bASC\b.*,.*specifiedwindowframe)", line) and "windowspecdefinition(_part" not in line and ", [_part" not in line]


def test_ranks_with_heavy_ties(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 1.0, 1.0, 2.0, 3.5, 9.0]) for _ in range(500)] + [float(k) for k in range(100)]
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: r["rank"] for r in stats.tie_ranks(counts, "v", parts=7).collect()}
    assert got == dict(zip(values, mean_ranks(values)))
    assert windows_without_keys(stats.tie_ranks(counts, "v", parts=7)) == []


def test_spearman_wilcoxon_kappa_icc(spark):
    rng = random.Random(5)
    pairs = [(float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(300)]
    df = spark.createDataFrame([*pairs, (None, 1.0), (float("nan"), 2.0)], "a double, b double")
    ra, rb = mean_ranks([a for a, _ in pairs]), mean_ranks([b for _, b in pairs])
    ma, mb = sum(ra) / 300, sum(rb) / 300
    rho = sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / (sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb)) ** 0.5
    assert tuple(stats.spearman(df, "a", "b").first()) == (300, round(rho, 6))
    d = [a - b for a, b in pairs if a != b]
    r = mean_ranks([abs(x) for x in d])
    got = stats.wilcoxon(df, "a", "b").first()
    plus = sum(x for x, y in zip(r, d) if y > 0)
    assert (got.n, got.w_plus, got.w_minus) == (len(d), plus, sum(r) - plus)
    # a sign-flip simulation gives the same p within its error
    flips = sum(abs(sum(x if rng.random() < 0.5 else -x for x in r)) >= abs(2 * plus - sum(r)) for _ in range(4000)) / 4000
    assert abs(flips - got.p) < 0.04
    labels = spark.createDataFrame([("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15 + [(None, "x")], "a string, b string")
    assert tuple(stats.cohen_kappa(labels, "a", "b").first()) == (50, 0.7, 0.5, 0.4)
    # the ratings of six targets by four judges that the coefficient's authors give, with 0.29 as its value
    ratings = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    long = [(t, j, float(x)) for t, row in enumerate(ratings) for j, x in enumerate(row)] + [(99, 0, 5.0)]
    got = stats.icc(spark.createDataFrame(long, "t int, j int, x double"), "t", "j", "x").first()
    assert (got.targets, got.raters, round(got.icc, 2)) == (6, 4, 0.29)


def test_rank_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert tuple(stats.spearman(df, "a", "b").first()) == (0, None)
    assert tuple(stats.wilcoxon(df, "a", "b").first()) == (0, 0.0, 0.0, None, None)
    assert tuple(stats.cohen_kappa(df, "a", "b").first()) == (0, None, None, None)
    assert stats.icc(df.withColumn("r", F.lit(1)), "a", "r", "b").first().icc is None
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    assert tuple(stats.spearman(same, "a", "b").first()) == (5, None)


# --- packing ----------------------------------------------------------------------------------


def brute_pack(lengths, budget, overlap):
    out, buf, start = [], [], 0
    for k, n in enumerate(lengths):
        if buf and sum(buf) + n > budget:
            out.append((start, k))
            keep = 0
            while keep < len(buf) and (keep == 0 or sum(buf[len(buf) - keep - 1 :]) <= overlap):
                keep += 1
            buf, start = buf[len(buf) - keep :] + [n], k - keep
        else:
            buf.append(n)
    return out + [(start, len(lengths))] if lengths else []


def test_packed_ranges_equal_brute_force(spark):
    rng = random.Random(6)
    cases = [[], [5], [600], [512], [100, 412], [100, 413], [600, 600, 600], [50] * 40, [1] * 300] + [[rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, n array<int>")
    got = {r.k: [tuple(x) for x in r.p] for r in df.select("k", corpus.packed_ranges(F.col("n"), 512, 100).alias("p")).collect()}
    assert got == {k: brute_pack(c, 512, 100) for k, c in enumerate(cases)}


def test_packed_paragraphs_golden(spark):
    para = lambda word, n: " ".join([word] * n)
    docs = [(1, None), (2, " \n "), (3, "too short"), (4, para("longer", 50)), (5, para("aaaa", 500) + "\n" + para("bbbb", 60) + "\n\n\n" + para("cccc", 400)), (6, para("wwww", 1000)), (7, "short line\n" + para("kept", 45))]
    got = {}
    df = corpus.packed_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"))
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.segment, r.part)):
        got.setdefault(r.doc_id, []).append((r.source, r.chunk_id, r.n_words, r.char_offset))
    assert set(got) == {4, 5, 6, 7}
    assert got[4] == [("doc_4", "doc_4_c0", 50, 0)] and got[7] == [("doc_7", "doc_7_c0", 45, 0)]
    # a + b is over the budget; the next begins with a, as one paragraph at least is kept, so it is cut into windows; the last one begins with b
    assert [x[0] for x in got[5]] == ["doc_5", "doc_5_1_0", "doc_5_1_1", "doc_5_2"] and [x[2] for x in got[5]] == [500, 512, 148, 460]
    assert [x[2] for x in got[6]] == [512, 512, 176] and got[6][0][0] == "doc_6" and got[6][2] == ("doc_6_0_2", "doc_6_0_2_c2", 176, 2 * (512 * 5 - 1))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")


def test_a_scan_shuffles_no_postings(spark, searched, monkeypatch):
    """Slices of documents and blocks of queries change nothing, and neither postings nor bodies are exchanged: plans of ranking have no exchange below the few pairs that a scan gives."""
    docs, queries, d, q, p = searched
    monkeypatch.setattr(topk, "CELLS", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    same([tuple(r) for r in topk.bm25(p).select("query_id", "id", "score", "rank").collect()], brute_bm25(docs, queries, 10))
    same([tuple(r) for r in topk.lexical(d, q, p).select("query_id", "id", "score", "rank").collect()], brute_lexical(docs, queries, 10))
    pairs = topk.bm25_candidates(p, topk.impacts(p), 10)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
