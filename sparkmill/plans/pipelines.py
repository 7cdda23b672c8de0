"""Composite queries: hybrid retrieval with reranking, two corpora with a fallback chain, answered items, resumable scoring, repair, rank statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators import hybrid, overlap, repair, retrieval, scoring_job, stats, topk
from sparkmill.plans.queries import BM25, GOLD, GRID, PAIRS, TOK, TOK3, WORDS, bench_queries, boot_sql, doc_bodies, gold_documents, grid, query, table, turn_pairs, vectors
from sparkmill.sources import files
from sparkmill.sources.shared import shared_path, written

# --- hybrid retrieval -------------------------------------------------------------------------

LEXICAL = "round(CASE WHEN len(list_distinct(list_concat({q}, {b}))) = 0 THEN 0 ELSE len(list_intersect({q}, {b}))::DOUBLE / len(list_distinct(list_concat({q}, {b}))) END + 0.08 * least(len(list_intersect({q}, {b})), 40) + 0.02 * len(list_filter({q}, lambda t: length(t) >= 5 AND contains({low}, t))), 6)"
BARE = r"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '(?i)\b(?:idx|source|dense|lexical|combined)=[^ \t\n\r\f\v,]+', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"

#: Over cd (corpus, id, text) and cq (query_id, corpus, text, v and the parameters): hits are fused, gated, cut and scored again.
HYBRID = f"""q AS (SELECT query_id, corpus, token, count(*) AS qf FROM (SELECT query_id, corpus, unnest({TOK3.format(x='text')}) AS token FROM cq) GROUP BY ALL),
t AS (SELECT corpus, id, {TOK3.format(x='text')} AS t FROM cd), st AS (SELECT corpus, count(*) AS n, avg(len(t)) AS a FROM t GROUP BY 1),
po AS (SELECT corpus, id, dl, token, count(*) AS tf FROM (SELECT corpus, id, len(t) AS dl, unnest(t) AS token FROM t) GROUP BY ALL), df AS (SELECT corpus, token, count(*) AS df FROM po GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN po USING (corpus, token) JOIN df USING (corpus, token) JOIN st USING (corpus) GROUP BY ALL),
bl AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM sc JOIN cq USING (query_id) WHERE score > 0 AND v IS NOT NULL),
dl AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, cd.id, round(list_dot_product(cq.v, e.embedding::DOUBLE[]), 6) AS score FROM cq JOIN cd USING (corpus) JOIN embeddings e ON e.vec_id = cd.id WHERE cq.v IS NOT NULL)),
fu AS (SELECT query_id, id, d.score AS dense, b.score AS bm25, d.rank AS dr, b.rank AS br, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS rrf
  FROM (SELECT dl.* FROM dl JOIN cq USING (query_id) WHERE rank <= greatest("fetch", k)) d FULL JOIN (SELECT bl.* FROM bl JOIN cq USING (query_id) WHERE rank <= greatest("fetch", k)) b USING (query_id, id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr ASC NULLS LAST, br ASC NULLS LAST, id) AS rank FROM fu),
ga AS (SELECT fr.*, "fetch", k, corpus, text AS query, coalesce(dense, 0) >= min_dense OR bm25 IS NOT NULL AS near FROM fr JOIN cq USING (query_id)),
ke AS (SELECT *, bool_or(near) OVER (PARTITION BY query_id) AS any_near FROM ga),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ke WHERE near OR NOT any_near QUALIFY place <= greatest("fetch", k)),
ca AS (SELECT pl.*, cd.text AS body, lower(coalesce(cd.text, '')) AS low, list_distinct({TOK3.format(x='query')}) AS qt, list_distinct({TOK3.format(x='cd.text')}) AS bt, count(*) OVER (PARTITION BY query_id) AS n, bool_or(bm25 IS NOT NULL) OVER (PARTITION BY query_id) AS sparse FROM pl JOIN cd USING (corpus, id)),
rs AS (SELECT *, CASE WHEN n > k THEN {LEXICAL.format(q='qt', b='bt', low='low')} END AS reranker FROM ca),
rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY reranker DESC NULLS LAST, place) AS rr, CASE WHEN sparse THEN 'hybrid' ELSE 'dense' END || CASE WHEN n > k THEN '+rerank' ELSE '' END AS method, dense, bm25, reranker, {BARE.format(x='body')} AS body, k FROM rs QUALIFY rr <= k),
hh AS (SELECT query_id, id, rr AS rank, method, dense, bm25, reranker, body FROM rk WHERE body <> '')"""

#: Over pa (query_id, rank, body) and cq: sentences that an earlier passage has go, the rest is packed. Recursive: pk.
EVIDENCE = r"""se AS (SELECT query_id, rank, pos, trim(x[pos]) AS s FROM (SELECT query_id, rank, list_filter(string_split(regexp_replace(trim(body), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(v) <> '') AS x FROM pa), unnest(range(1, len(x) + 1)) AS u(pos)),
fs AS (SELECT * FROM se WHERE length(s) >= 12 QUALIFY row_number() OVER (PARTITION BY query_id, lower(s) ORDER BY rank, pos) = 1),
ps AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, p FROM (SELECT query_id, rank, string_agg(s, ' ' ORDER BY pos) AS p FROM fs GROUP BY 1, 2)),
pk AS (SELECT query_id, 0::BIGINT AS i, ''::VARCHAR AS block, 0::BIGINT AS used, max_chars FROM cq
  UNION ALL SELECT pk.query_id, ps.i, pk.block || CASE WHEN used > 0 THEN chr(10) ELSE '' END || w, used + length(w) + 2, max_chars
  FROM pk JOIN ps ON ps.query_id = pk.query_id AND ps.i = pk.i + 1,
  LATERAL (SELECT CASE WHEN used + length('[' || ps.i || '] ' || p) + 2 <= max_chars THEN '[' || ps.i || '] ' || p WHEN max_chars - used - 20 > 80 THEN '[' || ps.i || '] ' || substr(p, 1, (max_chars - used - 20)::INT) || '...' END AS w) x WHERE w IS NOT NULL)"""


def profile_sql(p: dict) -> str:
    return ", ".join(f'{v} AS "{n}"' for n, v in p.items())


ONE_CORPUS = f"""cd AS (SELECT '' AS corpus, doc_id AS id, text FROM documents),
cq AS (SELECT item_id AS query_id, '' AS corpus, text, embedding::DOUBLE[] AS v, {profile_sql(hybrid.DEFAULT)} FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""


def item_vectors(s, d) -> DataFrame:
    """Each benchmark item as a query, with the vector of its number."""
    return bench_queries(s, d).join(vectors(s, d).withColumnRenamed("id", "query_id"), "query_id", "left")


def indexed_vectors(s, d) -> DataFrame:
    return vectors(s, d).join(doc_bodies(s, d).select("id"), "id", "left_semi")


@query("hybrid_rerank", f"WITH {ONE_CORPUS}, {HYBRID} SELECT query_id, id, rank::INT AS rank, method, dense, bm25, reranker, md5(body) AS body FROM hh")
def hybrid_rerank(s, d):
    hits, _ = hybrid.retrieve(doc_bodies(s, d), indexed_vectors(s, d), hybrid.with_profile(item_vectors(s, d), hybrid.DEFAULT))
    return hits.withColumn("body", F.md5("body"))


@query("hybrid_evidence", f"WITH RECURSIVE {ONE_CORPUS}, {HYBRID}, pa AS (SELECT query_id, rank, body FROM hh), {EVIDENCE} SELECT query_id, arg_max(block, i) AS block FROM pk GROUP BY 1 HAVING max(i) > 0")
def hybrid_evidence(s, d):
    queries = hybrid.with_profile(item_vectors(s, d), hybrid.DEFAULT)
    hits, _ = hybrid.retrieve(doc_bodies(s, d), indexed_vectors(s, d), queries)
    return hybrid.evidence(hits, queries).where("block <> ''")


# Two corpora: documents with labels are the gold corpus, all others the primary one. An item asks the primary corpus for evidence and the gold one for a
# ranking; its vector is that of the smallest document that holds it whole, and an item without one falls back.

TWO_CORPORA = f"""lb AS (SELECT DISTINCT doc_id FROM labels), {GOLD}, gv AS (SELECT query_id AS item_id, min(substr(gold, 5)::BIGINT) AS doc_id FROM gold GROUP BY 1),
iv AS (SELECT item_id, embedding::DOUBLE[] AS v FROM gv JOIN embeddings ON vec_id = doc_id),
cd AS (SELECT CASE WHEN lb.doc_id IS NULL THEN 'primary' ELSE 'gold' END AS corpus, documents.doc_id AS id, text FROM documents LEFT JOIN lb USING (doc_id)),
cq AS (SELECT 2 * item_id AS query_id, 'primary' AS corpus, text, v, {profile_sql(hybrid.PRIMARY)} FROM benchmark LEFT JOIN iv USING (item_id) UNION ALL SELECT 2 * item_id + 1, 'gold', text, v, {profile_sql(hybrid.GOLD)} FROM benchmark LEFT JOIN iv USING (item_id))"""

#: Lexical hits of the generation queries without hybrid ones, the too alike dropped. Recursive: lg.
FALLBACK = f"""lq AS (SELECT query_id, corpus, k, times, most_alike, list_distinct({TOK3.format(x='text')}) AS qt FROM cq WHERE query_id % 2 = 0 AND query_id NOT IN (SELECT query_id FROM hh)),
lt AS (SELECT corpus, id, text, lower(coalesce(text, '')) AS low, list_distinct({TOK3.format(x='text')}) AS bt FROM cd),
lx AS (SELECT query_id, id, k, most_alike, text, bt, row_number() OVER (PARTITION BY query_id ORDER BY {LEXICAL.format(q='qt', b='bt', low='low')} DESC, length(text) DESC, id) AS rank FROM lq JOIN lt USING (corpus) WHERE len(list_intersect(qt, bt)) > 0 QUALIFY rank <= greatest(k * times, k + 4)),
ln AS (SELECT b.query_id, b.rank, list(a.rank) AS near FROM lx a JOIN lx b ON a.query_id = b.query_id AND a.rank < b.rank AND least(len(a.bt), len(b.bt)) >= a.most_alike * greatest(len(a.bt), len(b.bt)) WHERE len(list_intersect(a.bt, b.bt))::DOUBLE / len(list_distinct(list_concat(a.bt, b.bt))) >= a.most_alike GROUP BY 1, 2),
lm AS (SELECT query_id, id, rank, k, text, coalesce(near, []) AS near FROM lx LEFT JOIN ln USING (query_id, rank)),
lg AS (SELECT query_id, id, rank, k, text, TRUE AS kept, [rank] AS own FROM lm WHERE rank = 1
  UNION ALL SELECT lm.query_id, lm.id, lm.rank, lm.k, lm.text, NOT list_has_any(lg.own, lm.near), CASE WHEN list_has_any(lg.own, lm.near) THEN lg.own ELSE list_append(lg.own, lm.rank) END FROM lg JOIN lm ON lm.query_id = lg.query_id AND lm.rank = lg.rank + 1),
lh AS (SELECT query_id, id, text AS body, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lg WHERE kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= k)"""


def two_corpora(s, d) -> tuple[DataFrame, DataFrame]:
    """Documents by corpus, and two queries an item: 2 * item_id of the primary corpus, 2 * item_id + 1 of the gold one."""
    labelled = table(s, d, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    docs = doc_bodies(s, d).join(labelled, "id", "left").select("id", "text", F.when(F.col("_in"), "gold").otherwise("primary").alias("corpus"))
    holder = gold_documents(s, d).groupBy("query_id").agg(F.min(F.substring("gold", 5, 20).cast("long")).alias("id"))
    items = bench_queries(s, d).join(holder.join(vectors(s, d), "id").select("query_id", "v"), "query_id", "left").withColumnRenamed("query_id", "item_id")
    of = lambda role, corpus, profile: hybrid.with_profile(items.withColumn("query_id", 2 * F.col("item_id") + role).withColumn("corpus", F.lit(corpus)), profile)
    return docs, of(0, "primary", hybrid.PRIMARY).unionByName(of(1, "gold", hybrid.GOLD))


@query("dual_corpus_context", f"""WITH RECURSIVE {TWO_CORPORA}, {HYBRID}, {FALLBACK}, pa AS (SELECT query_id, rank, body FROM hh WHERE query_id % 2 = 0 UNION ALL SELECT query_id, rank, body FROM lh), {EVIDENCE},
bk AS (SELECT query_id, arg_max(block, i) AS block FROM pk WHERE query_id % 2 = 0 GROUP BY 1 HAVING max(i) > 0),
mr AS (SELECT fr.query_id // 2 AS item_id, count(*) AS n_ranked, min(fr.rank) FILTER (WHERE 'doc_' || id = gold) AS gold_rank FROM fr LEFT JOIN gold ON gold.query_id = fr.query_id // 2 WHERE fr.query_id % 2 = 1 AND fr.rank <= 50 GROUP BY 1),
nr AS (SELECT query_id // 2 AS item_id, count(*) AS n_ranked FROM fr WHERE query_id % 2 = 1 AND rank <= 50 GROUP BY 1)
SELECT item_id, CASE WHEN 2 * item_id IN (SELECT query_id FROM hh) THEN 'hybrid' WHEN block IS NOT NULL THEN 'lexical' ELSE 'stub' END AS origin, md5(coalesce(block, substr(trim(benchmark.text), 1, 1200))) AS block, coalesce(nr.n_ranked, 0)::BIGINT AS n_ranked, gold_rank
FROM benchmark LEFT JOIN bk ON bk.query_id = 2 * item_id LEFT JOIN mr USING (item_id) LEFT JOIN nr USING (item_id)""")
def dual_corpus_context(s, d):
    """An item's evidence from the primary corpus and where it came from, and the rank of its first gold document in the gold corpus: one plan for both corpora."""
    docs, queries = two_corpora(s, d)
    docs, queries = written(docs, "corpora"), written(queries, "corpus-queries")
    p = topk.postings(docs, queries)
    hits, ranking = hybrid.retrieve(docs, vectors(s, d).join(docs.select("id", "corpus"), "id"), queries, lists=p)
    hits, ask = written(hits, "hybrid-hits"), queries.where("query_id % 2 = 0")
    without = ask.join(hits.select("query_id"), "query_id", "left_anti")
    found = hybrid.context(ask, hits, hybrid.lexical_hits(docs, without))
    item = F.floor(F.col("query_id") / 2).alias("item_id")
    met = ranking.where("query_id % 2 = 1").select(item, F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("gold"), "rank")
    gold = gold_documents(s, d).withColumnRenamed("query_id", "item_id").withColumn("_gold", F.lit(True))
    ranks = met.join(gold, ["item_id", "gold"], "left").groupBy("item_id").agg(F.count("*").alias("n_ranked"), F.min(F.when(F.col("_gold"), F.col("rank"))).cast("long").alias("gold_rank"))
    rows = found.select(item, "origin", F.md5("block").alias("block")).join(ranks, "item_id", "left")
    return rows.fillna(0, ["n_ranked"])


# --- answered items: answers chosen by real rankings, scored by their texts -------------------

#: The option with the most tokens in what the answerer reads: nothing (the longest option then), the best document, or the three best.
ARMS = {"norag": 0, "rag_1": 1, "rag_3": 3}

ANSWERS = f"""RECURSIVE {BM25}, {GOLD},
it AS (SELECT item_id, [array_to_string(w[1 + (i * len(w)) // 4:((i + 1) * len(w)) // 4], ' ') FOR i IN [0, 1, 2, 3]] AS choices, ('0x' || substr(md5(item_id::VARCHAR), 1, 8))::BIGINT % 4 AS g FROM (SELECT item_id, {WORDS.format(x='text')} AS w FROM benchmark)),
ar AS (SELECT * FROM (VALUES ('norag', 0), ('rag_1', 1), ('rag_3', 3)) a(arm, depth)),
ev AS (SELECT query_id AS item_id, arm, list_distinct(flatten(list({TOK.format(x='text')}))) AS tokens FROM bm JOIN documents ON doc_id = id JOIN ar ON rank <= depth GROUP BY 1, 2),
op AS (SELECT item_id, arm, i, CASE WHEN depth = 0 THEN length(choices[i]) ELSE len(list_intersect(list_distinct({TOK.format(x='choices[i]')}), coalesce(tokens, []))) END AS points FROM it CROSS JOIN ar CROSS JOIN unnest([1, 2, 3, 4]) AS u(i) LEFT JOIN ev USING (item_id, arm)),
an AS (SELECT item_id, arm, arg_max(i, (points, -i)) AS i FROM op GROUP BY 1, 2),
rt AS (SELECT item_id, arm, count(*) FILTER (WHERE 'doc_' || id = gold) AS found, min(rank) FILTER (WHERE 'doc_' || id = gold) AS first FROM ar CROSS JOIN benchmark LEFT JOIN bm ON query_id = item_id LEFT JOIN gold ON gold.query_id = item_id GROUP BY 1, 2),
qa AS (SELECT item_id, arm, 'FINAL ANSWER LETTER: ' || chr((64 + i)::INT) AS response, chr((64 + i)::INT) AS parsed, chr((65 + g)::INT) AS gold, i = g + 1 AS correct, choices[i] AS p, choices[g + 1] AS r,
  item_id IN (SELECT query_id FROM gold) AS evaluable, CASE WHEN item_id IN (SELECT query_id FROM gold) AND depth > 0 THEN coalesce(1.0::DOUBLE / first, 0) END AS mrr FROM an JOIN it USING (item_id) JOIN ar USING (arm) JOIN rt USING (item_id, arm)),
tk AS (SELECT item_id, arm, {TOK.format(x='p')} AS p, {TOK.format(x='r')} AS r FROM qa),
cm AS (SELECT item_id, arm, sum(least(a, b)) AS m FROM (SELECT item_id, arm, t, count(*) AS a FROM (SELECT item_id, arm, unnest(p) AS t FROM tk) GROUP BY ALL) JOIN (SELECT item_id, arm, t, count(*) AS b FROM (SELECT item_id, arm, unnest(r) AS t FROM tk) GROUP BY ALL) USING (item_id, arm, t) GROUP BY ALL),
an2 AS (SELECT qa.item_id, qa.arm, response, parsed, qa.gold, correct, round(CASE WHEN trim(qa.p) = '' OR trim(qa.r) = '' THEN 0 WHEN len(tk.p) + len(tk.r) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(m, 0) / (len(tk.p) + len(tk.r)) END, 6) AS token_f1, correct::INT::DOUBLE AS token_f1_label, round(mrr, 6) AS mrr FROM qa JOIN tk USING (item_id, arm) LEFT JOIN cm USING (item_id, arm))"""


def answers(s, d) -> DataFrame:
    """Each item under each arm: the response, its parsed letter, the gold letter, and scores of the texts of both.

    An item's words are cut into four options. The answerer picks the option with the most tokens in the best documents of its BM25 ranking, or, without retrieval,
    the longest; ties go to the first. So answers and metrics come of texts and rankings.
    """
    w = T.words(F.col("text"))
    cut = lambda i: F.array_join(F.slice("w", 1 + F.floor(F.lit(i) * F.size("w") / 4).cast("int"), (F.floor(F.lit(i + 1) * F.size("w") / 4) - F.floor(F.lit(i) * F.size("w") / 4)).cast("int")), " ")
    gold = F.conv(F.substring(F.md5(F.col("item_id").cast("string")), 1, 8), 16, 10).cast("long") % 4
    items = table(s, d, "benchmark").select("item_id", w.alias("w"), gold.alias("g")).select("item_id", F.array(*[cut(i) for i in range(4)]).alias("choices"), F.char(65 + F.col("g")).alias("gold"))
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(n).alias("depth")) for a, n in ARMS.items()]))
    items = items.withColumn("_a", arms).select("item_id", "choices", "gold", "_a.*")
    hits = written(topk.bm25(topk.postings(doc_bodies(s, d), bench_queries(s, d))), "bm25-hits")
    read = hits.where(F.col("rank") <= max(ARMS.values())).join(doc_bodies(s, d), "id").select(F.col("query_id").alias("item_id"), "rank", T.tokens(F.col("text")).alias("t"))
    read = items.where("depth > 0").select("item_id", "arm", "depth").join(read, "item_id").where("rank <= depth").groupBy("item_id", "arm").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("tokens"))
    gold_docs = gold_documents(s, d)
    sources = hits.select("query_id", F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("source"), "rank")
    found = retrieval.retrieval_metrics(sources, gold_docs).select(F.col("query_id").alias("item_id"), F.col("mrr").alias("_mrr"))
    rows = items.join(read, ["item_id", "arm"], "left").join(found, "item_id", "left")
    points = F.transform("choices", lambda c: F.when(F.col("depth") == 0, F.length(c)).otherwise(F.size(F.array_intersect(F.array_distinct(T.tokens(c)), F.coalesce("tokens", F.array().cast("array<string>"))))))
    place = F.array_position(points, F.array_max(points)) - 1
    rows = rows.withColumn("response", F.concat(F.lit("FINAL ANSWER LETTER: "), F.char(65 + place))).withColumn("parsed", T.choice_letter(F.col("response")))
    scores = T.choice_scores(F.col("parsed"), F.col("gold"), F.col("choices"))
    return rows.withColumn("_s", scores).select("item_id", "arm", "choices", "response", "parsed", "gold", (F.col("parsed") == F.col("gold")).alias("correct"), "_s.token_f1", "_s.token_f1_label", F.when(F.col("depth") > 0, F.col("_mrr")).alias("mrr"))


@query("answered_items", f"WITH {ANSWERS} SELECT * FROM an2")
def answered_items(s, d):
    return answers(s, d).drop("choices")


@query("answered_summary", f"WITH {ANSWERS} SELECT arm, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(token_f1), 6) AS token_f1, round(avg(mrr), 6) AS mrr, count(mrr) AS n_retrieval FROM an2 GROUP BY 1")
def answered_summary(s, d):
    return answers(s, d).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("token_f1"), 6).alias("token_f1"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("mrr").alias("n_retrieval"))


# --- jobs -------------------------------------------------------------------------------------

BATCH = 100


@query("scoring_job", f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, pred, ref, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH} AS batch FROM pairs),
n AS (SELECT conv_id, turn, {TOK.format(x='pred')} AS p, {TOK.format(x='ref')} AS r FROM w),
m AS (SELECT conv_id, turn, sum(least(a, b)) AS m FROM (SELECT conv_id, turn, t, count(*) AS a FROM (SELECT conv_id, turn, unnest(p) AS t FROM n) GROUP BY ALL) JOIN (SELECT conv_id, turn, t, count(*) AS b FROM (SELECT conv_id, turn, unnest(r) AS t FROM n) GROUP BY ALL) USING (conv_id, turn, t) GROUP BY ALL)
SELECT conv_id, turn, batch, CASE WHEN len(p) + len(r) = 0 THEN 1 ELSE round(2.0::DOUBLE * coalesce(m, 0) / (len(p) + len(r)), 6) END AS score FROM w JOIN n USING (conv_id, turn) LEFT JOIN m USING (conv_id, turn)""")
def scoring_job_query(s, d):
    """Turns scored against the turns before them by a job that stops after two batches and is started again: what it has committed."""
    pairs = turn_pairs(s, d)
    work = written(scoring_job.batched(pairs, ["conv_id", "turn"], BATCH), "work")
    identity = {"table": "conversations", "scorer": "token_f1", "batch_size": BATCH, "work": scoring_job.fingerprint(work, "conv_id", "turn", "pred", "ref")}
    root = shared_path(s, "scoring")
    score = lambda rows: rows.select("conv_id", "turn", "batch", F.round(T.token_f1(F.col("pred"), F.col("ref")), 6).alias("score"))
    scoring_job.ScoringJob(s, root, identity).score(work, score, most=2)
    job = scoring_job.ScoringJob(s, root, identity)
    job.score(work, score, together=64)
    return job.rows().select("conv_id", "turn", "batch", "score")


@query("metric_repair", f"WITH {ANSWERS} SELECT item_id, arm, token_f1, token_f1_label FROM an2")
def metric_repair(s, d):
    """Answers stored with the label's match in place of the text's F1, as a faulty run leaves them, then repaired from their choices and letters."""
    rows = written(answers(s, d), "answers")
    path = shared_path(s, "stored-answers")
    rows.withColumn("token_f1", F.col("token_f1_label")).withColumn("part", F.col("item_id") % 8).write.partitionBy("arm", "part").parquet(path)
    right = T.choice_scores(F.col("parsed"), F.col("gold"), F.col("choices"))
    changes = s.read.parquet(path).select("item_id", "arm", right.alias("_s")).select("item_id", "arm", "_s.*")
    repair.repair(s, path, written(changes, "changes"), ["item_id", "arm"], ["arm", "part"])
    return s.read.parquet(path).select("item_id", "arm", "token_f1", "token_f1_label")


# --- rank statistics --------------------------------------------------------------------------

PHI = "0.5 * (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z / 2)"


@query("spearman_rank", GRID + """, p AS (SELECT faith AS a, token_f1 AS b FROM grid WHERE faith IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM p)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def spearman_rank(s, d):
    return stats.spearman(grid(s, d), "faith", "token_f1")


def arms(s, d) -> DataFrame:
    """Token F1 of a question with and without retrieval, by model."""
    return grid(s, d).groupBy("model_key", "question_id").agg(F.max(F.when(F.col("rag_flag"), F.col("token_f1"))).alias("rag"), F.max(F.when(~F.col("rag_flag"), F.col("token_f1"))).alias("no"))


ARMS_SQL = "a AS (SELECT model_key, question_id, max(token_f1) FILTER (WHERE rag_flag) AS rag, max(token_f1) FILTER (WHERE NOT rag_flag) AS no FROM grid GROUP BY 1, 2)"


@query("wilcoxon_signed", GRID + f""", {ARMS_SQL}, d AS (SELECT rag - no AS d FROM a WHERE rag <> no), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus FROM r), i AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY abs(d))),
z AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, i)
SELECT n, w_plus, w_minus, round(z, 6) AS z, round(least(1, 2 * {PHI.replace('z * z', 'z * z')}), 5) AS p FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z)""")
def wilcoxon_signed(s, d):
    return stats.wilcoxon(arms(s, d), "rag", "no")


@query("kappa_letters", GRID + """, n AS (SELECT count(*) AS n, avg((letter = gold)::INT) AS o FROM grid), e AS (SELECT sum(a * b)::DOUBLE AS e FROM (SELECT letter AS l, count(*) AS a FROM grid GROUP BY 1) JOIN (SELECT gold AS l, count(*) AS b FROM grid GROUP BY 1) USING (l))
SELECT n, round(o, 6) AS observed, round(e / n / n, 6) AS expected, round((o - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n, e""")
def kappa_letters(s, d):
    return stats.cohen_kappa(grid(s, d), "letter", "gold")


@query("icc_configurations", GRID + """, m AS (SELECT avg(token_f1) AS m, count(DISTINCT question_id) AS n, count(DISTINCT model_name) AS k FROM grid), x AS (SELECT question_id AS t, model_name AS r, token_f1 - m AS x FROM grid, m),
s AS (SELECT (SELECT sum(s * s) FROM (SELECT sum(x) AS s FROM x GROUP BY t)) AS st, (SELECT sum(s * s) FROM (SELECT sum(x) AS s FROM x GROUP BY r)) AS sr, (SELECT sum(x * x) FROM x) AS al),
q AS (SELECT n, k, st / k / (n - 1) AS msr, sr / n / (k - 1) AS msc, (al - st / k - sr / n) / ((n - 1) * (k - 1)) AS mse FROM s, m)
SELECT n AS targets, k AS raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM q""")
def icc_configurations(s, d):
    return stats.icc(grid(s, d), "question_id", "model_name", "token_f1")


# --- texts ------------------------------------------------------------------------------------


def bleu_sql() -> str:
    bare = "coalesce({x}, '')"
    for pattern, new in overlap.TOKENISER[:7]:
        bare = f"regexp_replace({bare}, '{pattern}', '{new}', 'g')"
    bare = f"(' ' || {bare} || ' ')"
    for pattern, new in overlap.TOKENISER[7:]:
        bare = f"regexp_replace({bare}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    tokens = "list_filter(regexp_split_to_array(" + bare.replace("{-~", "{{-~") + r", '[ \t\n\r\f\v]+'), lambda t: t <> '')"
    return f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, {tokens.format(x='pred')} AS p, {tokens.format(x='ref')} AS r FROM pairs),
g AS (SELECT conv_id, turn, o, 0 AS side, array_to_string(p[i:i + o - 1], ' ') AS g FROM t, unnest([1, 2, 3, 4]) AS a(o), unnest(range(1, len(p) - o + 2)) AS b(i) UNION ALL SELECT conv_id, turn, o, 1, array_to_string(r[i:i + o - 1], ' ') FROM t, unnest([1, 2, 3, 4]) AS a(o), unnest(range(1, len(r) - o + 2)) AS b(i)),
m AS (SELECT conv_id, turn, o, sum(least(p, r)) AS m FROM (SELECT conv_id, turn, o, g, count(*) FILTER (WHERE side = 0) AS p, count(*) FILTER (WHERE side = 1) AS r FROM g GROUP BY ALL) GROUP BY ALL),
s AS (SELECT t.conv_id, t.turn, o, len(p) AS np, len(r) AS nr, len(p) - o + 1 AS n, coalesce(m, 0) AS m FROM t CROSS JOIN unnest([1, 2, 3, 4]) AS a(o) LEFT JOIN m USING (conv_id, turn, o)),
c AS (SELECT *, count(*) FILTER (WHERE n > 0 AND m = 0) OVER (PARTITION BY conv_id, turn ORDER BY o) AS missed FROM s),
l AS (SELECT conv_id, turn, max(np) AS np, max(nr) AS nr, sum(m) AS m, sum(CASE WHEN n <= 0 THEN 0 WHEN m > 0 THEN ln(m::DOUBLE / n) ELSE ln(1 / (pow(2.0, missed) * n)) END) AS l FROM c GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN m = 0 THEN 0 ELSE CASE WHEN np < nr THEN exp(1 - nr::DOUBLE / np) ELSE 1 END * exp(l / least(np, 4)) END, 6) AS bleu FROM l"""


@query("sentence_bleu", bleu_sql())
def sentence_bleu(s, d):
    return overlap.sentence_bleu(turn_pairs(s, d), ["conv_id", "turn"], "pred", "ref")


PROXY = f"{PAIRS}, t AS (SELECT conv_id, turn, list_distinct({TOK3.format(x='pred')}) AS p, list_distinct({TOK3.format(x='ref')}) AS r FROM pairs WHERE length(trim(ref)) >= 50), o AS (SELECT 'used' AS arm, conv_id * 100000 + turn AS at, CASE WHEN len(list_distinct(list_concat(p, r))) = 0 THEN 0 ELSE len(list_intersect(p, r))::DOUBLE / len(list_distinct(list_concat(p, r))) END AS overlap FROM t)"


@query("faithfulness_proxy", f"WITH {PROXY}, " + boot_sql("o", "arm", "overlap", '"at"', 2000))
def faithfulness_proxy(s, d):
    """Mean overlap of an answer's tokens with its evidence, and its interval, over answers whose evidence has 50 characters or more."""
    used = turn_pairs(s, d).where(F.length(F.trim("ref")) >= 50)
    overlaps = used.select(F.lit("used").alias("arm"), (F.col("conv_id") * 100000 + F.col("turn")).alias("at"), T.jaccard(T.tokens(F.col("pred"), 3), T.tokens(F.col("ref"), 3)).alias("overlap"))
    return stats.bootstrap_ci(overlaps, "arm", "overlap", "at")


@query("positional_join", "SELECT position, doc_id, lang, length(text)::INT AS n FROM (SELECT *, row_number() OVER () - 1 AS position FROM documents)")
def positional_join(s, d):
    """Two tables that hold a document's columns apart, put side by side by the places of their rows."""
    base, kept = shared_path(s, "columns"), ["doc_id", "lang", "text"]
    rows = files.positioned(s, f"{d}/documents.parquet").select("position", *kept).repartitionByRange(4, "position").sortWithinPartitions("position")
    rows.select("doc_id", "lang").write.parquet(f"{base}/left")
    rows.select("text").write.parquet(f"{base}/right")
    return files.positional_join(s, f"{base}/left", f"{base}/right").select("position", "doc_id", "lang", F.length("text").alias("n"))
