"""Further queries: evaluation rows, corpus jobs, reports and the composite pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators import corpus, retrieval
from sparkmill.sources.shared import written
from sparkmill.plans.queries import BM25, CONFIGS, DENSE, GRID, KWH_SQL, LEX, RRF, TOK, TOK3, WORDS, bm25_topk, dense_topk, doc_bodies, grid, hybrid, query, strategies, table

# --- functions --------------------------------------------------------------------------------


@query("clean_passage", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?i)\b(?:source|chunk_id|section)=[^ \t\n\r\f\v]*', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM documents")
def clean_passage(s, d):
    x = F.regexp_replace("text", rf"(?i){T.EDGE}(?:source|chunk_id|section)=[^ \t\n\r\f\x0B]*", " ")
    return table(s, d, "documents").select("doc_id", F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " ")).alias("text"))


@query("choice_text", GRID + "SELECT doc_id, cfg, coalesce(['alpha', 'beta', 'gamma'][ascii(letter) - 64], letter) AS option_text, chr((65 + doc_id % 4)::INT) AS gold FROM grid")
def choice_text(s, d):
    options = F.array(*map(F.lit, ["alpha", "beta", "gamma"]))
    return grid(s, d).select("doc_id", "cfg", F.coalesce(F.try_element_at(options, F.ascii("letter") - 64), "letter").alias("option_text"), T.gold_letter((F.col("doc_id") % 4).cast("string")).alias("gold"))


@query("evidence_only", r"SELECT conv_id, turn, CASE WHEN contains(text, ' the ') THEN trim(substr(text, strpos(text, ' the ') + 5)) ELSE trim(string_split(text, chr(10) || chr(10))[1]) END AS evidence FROM conversations")
def evidence_only(s, d):
    t, mark = F.col("text"), " the "
    after = F.trim(F.substr(t, F.instr(t, mark) + len(mark)))
    return table(s, d, "conversations").select("conv_id", "turn", F.when(F.contains(t, F.lit(mark)), after).otherwise(F.trim(F.element_at(F.split(t, "\n\n"), 1))).alias("evidence"))


@query("relevant_ids", "SELECT item_id, unnest(['doc_' || item_id, 'doc_' || item_id || '_long']) AS gold FROM benchmark")
def relevant_ids(s, d):
    own = F.concat(F.lit("doc_"), F.col("item_id").cast("string"))
    return table(s, d, "benchmark").select("item_id", F.explode(F.array(own, F.concat(own, F.lit("_long")))).alias("gold"))


@query("mean_std_display", GRID + "SELECT model_name, printf('%.3f ± %.3f', avg(token_f1), stddev_samp(token_f1)) AS shown FROM grid GROUP BY 1")
def mean_std_display(s, d):
    return grid(s, d).groupBy("model_name").agg(F.format_string("%.3f ± %.3f", F.avg("token_f1"), F.stddev_samp("token_f1")).alias("shown"))


@query("energy_counter", """WITH e AS (SELECT user_id, event_id, ts, round(value * 1000)::BIGINT AS mj, lag(round(value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS elapsed FROM events)
SELECT user_id, event_id, round(CASE WHEN mj >= before THEN (mj - before) / 1000.0::DOUBLE ELSE 70.0::DOUBLE * elapsed END, 6) AS joules, mj < before AS wrapped FROM e WHERE before IS NOT NULL""")
def energy_counter(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    mj = F.round(F.col("value") * 1000).cast("long")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(s, d, "events").select("user_id", "event_id", "ts", mj.alias("mj"), seconds.alias("at")).withColumn("before", F.lag("mj").over(w)).withColumn("elapsed", F.col("at") - F.lag("at").over(w))
    joules = F.when(F.col("mj") >= F.col("before"), (F.col("mj") - F.col("before")) / 1000).otherwise(70.0 * F.col("elapsed"))
    return e.where("before is not null").select("user_id", "event_id", F.round(joules, 6).alias("joules"), (F.col("mj") < F.col("before")).alias("wrapped"))


# --- retrieval --------------------------------------------------------------------------------


@query("ranked_sources_distinct", f"WITH {BM25}, x AS (SELECT query_id, source, min(rank) AS first FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY 1, 2) SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM x")
def ranked_sources_distinct(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "source")
    x = bm25_topk(s, d).join(docs, "id").groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    return x.select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long").alias("rank"))


@query("blend_topk", f"WITH {RRF} SELECT query_id, id, round(0.78 * score + 0.22 * coalesce(1.0::DOUBLE / r1, 0), 6) AS blended FROM rr")
def blend_topk(s, d):
    return hybrid(s, d).select("query_id", "id", F.round(0.78 * F.col("score") + 0.22 * F.coalesce(1 / F.col("rank_1"), F.lit(0.0)), 6).alias("blended"))


@query("dense_or_sparse", f"WITH {DENSE}, k AS (SELECT *, score >= 0.35 OR id % 3 = 0 AS keep, bool_or(score >= 0.35 OR id % 3 = 0) OVER (PARTITION BY query_id) AS any_kept FROM dk) SELECT query_id, id FROM k WHERE keep OR (NOT any_kept AND rank <= 3)")
def dense_or_sparse(s, d):
    keep = (F.col("score") >= 0.35) | (F.col("id") % 3 == 0)
    k = dense_topk(s, d).withColumn("keep", keep).withColumn("any_kept", F.bool_or(keep).over(Window.partitionBy("query_id")))
    return k.where("keep or (not any_kept and rank <= 3)").select("query_id", "id")


@query("gold_rank", f"WITH {BM25} SELECT item_id AS query_id, min(rank) AS gold_rank, min(rank) IS NOT NULL AS found FROM benchmark LEFT JOIN (SELECT query_id, id, rank FROM bm WHERE id % 4 = 0) ON query_id = item_id GROUP BY 1")
def gold_rank(s, d):
    hits = bm25_topk(s, d).where("id % 4 = 0").select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"))
    x = table(s, d, "benchmark").join(hits, "item_id", "left").groupBy(F.col("item_id").alias("query_id")).agg(F.min("rank").alias("gold_rank"))
    return x.withColumn("found", F.col("gold_rank").isNotNull())


@query("sentence_dedupe", r"""WITH s AS (SELECT conv_id, turn, i, trim(x[i]) AS body FROM (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(v) <> '') AS x FROM conversations) t, unnest(range(1, len(x) + 1)) AS r(i)),
k AS (SELECT *, trim(regexp_replace(lower(body), '[ \t\n\r\f\v]+', ' ', 'g')) AS key FROM s)
SELECT conv_id, count(*) AS n_kept FROM (SELECT conv_id FROM k WHERE length(key) >= 12 QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY turn, i) = 1) GROUP BY 1""")
def sentence_dedupe(s, d):
    k = table(s, d, "conversations").select("conv_id", F.explode(T.sentences(F.col("text"))).alias("body")).select("conv_id", T.collapsed(F.col("body")).alias("key"))
    return k.where(F.length("key") >= 12).distinct().groupBy("conv_id").agg(F.count("*").alias("n_kept"))


@query("hybrid_pipeline")
def hybrid_pipeline(s, d):
    """Fused lists, near-equal hits dropped, the rest packed to a budget: a context and its ranked sources for each item."""
    hits = written(hybrid(s, d).select("query_id", "id", "rank"), "hits")  # few, which Spark sees before it shuffles bodies to them
    h = hits.join(doc_bodies(s, d), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("h"))
    h = h.withColumn("kept", F.transform(retrieval.greedy_distinct(F.col("h.text")), lambda i: F.element_at("h", i + 1)))
    blocks = F.transform("kept", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] doc_"), x["id"].cast("string"), F.lit("\n"), x["text"]))
    return h.select("query_id", F.array_join(retrieval.packed(blocks, 6000), "\n\n").alias("context"), F.transform("kept", lambda x: F.concat(F.lit("doc_"), x["id"].cast("string"))).alias("sources"))


# --- corpus ------------------------------------------------------------------------------------


@query("token_windows", f"WITH w AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents) SELECT doc_id, s::INT AS start, len(w[s + 1 : s + 512])::INT AS n FROM w, unnest(range(0, greatest(len(w) - 100, 1), 412)) AS r(s) WHERE len(w) > 0")
def token_windows(s, d):
    r = table(s, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n")).where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 101, F.lit(0)), F.lit(412))
    return r.withColumn("start", F.explode(starts)).select("doc_id", "start", F.least(F.lit(512), F.col("n") - F.col("start")).alias("n"))


PACK = f"""RECURSIVE p AS (SELECT doc_id, CASE WHEN len(ps) > 0 THEN ps ELSE [t] END AS ps FROM (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: length(x) > 40) AS ps
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM documents) WHERE t <> '')),
l AS (SELECT doc_id, ps, list_transform(ps, lambda x: len({WORDS.format(x='x')})) AS n FROM p),
f AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS a, n[1]::BIGINT AS held, NULL::BIGINT AS c, ps, n FROM l
  UNION ALL SELECT doc_id, k + 1, CASE WHEN over THEN a2 ELSE a END, CASE WHEN over THEN list_sum(n[a2 + 1:k + 2]) ELSE held + n[k + 2] END, CASE WHEN over THEN a END, ps, n
  FROM (SELECT *, held + n[k + 2] > 512 AS over, coalesce(list_min([s FOR s IN range(a, k + 1) IF list_sum(n[s + 1:k + 1]) <= 100]), k) AS a2 FROM f WHERE k + 1 < len(n))),
r AS (SELECT doc_id, c AS a, k AS b, ps FROM f WHERE c IS NOT NULL UNION ALL SELECT doc_id, a, k + 1, ps FROM f WHERE k + 1 = len(n)),
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS seg, array_to_string(ps[a + 1:b], chr(10) || chr(10)) AS t FROM r),
w AS (SELECT doc_id, seg, t, {WORDS.format(x='t')} AS w FROM g),
b AS (SELECT doc_id, seg, TRUE AS whole, 0 AS part, len(w) AS n, t FROM w WHERE len(w) <= 512 UNION ALL SELECT doc_id, seg, FALSE, s // 412, len(w[s + 1:s + 512]), array_to_string(w[s + 1:s + 512], ' ') FROM w, unnest(range(0, len(w), 412)) AS u(s) WHERE len(w) > 512)"""


@query("packed_paragraphs", f"""WITH {PACK}, k AS (SELECT *, 'doc_' || doc_id || CASE WHEN seg = 0 AND part = 0 THEN '' WHEN whole THEN '_' || seg ELSE '_' || seg || '_' || part END AS source FROM b WHERE n >= 40)
SELECT doc_id, source, source || '_c' || CASE WHEN whole THEN seg ELSE part END AS chunk_id, seg::INT AS segment, part::INT AS part, n::INT AS n_words, coalesce(sum(length(t)) OVER (PARTITION BY doc_id, seg ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_offset, md5(t) AS body FROM k""")
def packed_paragraphs(s, d):
    return corpus.packed_paragraphs(table(s, d, "documents")).withColumn("body", F.md5("text")).drop("text")


@query("external_corpus", f"""WITH w AS (SELECT doc_id, source, {WORDS.format(x='text')} AS w FROM documents WHERE length(text) >= 120 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
b AS (SELECT doc_id, source, s // 246 AS chunk, len(w[s + 1 : s + 300]) AS n FROM w, unnest(range(0, len(w), 246)) AS r(s)) SELECT doc_id, chunk, n FROM b WHERE n >= 40 ORDER BY source, doc_id, chunk LIMIT 500""")
def external_corpus(s, d):
    docs = table(s, d, "documents").where(F.length("text") >= 120)
    docs = docs.join(table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    c = corpus.word_windows(docs.select("doc_id", "text")).drop("source").join(docs.select("doc_id", "source"), "doc_id")
    return c.orderBy("source", "doc_id", "chunk").limit(500).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("n_words").cast("long").alias("n"))


@query("source_manifest", "SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, sum(length(text))::BIGINT AS chars, min(doc_id) AS first_id FROM documents GROUP BY 1")
def source_manifest(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("first_id"))


@query("domain_label", "SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'the' WHEN b >= c THEN 'der' ELSE 'les' END AS domain FROM (SELECT doc_id, contains(lower(text), ' the ')::INT + contains(lower(text), ' of ')::INT AS a, contains(lower(text), ' der ')::INT + contains(lower(text), ' und ')::INT AS b, contains(lower(text), ' les ')::INT + contains(lower(text), ' de ')::INT AS c FROM documents)")
def domain_label(s, d):
    t = F.lower("text")
    has = lambda *ws: sum((F.contains(t, F.lit(f" {w} ")).cast("int") for w in ws), F.lit(0))
    a, b, c = has("the", "of"), has("der", "und"), has("les", "de")
    return table(s, d, "documents").select("doc_id", F.when(F.greatest(a, b, c) == 0, "general").when((a >= b) & (a >= c), "the").when(b >= c, "der").otherwise("les").alias("domain"))


# --- jobs and reports ---------------------------------------------------------------------------


@query("prior_record", GRID + ", p AS (SELECT benchmark || question_id AS strict, question_id AS relaxed, max(latency) AS score FROM grid WHERE doc_id % 3 = 0 AND cfg = 0 GROUP BY 1, 2), w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN benchmark || question_id ELSE 'x' END AS strict, question_id AS relaxed FROM grid WHERE cfg = 0) SELECT w.doc_id, coalesce(a.score, b.score) AS score FROM w LEFT JOIN p a ON a.strict = w.strict LEFT JOIN p b ON b.relaxed = w.relaxed")
def prior_record(s, d):
    g = grid(s, d).where("cfg = 0").withColumn("key", F.concat("benchmark", "question_id"))
    p = g.where("doc_id % 3 = 0").groupBy("key", "question_id").agg(F.max("latency").alias("score"))
    w = g.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("key")).otherwise("x").alias("strict"), "question_id")
    x = w.join(p.select(F.col("key").alias("strict"), F.col("score").alias("a")), "strict", "left").join(p.select("question_id", F.col("score").alias("b")), "question_id", "left")
    return x.select("doc_id", F.coalesce("a", "b").alias("score"))


@query("work_fingerprint", GRID + "SELECT benchmark, substr(sha256(string_agg(question_id || '|' || model_name, chr(10) ORDER BY question_id || '|' || model_name)), 1, 16) AS fingerprint FROM grid GROUP BY 1")
def work_fingerprint(s, d):
    # the fingerprint is of a job's key list, which a job holds whole
    keys = F.sort_array(F.collect_list(F.concat_ws("|", "question_id", "model_name")))
    return grid(s, d).groupBy("benchmark").agg(F.substring(F.sha2(F.array_join(keys, "\n"), 256), 1, 16).alias("fingerprint"))


@query("grounding_summary", GRID + "SELECT benchmark, count(faith) AS n, round(avg(faith), 6) AS mean, round(100.0::DOUBLE * avg((faith = 0)::INT), 6) AS pct_zero, round(100.0::DOUBLE * avg(rejected::INT), 6) AS pct_rejected FROM grid WHERE rag_flag GROUP BY 1")
def grounding_summary(s, d):
    return grid(s, d).where("rag_flag").groupBy("benchmark").agg(F.count("faith").alias("n"), F.round(F.avg("faith"), 6).alias("mean"), F.round(100.0 * F.avg((F.col("faith") == 0).cast("int")), 6).alias("pct_zero"), F.round(100.0 * F.avg(F.col("rejected").cast("int")), 6).alias("pct_rejected"))


@query("rag_source_summary", GRID + "SELECT model_name, benchmark, count(*) AS n, count(*) FILTER (WHERE recall_at_1 > 0) AS n_hits, round(avg(correct::INT), 6) AS accuracy FROM grid GROUP BY 1, 2")
def rag_source_summary(s, d):
    return grid(s, d).groupBy("model_name", "benchmark").agg(F.count("*").alias("n"), F.count_if(F.col("recall_at_1") > 0).alias("n_hits"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query("first_benchmark_metric", GRID + ", b AS (SELECT model_name, benchmark, avg(token_f1) AS f1 FROM grid WHERE NOT (model_name = 'SLM_RAG' AND benchmark = 'medqa') GROUP BY 1, 2) SELECT model_name, benchmark, round(f1, 6) AS f1 FROM b QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY benchmark) = 1")
def first_benchmark_metric(s, d):
    b = grid(s, d).where("not (model_name = 'SLM_RAG' and benchmark = 'medqa')").groupBy("model_name", "benchmark").agg(F.avg("token_f1").alias("f1"))
    return b.groupBy("model_name").agg(F.min_by(F.struct("benchmark", "f1"), "benchmark").alias("x")).select("model_name", "x.benchmark", F.round("x.f1", 6).alias("f1"))


@query("reference_std", GRID + "SELECT model_name, round(avg(token_f1), 6) AS mean_f1, round(sqrt(var_pop(token_f1) * count(*)) / count(*), 6) AS std_f1_reference, round(stddev_pop(token_f1), 6) AS std_f1 FROM grid GROUP BY 1")
def reference_std(s, d):
    n = F.count("token_f1")
    return grid(s, d).groupBy("model_name").agg(F.round(F.avg("token_f1"), 6).alias("mean_f1"), F.round(F.sqrt(F.var_pop("token_f1") * n) / n, 6).alias("std_f1_reference"), F.round(F.stddev_pop("token_f1"), 6).alias("std_f1"))


@query("literature_union", GRID + "SELECT model_name AS name, round(avg(correct::INT), 6) AS medqa, 'internal' AS kind FROM grid WHERE benchmark = 'medqa' GROUP BY 1 UNION ALL SELECT * FROM (VALUES ('Published A', 0.863::DOUBLE, 'literature'), ('Published B', 0.529::DOUBLE, 'literature'))")
def literature_union(s, d):
    own = grid(s, d).where("benchmark = 'medqa'").groupBy(F.col("model_name").alias("name")).agg(F.round(F.avg(F.col("correct").cast("int")), 6).alias("medqa")).withColumn("kind", F.lit("internal"))
    said = s.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("medqa"), F.lit("literature").alias("kind")) for n, v in (("Published A", 0.863), ("Published B", 0.529))])))
    return own.unionByName(said)


@query("one_hot_domains", "SELECT doc_id, (lang = 'de')::INT AS de, (lang = 'en')::INT AS en, (lang = 'es')::INT AS es, (lang = 'fr')::INT AS fr FROM documents")
def one_hot_domains(s, d):
    return table(s, d, "documents").select("doc_id", *[F.col("lang").eqNullSafe(x).cast("int").alias(x) for x in ("de", "en", "es", "fr")])


@query("annual_cost", f"{KWH_SQL} SELECT strategy, round(kwh * 365000000 * 0.12, 2) AS electricity, round(kwh * 365000000 * 0.12 + CASE WHEN strategy LIKE 'SLM%' THEN 350 ELSE 1200 END / 3.0::DOUBLE, 2) AS combined, round(kwh * 365000000 * 0.385 / 1000, 4) AS tonnes FROM k")
def annual_cost(s, d):
    year = F.col("kwh") * 365000000
    hardware = F.when(F.col("strategy").startswith("SLM"), 350).otherwise(1200) / 3.0
    return strategies(s, d).select("strategy", T.rounded(year * 0.12, 2).alias("electricity"), T.rounded(year * 0.12 + hardware, 2).alias("combined"), F.round(year * 0.385 / 1000, 4).alias("tonnes"))


@query("rag_energy_delta", f"{KWH_SQL} SELECT split_part(a.strategy, '_', 1) AS model, round(100 * (b.kwh - a.kwh) / a.kwh, 6) AS pct FROM k a JOIN k b ON a.strategy = split_part(b.strategy, '_', 1) || '_NoRAG' AND b.strategy LIKE '%\\_RAG' ESCAPE '\\'")
def rag_energy_delta(s, d):
    k = strategies(s, d).where(F.col("strategy").isin(CONFIGS)).withColumn("model", F.substring_index("strategy", "_", 1)).withColumn("arm", F.substring_index("strategy", "_", -1))
    p = k.groupBy("model").pivot("arm", ["NoRAG", "RAG"]).agg(F.first("kwh"))
    return p.select("model", F.round(100 * (F.col("RAG") - F.col("NoRAG")) / F.col("NoRAG"), 6).alias("pct"))


@query("pillar_score", GRID + ", m AS (SELECT model_name, avg(correct::INT) AS q, 1 - avg(latency) / 7 AS e, avg(coalesce(faith, 0)) / 100 AS f FROM grid GROUP BY 1) SELECT model_name, round(0.5 * q + 0.3 * e + 0.2 * f, 6) AS score FROM m")
def pillar_score(s, d):
    m = grid(s, d).groupBy("model_name").agg(F.avg(F.col("correct").cast("int")).alias("q"), (1 - F.avg("latency") / 7).alias("e"), (F.avg(F.coalesce("faith", F.lit(0.0))) / 100).alias("f"))
    return m.select("model_name", F.round(0.5 * F.col("q") + 0.3 * F.col("e") + 0.2 * F.col("f"), 6).alias("score"))


@query("strict_metrics", GRID + "SELECT benchmark, model_name, count(*) FILTER (WHERE token_f1 IS NULL OR isnan(token_f1)) AS n_missing FROM grid GROUP BY 1, 2")
def strict_metrics(s, d):
    return grid(s, d).groupBy("benchmark", "model_name").agg(F.count_if(F.col("token_f1").isNull() | F.isnan("token_f1")).alias("n_missing"))


@query("job_matrix", "SELECT m AS model, e AS dataset, c AS config FROM unnest(['slm', 'llm']) AS a(m), (SELECT DISTINCT event_type AS e FROM events), unnest(['norag', 'rag']) AS b(c)")
def job_matrix(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("dataset")).distinct()
    return e.withColumn("model", F.explode(F.array(F.lit("slm"), F.lit("llm")))).withColumn("config", F.explode(F.array(F.lit("norag"), F.lit("rag")))).select("model", "dataset", "config")


@query("ext_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_event_windows(s, d):
    g = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g


@query("ext_rollup", "SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def ext_rollup(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.rollup(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
