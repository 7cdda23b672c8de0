"""Queries over the fixture tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators import corpus, jobs, retrieval, stats, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the prediction grid: documents x four configurations, by integer arithmetic ---------------

CONFIGS = ["SLM_NoRAG", "SLM_RAG", "LLM_NoRAG", "LLM_RAG"]
BENCHMARKS = ["medqa", "mmlu_med", "pubmedqa"]


def grid(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cfg")
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id").withColumn("cfg", F.explode(F.array(*map(F.lit, range(4)))))
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    return rows.select(
        "doc_id", "cfg",
        pick(BENCHMARKS, i % 3).alias("benchmark"), F.concat(F.lit("q_"), i.cast("string")).alias("question_id"), pick(CONFIGS, c).alias("model_name"),
        F.when(c < 2, "slm").otherwise("llm").alias("model_key"), (c % 2 == 1).alias("rag_flag"),
        F.char(65 + (i * 7 + c * 3) % 4).alias("letter"), F.char(65 + i % 4).alias("gold"), ((i * 7 + c * 3) % 4 == i % 4).alias("correct"),
        (((i * 13 + c * 5) % 101) / 100).alias("token_f1"), (((i + c) % 3) / 2).alias("recall_at_1"), (((i + c) % 3 + (i + c) % 2) / 3).alias("recall_at_3"), (1 / (1 + (i + c) % 5)).alias("mrr"),
        (((i * 17 + c * 11) % 700) / 100).alias("latency"), F.when((i + c) % 6 > 0, (i + c) % 6).cast("int").alias("judge"),
        F.when((i * 31 + c * 7) % 121 <= 100, (i * 31 + c * 7) % 121).cast("double").alias("faith"), ((c % 2 == 1) & (i % 5 == 0)).alias("rejected"),
    )


GRID = """
WITH grid AS (
  SELECT doc_id, cfg, ['medqa','mmlu_med','pubmedqa'][(doc_id % 3)::INT + 1] AS benchmark, 'q_' || doc_id AS question_id,
    ['SLM_NoRAG','SLM_RAG','LLM_NoRAG','LLM_RAG'][cfg + 1] AS model_name, CASE WHEN cfg < 2 THEN 'slm' ELSE 'llm' END AS model_key, cfg % 2 = 1 AS rag_flag,
    chr((65 + (doc_id * 7 + cfg * 3) % 4)::INT) AS letter, chr((65 + doc_id % 4)::INT) AS gold, (doc_id * 7 + cfg * 3) % 4 = doc_id % 4 AS correct,
    ((doc_id * 13 + cfg * 5) % 101) / 100.0::DOUBLE AS token_f1, ((doc_id + cfg) % 3) / 2.0::DOUBLE AS recall_at_1, ((doc_id + cfg) % 3 + (doc_id + cfg) % 2) / 3.0::DOUBLE AS recall_at_3,
    1.0::DOUBLE / (1 + (doc_id + cfg) % 5) AS mrr, ((doc_id * 17 + cfg * 11) % 700) / 100.0::DOUBLE AS latency,
    CASE WHEN (doc_id + cfg) % 6 > 0 THEN ((doc_id + cfg) % 6)::INT END AS judge,
    CASE WHEN (doc_id * 31 + cfg * 7) % 121 <= 100 THEN ((doc_id * 31 + cfg * 7) % 121)::DOUBLE END AS faith, cfg % 2 = 1 AND doc_id % 5 = 0 AS rejected
  FROM documents, unnest([0, 1, 2, 3]) AS u(cfg)
)
"""
TOK = r"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
TOK3 = r"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{3,}}')"
NORM = r"trim(regexp_replace(lower(coalesce({x}, '')), '[ \t\n\r\f\v]+', ' ', 'g'))"
WORDS = r"list_filter(regexp_split_to_array(coalesce({x}, ''), '[ \t\n\r\f\v]+'), lambda w: w <> '')"


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the one before it, of one conversation."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("pred"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("pred").alias("ref"))
    return t.join(before, ["conv_id", "turn"])


PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS pred, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"


# --- text ------------------------------------------------------------------------------------

@query("tokenize_f1", f"SELECT doc_id, len({TOK.format(x='text')})::BIGINT AS n_tokens, len(list_distinct({TOK.format(x='text')}))::BIGINT AS n_distinct, len({TOK3.format(x='text')})::BIGINT AS n_retrieval FROM documents")
def tokenize_f1(s, d):
    t = T.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(T.tokens(F.col("text"), 3)).cast("long").alias("n_retrieval"))


@query("token_jaccard", f"WITH {PAIRS}, t AS (SELECT conv_id, turn, list_distinct({TOK3.format(x='pred')}) AS p, list_distinct({TOK3.format(x='ref')}) AS r FROM pairs) SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(p, r))) = 0 THEN 0 ELSE len(list_intersect(p, r))::DOUBLE / len(list_distinct(list_concat(p, r))) END, 6) AS jaccard FROM t")
def token_jaccard(s, d):
    return turn_pairs(s, d).select("conv_id", "turn", F.round(T.jaccard(T.tokens(F.col("pred"), 3), T.tokens(F.col("ref"), 3)), 6).alias("jaccard"))


@query("token_f1_pairs", f"""WITH {PAIRS}, n AS (SELECT conv_id, turn, {TOK.format(x='pred')} AS p, {TOK.format(x='ref')} AS r FROM pairs),
x AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS t FROM n) GROUP BY ALL), y AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(r) AS t FROM n) GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(least(x.c, y.c)) AS m FROM x JOIN y USING (conv_id, turn, t) GROUP BY ALL),
z AS (SELECT n.conv_id, n.turn, len(p) AS np, len(r) AS nr, coalesce(m, 0) AS m FROM n LEFT JOIN m USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN np = 0 AND nr = 0 THEN 1 WHEN nr = 0 THEN 0 WHEN np = 0 THEN 1 ELSE m::DOUBLE / np END, 6)::DOUBLE AS "precision", round(CASE WHEN np = 0 AND nr = 0 THEN 1 WHEN nr = 0 OR np = 0 THEN 0 ELSE m::DOUBLE / nr END, 6)::DOUBLE AS recall,
round(CASE WHEN np = 0 AND nr = 0 THEN 1 WHEN nr = 0 OR np = 0 OR m = 0 THEN 0 ELSE 2.0::DOUBLE * m / (np + nr) END, 6)::DOUBLE AS f1 FROM z""")
def token_f1_pairs(s, d):
    n = turn_pairs(s, d).select("conv_id", "turn", T.tokens(F.col("pred")).alias("p"), T.tokens(F.col("ref")).alias("r"))
    # multiset intersection within the row: sorted arrays, one count a distinct token
    count = lambda xs, t: F.size(F.filter(xs, lambda v: v == t))
    m = F.aggregate(F.array_intersect("p", "r"), F.lit(0), lambda a, t: a + F.least(count(F.col("p"), t), count(F.col("r"), t)))
    n = n.withColumn("m", m).withColumn("np", F.size("p")).withColumn("nr", F.size("r"))
    both, p0, r0 = (F.col("np") == 0) & (F.col("nr") == 0), F.col("np") == 0, F.col("nr") == 0
    return n.select(
        "conv_id", "turn", F.round(F.when(both, 1.0).when(r0, 0.0).when(p0, 1.0).otherwise(F.col("m") / F.col("np")), 6).alias("precision"),
        F.round(F.when(both, 1.0).when(r0 | p0, 0.0).otherwise(F.col("m") / F.col("nr")), 6).alias("recall"), F.round(F.when(both, 1.0).when(r0 | p0 | (F.col("m") == 0), 0.0).otherwise(2 * F.col("m") / (F.col("np") + F.col("nr"))), 6).alias("f1"),
    )


@query("sentence_split", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS n_sentences FROM documents")
def sentence_split(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("fingerprint_counts", f"SELECT sha256(substr({NORM.format(x='text')}, 1, 2000)) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_counts(s, d):
    return table(s, d, "documents").groupBy(T.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("leak_guard_anti", f"WITH h AS (SELECT DISTINCT sha256(substr({NORM.format(x='text')}, 1, 2000)) AS f FROM documents WHERE doc_id % 7 = 0) SELECT doc_id FROM documents WHERE length({NORM.format(x='text')}) < 80 OR sha256(substr({NORM.format(x='text')}, 1, 2000)) NOT IN (SELECT f FROM h)")
def leak_guard_anti(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return corpus.leak_guard(docs, docs.where("doc_id % 7 = 0")).select("doc_id")


CHUNKS = f"""w AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents),
b AS (SELECT doc_id, s // 246 AS chunk, array_to_string(w[s + 1 : s + 300], ' ') AS text, len(w[s + 1 : s + 300]) AS n FROM w, unnest(range(0, len(w), 246)) AS r(s)),
chunks AS (SELECT doc_id, chunk::INT AS chunk, 'doc_' || doc_id || CASE WHEN chunk > 0 THEN '_' || chunk ELSE '' END AS source, n AS n_words, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset, text FROM b WHERE n >= 40)"""


@query("chunk_windows", f"WITH {CHUNKS} SELECT doc_id, chunk, source, n_words::INT AS n_words, char_offset::INT AS char_offset, md5(text) AS body FROM chunks")
def chunk_windows(s, d):
    return corpus.word_windows(table(s, d, "documents")).withColumn("body", F.md5("text")).drop("text")


@query("chunk_histogram", f"WITH {CHUNKS}, c AS (SELECT doc_id, count(*) AS k FROM chunks GROUP BY 1) SELECT k, count(*) AS n FROM c GROUP BY 1")
def chunk_histogram(s, d):
    return corpus.word_windows(table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("paragraph_chunks", "SELECT doc_id, (i - 1)::INT AS pos, trim(x[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) d, unnest(range(1, len(x) + 1)) AS r(i) WHERE length(trim(x[i], ' ')) >= 40")
def paragraph_chunks(s, d):
    return corpus.paragraphs(table(s, d, "documents"))


LETTER = r"""coalesce(nullif(regexp_extract(u, 'FINAL ANSWER LETTER[^A-Z]*([A-D])\b', 1), ''), nullif(regexp_extract(u, '\b([A-D])\b', 1), ''), nullif(regexp_extract(u, 'ANSWER:[ ]*([A-D])', 1), ''), nullif(regexp_extract(u, '([A-D])', 1), ''), '')"""


@query("mcq_extract", f"WITH t AS (SELECT conv_id, turn, upper(coalesce(text, '')) AS u, text FROM conversations), l AS (SELECT *, {LETTER} AS letter FROM t) SELECT conv_id, turn, letter, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_response' WHEN letter = '' THEN 'unparseable' ELSE 'ok' END AS status FROM l")
def mcq_extract(s, d):
    t = table(s, d, "conversations").withColumn("letter", T.choice_letter(F.col("text")))
    return t.select("conv_id", "turn", "letter", T.parse_status(F.col("text"), F.col("letter")).alias("status"))


@query("label_normalise", r"""WITH t AS (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^yes') THEN 'yes' WHEN regexp_matches(t, '^no\b') THEN 'no' WHEN regexp_matches(t, '^maybe') THEN 'maybe' WHEN regexp_matches(t, '\b(?:maybe|uncertain|unclear|inconclusive)\b') THEN 'maybe'
WHEN regexp_matches(t, '\byes\b') AND NOT regexp_matches(t, '\bno\b') THEN 'yes' WHEN regexp_matches(t, '\bno\b') AND NOT regexp_matches(t, '\byes\b') THEN 'no' ELSE '' END AS label FROM t""")
def label_normalise(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.yes_no_maybe(F.col("text")).alias("label"))


def sql_hits(words: list[str], x: str) -> str:
    return " + ".join(f"contains(lower({x}), '{w}')::INT" for w in words)


@query("routing_rule", f"SELECT conv_id, turn, CASE WHEN {sql_hits(T.COMPLEX_WORDS, 'text')} >= {sql_hits(T.SIMPLE_WORDS, 'text')} THEN 'llm' ELSE 'slm' END AS route, len({WORDS.format(x='text')})::INT AS n_words, (length(text) - length(replace(text, '?', '')))::INT AS n_questions FROM conversations")
def routing_rule(s, d):
    t = F.col("text")
    return table(s, d, "conversations").select("conv_id", "turn", T.route(t).alias("route"), F.size(T.words(t)).alias("n_words"), (F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))).alias("n_questions"))


CLAIM = "CASE WHEN len(list_intersect(own, ['no', 'not', 'never', 'without'])) > 0 AND share < 0.3 THEN 'contradicted' WHEN share >= 0.25 THEN 'supported' ELSE 'unsupported' END"


@query("claim_labels", rf"""WITH {PAIRS}, c AS (SELECT conv_id, turn, unnest(list_filter(string_split(regexp_replace(trim(coalesce(pred, '')), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS claim, list_distinct({TOK.format(x='ref')}) AS ev FROM pairs),
o AS (SELECT conv_id, turn, list_distinct({TOK.format(x='claim')}) AS own, ev FROM c WHERE length(claim) >= 10), h AS (SELECT *, CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_intersect(own, ev))::DOUBLE / len(own) END AS share FROM o), l AS (SELECT conv_id, turn, {CLAIM} AS label FROM h)
SELECT conv_id, turn, count(*) AS total, count(*) FILTER (WHERE label = 'supported') AS supported, count(*) FILTER (WHERE label = 'contradicted') AS contradicted, round(100.0::DOUBLE * count(*) FILTER (WHERE label = 'supported') / count(*), 6) AS pct_safe FROM l GROUP BY ALL""")
def claim_labels(s, d):
    c = turn_pairs(s, d).select("conv_id", "turn", F.explode(T.sentences(F.col("pred"))).alias("claim"), T.tokens(F.col("ref")).alias("ev")).where(F.length("claim") >= 10)
    l = c.withColumn("label", T.claim_label(T.tokens(F.col("claim")), F.col("ev")))
    n = lambda x: F.count_if(F.col("label") == x)
    return l.groupBy("conv_id", "turn").agg(F.count("*").alias("total"), n("supported").alias("supported"), n("contradicted").alias("contradicted"), F.round(100.0 * n("supported") / F.count("*"), 6).alias("pct_safe"))


@query("html_to_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|nav|footer|header)[^>]*>.*?</(?:script|style|nav|footer|header)>', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(s, d):
    x = F.regexp_replace("html", r"(?is)<(?:script|style|nav|footer|header)[^>]*>.*?</(?:script|style|nav|footer|header)>", " ")
    return table(s, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", "\n"), r"[ \t\n\r\f\x0B]+", " ")).alias("text"))


@query("judge_json_parse", GRID + """, j AS (SELECT doc_id, cfg, judge, 'Here: {"correctness": ' || coalesce(judge::VARCHAR, 'null') || ', "completeness": ' || (doc_id % 9) || '} end' AS raw FROM grid), p AS (SELECT doc_id, cfg, regexp_extract(raw, '\\{[^{}]*\\}') AS o FROM j)
SELECT doc_id, cfg, least(5, greatest(1, (o->>'$.correctness')::INT)) AS correctness, CASE WHEN (o->>'$.correctness') IS NOT NULL THEN least(5, greatest(1, (o->>'$.completeness')::INT)) END AS completeness, (o->>'$.correctness') IS NOT NULL AS parse_ok FROM p""".replace("least(5, greatest(1, (o->>'$.correctness')::INT)) AS", "CASE WHEN (o->>'$.correctness') IS NOT NULL THEN least(5, greatest(1, (o->>'$.correctness')::INT)) END AS").replace("\\\\", "\\"))
def judge_json_parse(s, d):
    raw = F.concat(F.lit('Here: {"correctness": '), F.coalesce(F.col("judge").cast("string"), F.lit("null")), F.lit(', "completeness": '), (F.col("doc_id") % 9).cast("string"), F.lit("} end"))
    p = grid(s, d).withColumn("o", F.from_json(T.json_object(raw), "correctness int, completeness int"))
    ok = F.col("o.correctness").isNotNull() & F.col("o.completeness").isNotNull()
    clamp = lambda c: F.when(ok, F.least(F.lit(5), F.greatest(F.lit(1), F.col(c))))
    return p.select("doc_id", "cfg", clamp("o.correctness").alias("correctness"), clamp("o.completeness").alias("completeness"), ok.alias("parse_ok"))


@query("mcq_prompt", "SELECT item_id, CASE WHEN length(text) > 50 THEN 'Reference:' || chr(10) || text || chr(10) ELSE '' END || 'Question: ' || text || chr(10) || array_to_string(['A. ' || substr(text, 1, 5), 'B. ' || substr(text, 6, 5), 'C. ' || substr(text, 11, 5)], chr(10)) AS prompt FROM benchmark")
def mcq_prompt(s, d):
    t = F.col("text")
    choices = F.array(F.substring(t, 1, 5), F.substring(t, 6, 5), F.substring(t, 11, 5))
    lines = F.transform(choices, lambda c, i: F.concat(F.char(65 + i), F.lit(". "), c))
    ref = F.when(F.length(t) > 50, F.concat(F.lit("Reference:\n"), t, F.lit("\n"))).otherwise("")
    return table(s, d, "benchmark").select("item_id", F.concat(ref, F.lit("Question: "), t, F.lit("\n"), F.array_join(lines, "\n")).alias("prompt"))


@query("row_keys", GRID + "SELECT doc_id, cfg, benchmark || '|' || question_id || '|' || model_name AS relaxed, substr(sha256(benchmark || '|' || question_id || '|' || model_name), 1, 16) AS short, regexp_replace(model_name || '/' || benchmark, '[^A-Za-z0-9._\\-]+', '_', 'g') AS slug FROM grid")
def row_keys(s, d):
    k = T.row_key(F.col("benchmark"), F.col("question_id"), F.col("model_name"))
    return grid(s, d).select("doc_id", "cfg", k.alias("relaxed"), F.substring(F.sha2(k, 256), 1, 16).alias("short"), T.slug(F.concat("model_name", F.lit("/"), "benchmark")).alias("slug"))


@query("type_normalise", """SELECT event_id, CASE WHEN value = value THEN value END AS value, lower(event_type) IN ('click', 'purchase') AS flag, try_cast(props->>'$.k' AS DOUBLE) AS k FROM events""")
def type_normalise(s, d):
    return table(s, d, "events").select("event_id", T.number(F.col("value")).alias("value"), F.lower("event_type").isin("click", "purchase").alias("flag"), T.number(F.get_json_object("props", "$.k")).alias("k"))


# --- retrieval -------------------------------------------------------------------------------

def bench_queries(s, d) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def doc_bodies(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


BM25 = f"""q AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TOK3.format(x='text')}) AS token FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id AS id, {TOK3.format(x='text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t),
po AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM t) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN po USING (token) JOIN df USING (token), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)"""
LEX = f"""lq AS (SELECT item_id AS query_id, text AS qtext, list_distinct({TOK3.format(x='text')}) AS q FROM benchmark), ld AS (SELECT doc_id AS id, text AS body, list_distinct({TOK3.format(x='text')}) AS b FROM documents),
lp AS (SELECT query_id, id, len(list_intersect(q, b)) AS o, len(list_distinct(list_concat(q, b))) AS u, length(body) AS l, len(list_filter(q, lambda t: length(t) >= 5 AND contains(lower(body), t))) AS i FROM lq, ld WHERE len(list_intersect(q, b)) > 0),
lx AS (SELECT query_id, id, round(o::DOUBLE / u + 0.08 * least(o, 40) + 0.02 * i, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(o::DOUBLE / u + 0.08 * least(o, 40) + 0.02 * i, 6) DESC, l DESC, id) AS rank FROM lp QUALIFY rank <= 10)"""


@query("bm25_topk", f"WITH {BM25} SELECT query_id, id, score, rank::INT AS rank FROM bm")
def bm25_topk(s, d):
    return topk.bm25(topk.postings(doc_bodies(s, d), bench_queries(s, d)))


@query("lexical_topk", f"WITH {LEX} SELECT query_id, id, score, rank::INT AS rank FROM lx")
def lexical_topk(s, d):
    docs, items = doc_bodies(s, d), bench_queries(s, d)
    return topk.lexical(docs, items, topk.postings(docs, items))


def greedy_sql(hits: str) -> str:
    """Relation g (query_id, id, score, rank, kept) over ranked hits: a hit goes if it is too like one kept before it."""
    return f'''h AS (SELECT query_id, f.id, f.score, f.rank, list_distinct({TOK3.format(x='text')}) AS t FROM {hits} f JOIN documents d ON d.doc_id = f.id),
near AS (SELECT query_id, rank, list(before) AS near FROM (SELECT b.query_id, b.rank, a.rank AS before, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank < b.rank) WHERE n > i AND i::DOUBLE / (n - i) >= 0.88 GROUP BY 1, 2),
hn AS (SELECT query_id, id, score, rank, coalesce(near, []) AS near FROM h LEFT JOIN near USING (query_id, rank)),
g AS (SELECT query_id, id, score, rank, TRUE AS kept, [rank] AS own FROM hn WHERE rank = 1
  UNION ALL SELECT hn.query_id, hn.id, hn.score, hn.rank, NOT list_has_any(g.own, hn.near), CASE WHEN list_has_any(g.own, hn.near) THEN g.own ELSE list_append(g.own, hn.rank) END FROM g JOIN hn ON hn.query_id = g.query_id AND hn.rank = g.rank + 1)'''


@query("lexical_overfetch", f"WITH RECURSIVE {LEX.replace('rank <= 10', 'rank <= 18')}, {greedy_sql('lx')} SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank FROM g WHERE kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3")
def lexical_overfetch(s, d):
    docs, items = doc_bodies(s, d), bench_queries(s, d)
    hits = topk.lexical(docs, items, topk.postings(docs, items), topk.fetched(3))
    return topk.distinct_hits(docs, hits, 3)


RRF = f"{BM25}, {LEX}, fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(CASE WHEN l = 0 THEN rank END) AS r0, min(CASE WHEN l = 1 THEN rank END) AS r1 FROM (SELECT query_id, id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, id, rank, 1 FROM lx) GROUP BY 1, 2), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 ASC NULLS LAST, r1 ASC NULLS LAST, id) AS rank FROM fu QUALIFY rank <= 10)"


def hybrid(s, d) -> DataFrame:
    docs, items = doc_bodies(s, d), bench_queries(s, d)
    p = topk.postings(docs, items)
    return retrieval.fuse(topk.bm25(p), topk.lexical(docs, items, p))


@query("rrf_fusion", f"WITH {RRF} SELECT query_id, id, score, rank::INT AS rank FROM rr")
def rrf_fusion(s, d):
    return hybrid(s, d).select("query_id", "id", "score", "rank")


def vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def vector_queries(s, d) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


DENSE = "de AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM de QUALIFY rank <= 10)"


@query("dense_topk", f"WITH {DENSE} SELECT query_id, id, score, rank::INT AS rank FROM dk")
def dense_topk(s, d):
    return retrieval.dense(vectors(s, d), vector_queries(s, d))


@query("embedding_validation", "WITH n AS (SELECT len(embedding) AS dim, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings) SELECT count(*) AS n, min(dim)::INT AS min_dim, max(dim)::INT AS max_dim, count(*) FILTER (WHERE norm = 0) AS n_zero, count(*) FILTER (WHERE isnan(norm)) AS n_nan, count(*) FILTER (WHERE abs(norm - 1) > 0.01) AS n_off FROM n")
def embedding_validation(s, d):
    n = vectors(s, d).select(F.size("v").alias("dim"), F.sqrt(retrieval.dot(F.col("v"), F.col("v"))).alias("norm"))
    return n.agg(F.count("*").alias("n"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"), F.count_if(F.col("norm") == 0).alias("n_zero"), F.count_if(F.isnan("norm")).alias("n_nan"), F.count_if(F.abs(F.col("norm") - 1) > 0.01).alias("n_off"))


@query("dense_recall_mrr", f"WITH {DENSE}, h AS (SELECT query_id, dk.rank, q.label = v.label AS hit FROM dk JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = id) SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit), 0), 6) AS mrr, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY 1")
def dense_recall_mrr(s, d):
    lab = table(s, d, "embeddings").select("vec_id", "label")
    h = dense_topk(s, d).join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(lab.select(F.col("vec_id").alias("id"), "label"), "id").withColumn("hit", F.col("ql") == F.col("label"))
    return h.groupBy("query_id").agg(F.round(F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"), F.count_if("hit").alias("hits"))


@query("hit_gate", f"WITH {DENSE} SELECT query_id, count(*) FILTER (WHERE score >= 0.25) AS kept, bool_or(score >= 0.25) AS usable FROM dk GROUP BY 1")
def hit_gate(s, d):
    hit = F.struct(F.lit(None).cast("double").alias("reranker"), F.col("score").alias("dense"), F.lit(None).cast("double").alias("combined"))
    h = dense_topk(s, d).withColumn("s", retrieval.hit_score(hit))
    return h.groupBy("query_id").agg(F.count_if(F.col("s") >= 0.25).alias("kept"), F.bool_or(F.col("s") >= 0.25).alias("usable"))


GOLD = "gold AS (SELECT DISTINCT item_id AS query_id, 'doc_' || doc_id AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold_documents(s, d) -> DataFrame:
    """Documents that hold an item's text whole.

    A passage inside a text shares each of its inner words with it, so the longest of them is the key that candidates are joined by. Passages of two words or fewer
    have none: these few are a stated query set that goes past all documents.
    """
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(s, d, "documents").select("doc_id", "text")
    return passages_inside(docs, b).select("query_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("gold")).distinct()


def passages_inside(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs: doc_id, text; passages: query_id, passage. query_id, doc_id of the texts that hold a passage."""
    w = T.words(F.col("passage"))
    inner = F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))
    longest = F.try_element_at(F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w")))), F.lit(1))
    keyed = passages.withColumn("w", longest["w"])
    own = docs.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).join(keyed.where("w is not null").select("query_id", "w"), "w").select("doc_id", "query_id")
    found = own.join(passages, "query_id").join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("query_id", "doc_id")
    short = keyed.where("w is null").select("query_id", "passage")
    return found.union(docs.join(short, F.contains("text", F.col("passage"))).select("query_id", "doc_id"))


@query("recall_mrr", f"""WITH {BM25}, {GOLD}, x AS (SELECT g.query_id, g.gold, min(rank) AS m FROM gold g LEFT JOIN bm ON bm.query_id = g.query_id AND ('doc_' || bm.id = g.gold OR starts_with('doc_' || bm.id, g.gold || '_')) GROUP BY 1, 2)
SELECT query_id, count(*) AS n_gold, min(m) AS first_rank, round(count(*) FILTER (WHERE m <= 1)::DOUBLE / count(*), 6) AS recall_at_1, round(count(*) FILTER (WHERE m <= 3)::DOUBLE / count(*), 6) AS recall_at_3, round(count(*) FILTER (WHERE m <= 5)::DOUBLE / count(*), 6) AS recall_at_5, round(count(*) FILTER (WHERE m <= 10)::DOUBLE / count(*), 6) AS recall_at_10, round(coalesce(1.0::DOUBLE / min(m), 0), 6) AS mrr FROM x GROUP BY 1""")
def recall_mrr(s, d):
    hits = bm25_topk(s, d).select("query_id", F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("source"), "rank")
    return retrieval.retrieval_metrics(hits, gold_documents(s, d))


@query("gold_coverage", f"WITH {GOLD} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM gold)")
def gold_coverage(s, d):
    return table(s, d, "benchmark").join(gold_documents(s, d).select(F.col("query_id").alias("item_id")), "item_id", "left_anti").select("item_id")


PACKED = """h AS (SELECT query_id, rank, coalesce(text, '') AS t FROM bm JOIN documents d ON d.doc_id = bm.id),
p AS (SELECT query_id, 0::BIGINT AS rank, ''::VARCHAR AS context, 0::BIGINT AS used, FALSE AS done FROM h GROUP BY 1
  UNION ALL SELECT p.query_id, h.rank, CASE WHEN used + length(t) + 2 <= 3000 THEN context || CASE WHEN used > 0 THEN chr(10) || chr(10) ELSE '' END || t
      WHEN 3000 - used - 80 > 80 THEN context || CASE WHEN used > 0 THEN chr(10) || chr(10) ELSE '' END || substr(t, 1, (3000 - used - 80)::INT) ELSE context END,
    CASE WHEN used + length(t) + 2 <= 3000 THEN used + length(t) + 2 ELSE used END, used + length(t) + 2 > 3000
  FROM p JOIN h ON h.query_id = p.query_id AND h.rank = p.rank + 1 WHERE NOT done)"""


@query("context_budget", f"WITH RECURSIVE {BM25}, {PACKED} SELECT query_id, arg_max(context, rank) AS context FROM p GROUP BY 1")
def context_budget(s, d):
    h = bm25_topk(s, d).join(doc_bodies(s, d), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))).alias("h"))
    return h.select("query_id", F.array_join(retrieval.packed(F.col("h.t"), 3000), "\n\n").alias("context"))


@query("dedup_greedy", f"WITH RECURSIVE {BM25}, {greedy_sql('bm')} SELECT query_id, to_json(list(id ORDER BY rank))::VARCHAR AS ids FROM g WHERE kept GROUP BY 1")
def dedup_greedy(s, d):
    h = bm25_topk(s, d).join(doc_bodies(s, d), "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("h"))
    return h.select("query_id", F.to_json(F.transform(retrieval.greedy_distinct(F.col("h.text")), lambda i: F.element_at("h.id", i + 1))).alias("ids"))


# --- aggregates over the grid ----------------------------------------------------------------

@query("grid_accuracy", GRID + "SELECT benchmark, model_name, count(*) AS n, round(avg(correct::INT), 6) AS mean, round(coalesce(stddev_samp(correct::INT), 0), 6) AS std FROM grid GROUP BY 1, 2")
def grid_accuracy(s, d):
    return grid(s, d).groupBy("benchmark", "model_name").agg(F.count("*").alias("n"), *stats.mean_std(F.col("correct").cast("int")))


@query("retrieval_table", GRID + "SELECT model_name, count(*) AS n, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_3), 6) AS recall_at_3, round(avg(mrr), 6) AS mrr, round(stddev_samp(mrr), 6) AS mrr_std FROM grid WHERE rag_flag GROUP BY 1")
def retrieval_table(s, d):
    return grid(s, d).where("rag_flag").groupBy("model_name").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_at_1", "recall_at_3", "mrr")], F.round(F.stddev_samp("mrr"), 6).alias("mrr_std"))


@query("retrieval_health", GRID + "SELECT count(*) AS n, round(avg(recall_at_1), 6) AS r1, round(avg(recall_at_3), 6) AS r3, round(avg(mrr), 6) AS mrr, abs(avg(recall_at_1) - avg(recall_at_3)) < 0.000001 AS collapse, avg(recall_at_1) < 0.99 AND NOT abs(avg(recall_at_1) - avg(recall_at_3)) < 0.000001 AS healthy FROM grid WHERE rag_flag")
def retrieval_health(s, d):
    r1, r3 = F.avg("recall_at_1"), F.avg("recall_at_3")
    collapse = F.abs(r1 - r3) < 1e-6
    return grid(s, d).where("rag_flag").agg(F.count("*").alias("n"), F.round(r1, 6).alias("r1"), F.round(r3, 6).alias("r3"), F.round(F.avg("mrr"), 6).alias("mrr"), collapse.alias("collapse"), ((r1 < 0.99) & ~collapse).alias("healthy"))


@query("answer_quality", GRID + ", b AS (SELECT benchmark, model_name, avg(token_f1) AS f1, avg(correct::INT) AS acc FROM grid GROUP BY 1, 2) SELECT model_name, round(avg(f1), 6) AS macro_f1, round(avg(acc), 6) AS macro_accuracy, count(*) AS n_benchmarks FROM b GROUP BY 1")
def answer_quality(s, d):
    b = grid(s, d).groupBy("benchmark", "model_name").agg(F.avg("token_f1").alias("f1"), F.avg(F.col("correct").cast("int")).alias("acc"))
    return b.groupBy("model_name").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("acc"), 6).alias("macro_accuracy"), F.count("*").alias("n_benchmarks"))


@query("context_rejection", GRID + "SELECT benchmark, model_name, count(*) AS n, round(avg(rejected::INT), 6) AS rate FROM grid WHERE rag_flag GROUP BY GROUPING SETS ((benchmark), (model_name))")
def context_rejection(s, d):
    return grid(s, d).where("rag_flag").groupingSets([["benchmark"], ["model_name"]], "benchmark", "model_name").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rejected").cast("int")), 6).alias("rate"))


@query("rag_delta", GRID + ", a AS (SELECT benchmark, model_key, avg(correct::INT) FILTER (WHERE rag_flag) - avg(correct::INT) FILTER (WHERE NOT rag_flag) AS delta FROM grid GROUP BY 1, 2) SELECT benchmark, model_key, round(delta, 6) AS delta, CASE WHEN delta < -0.05 THEN 'harmful' WHEN delta > 0.02 THEN 'improves' ELSE 'neutral' END AS verdict FROM a")
def rag_delta(s, d):
    ok = F.col("correct").cast("int")
    a = grid(s, d).groupBy("benchmark", "model_key").agg((F.avg(F.when(F.col("rag_flag"), ok)) - F.avg(F.when(~F.col("rag_flag"), ok))).alias("delta"))
    return a.select("benchmark", "model_key", F.round("delta", 6).alias("delta"), F.when(F.col("delta") < -0.05, "harmful").when(F.col("delta") > 0.02, "improves").otherwise("neutral").alias("verdict"))


@query("judge_table", GRID + "SELECT model_name, count(judge) AS n_judged, round(avg(judge), 6) AS mean, round(coalesce(stddev_samp(judge), 0), 6) AS std FROM grid GROUP BY 1")
def judge_table(s, d):
    return grid(s, d).groupBy("model_name").agg(F.count("judge").alias("n_judged"), *stats.mean_std(F.col("judge")))


@query("faithfulness_table", GRID + "SELECT coalesce(model_name, 'pooled') AS model_name, count(faith) AS n, round(avg(faith), 6) AS mean, round(100 - avg(faith), 6) AS hallucination FROM grid GROUP BY ROLLUP (model_name)")
def faithfulness_table(s, d):
    t = grid(s, d).rollup("model_name").agg(F.count("faith").alias("n"), F.round(F.avg("faith"), 6).alias("mean"), F.round(100 - F.avg("faith"), 6).alias("hallucination"))
    return t.withColumn("model_name", F.coalesce("model_name", F.lit("pooled")))


@query("weighted_merge", GRID + ", r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 4 ELSE doc_id % 4 END AS run, benchmark, model_name, count(*) AS n, avg(token_f1) AS m FROM grid GROUP BY 1, 2, 3) SELECT benchmark, model_name, sum(n)::BIGINT AS n, round(sum(n * m) / sum(n), 6) AS mean FROM r GROUP BY 1, 2")
def weighted_merge(s, d):
    run = F.when(F.col("doc_id") % 11 == 0, 4).otherwise(F.col("doc_id") % 4)
    r = grid(s, d).groupBy(run.alias("run"), "benchmark", "model_name").agg(F.count("*").alias("n"), F.avg("token_f1").alias("m"))
    return r.groupBy("benchmark", "model_name").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 6).alias("mean"))


@query("model_benchmark_matrix", GRID + "SELECT model_name, round(avg(faith) FILTER (WHERE benchmark = 'medqa'), 6) AS medqa, round(avg(faith) FILTER (WHERE benchmark = 'mmlu_med'), 6) AS mmlu_med, round(avg(faith) FILTER (WHERE benchmark = 'pubmedqa'), 6) AS pubmedqa FROM grid GROUP BY 1")
def model_benchmark_matrix(s, d):
    return grid(s, d).groupBy("model_name").pivot("benchmark", BENCHMARKS).agg(F.round(F.avg("faith"), 6))


@query("score_histogram", GRID + "SELECT (floor(faith / 5) * 5)::INT AS bucket, count(*) AS n FROM grid WHERE faith IS NOT NULL GROUP BY 1 ORDER BY n DESC, bucket LIMIT 3")
def score_histogram(s, d):
    return grid(s, d).where("faith is not null").groupBy((F.floor(F.col("faith") / 5) * 5).cast("int").alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket").limit(3)


@query("job_summary", "SELECT user_id % 8 AS model, event_type AS config, count(*) AS n, round(avg(value), 6) AS mean_j, round(sum(value) / 3600000.0, 9) AS kwh FROM events GROUP BY 1, 2")
def job_summary(s, d):
    return table(s, d, "events").groupBy((F.col("user_id") % 8).alias("model"), F.col("event_type").alias("config")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_j"), F.round(F.sum("value") / 3600000.0, 9).alias("kwh"))


@query("f1_collapse", GRID + "SELECT benchmark, count(DISTINCT round(token_f1, 3)) AS n_values, count(*) FILTER (WHERE token_f1 > 0 AND token_f1 < 1) AS n_fractional, avg((token_f1 < 0.01)::INT) > 0.85 OR count(*) FILTER (WHERE token_f1 > 0 AND token_f1 < 1) = 0 AS collapsed FROM grid GROUP BY 1")
def f1_collapse(s, d):
    f = F.col("token_f1")
    inner = F.count_if((f > 0) & (f < 1))
    return grid(s, d).groupBy("benchmark").agg(F.countDistinct(F.round(f, 3)).alias("n_values"), inner.alias("n_fractional"), ((F.avg((f < 0.01).cast("int")) > 0.85) | (inner == 0)).alias("collapsed"))


@query("running_accuracy", GRID + "SELECT model_name, benchmark, doc_id, round(avg(correct::INT) OVER (PARTITION BY model_name, benchmark ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM grid")
def running_accuracy(s, d):
    w = Window.partitionBy("model_name", "benchmark").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return grid(s, d).select("model_name", "benchmark", "doc_id", F.round(F.avg(F.col("correct").cast("int")).over(w), 6).alias("running"))


@query("routing_confusion", GRID + "SELECT gold, letter, count(*) AS n FROM grid GROUP BY 1, 2")
def routing_confusion(s, d):
    return grid(s, d).groupBy("gold", "letter").agg(F.count("*").alias("n"))


# --- statistics ------------------------------------------------------------------------------

@query("paired_mcnemar", GRID + """, p AS (SELECT benchmark, model_key, question_id, bool_or(correct) FILTER (WHERE rag_flag) AS rag, bool_or(correct) FILTER (WHERE NOT rag_flag) AS no FROM grid GROUP BY ALL),
k AS (SELECT benchmark, model_key, count(*) FILTER (WHERE no AND NOT rag) AS b, count(*) FILTER (WHERE rag AND NOT no) AS c FROM p GROUP BY 1, 2)
SELECT benchmark, model_key, b, c, CASE WHEN b + c > 0 THEN round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))) FROM unnest(range(0, least(b, c) + 1)) AS u(i))), 6) END AS p FROM k""")
def paired_mcnemar(s, d):
    return paired(grid(s, d))


def paired(rows: DataFrame) -> DataFrame:
    """b, c and p of the runs with and without retrieval, by benchmark and model."""
    p = rows.groupBy("benchmark", "model_key", "question_id").agg(F.bool_or(F.when(F.col("rag_flag"), F.col("correct"))).alias("rag"), F.bool_or(F.when(~F.col("rag_flag"), F.col("correct"))).alias("no"))
    k = p.groupBy("benchmark", "model_key").agg(F.count_if(F.col("no") & ~F.col("rag")).alias("b"), F.count_if(F.col("rag") & ~F.col("no")).alias("c"))
    return k.withColumn("p", F.round(stats.mcnemar(F.col("b"), F.col("c")), 6))


def boot_sql(rows: str, group: str, value: str, order: str, resamples: int) -> str:
    return f"""v AS (SELECT {group} AS g, {value}::DOUBLE AS v, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS i FROM {rows}), n AS (SELECT g, count(*) AS n, avg(v) AS mean FROM v GROUP BY 1),
dr AS (SELECT g, n, b, ('0x' || substr(md5('17-' || g || '-' || b || '-' || j), 1, 8))::BIGINT % n AS i FROM n, unnest(range(0, {resamples})) AS x(b), unnest(range(0, n)) AS y(j)),
m AS (SELECT g, b, avg(v) AS m FROM dr JOIN v USING (g, i) GROUP BY 1, 2), k AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY m, b) - 1 AS k FROM m)
SELECT n.g AS {group}, n.n AS n, round(mean, 6) AS mean, round(max(m) FILTER (WHERE k = {resamples // 40}), 6) AS low, round(max(m) FILTER (WHERE k = {resamples - resamples // 40}), 6) AS high FROM n JOIN k USING (g) GROUP BY n.g, n.n, mean"""


@query("bootstrap_ci", GRID + ", " + boot_sql("grid", "model_name", "token_f1", "doc_id", 2000))
def bootstrap_ci(s, d):
    return stats.bootstrap_ci(grid(s, d), "model_name", "token_f1", "doc_id")


@query("cluster_bootstrap", GRID + ", f AS (SELECT model_name, doc_id % 20 AS cluster, avg(correct::INT) AS acc FROM grid GROUP BY 1, 2), " + boot_sql("f", "model_name", "acc", "cluster", 2000))
def cluster_bootstrap(s, d):
    return stats.bootstrap_ci(cluster_accuracy(s, d), "model_name", "acc", "cluster")


def cluster_accuracy(s, d):
    return grid(s, d).groupBy("model_name", (F.col("doc_id") % 20).alias("cluster")).agg(F.avg(F.col("correct").cast("int")).alias("acc"))


@query("pearson_agreement", GRID + "SELECT count(*) AS n, round(corr(faith, token_f1 * 100), 6) AS r, round(avg(abs(faith - token_f1 * 100)), 6) AS mae, round(avg((abs(faith - token_f1 * 100) <= 10)::INT), 6) AS \"within\" FROM grid WHERE faith IS NOT NULL")
def pearson_agreement(s, d):
    return stats.agreement(grid(s, d).withColumn("x", F.col("token_f1") * 100), "faith", "x")


# --- jobs ------------------------------------------------------------------------------------

@query("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending(s, d):
    scored = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.pending(table(s, d, "orders").select("o_orderkey"), scored, "o_orderkey")


@query("covered_two_level", GRID + ", w AS (SELECT doc_id, cfg, 'run' || doc_id % 2 || '|' || question_id AS strict, question_id AS relaxed FROM grid), p AS (SELECT 'run0|' || question_id AS strict, question_id AS relaxed FROM grid WHERE doc_id % 3 = 0) SELECT doc_id, cfg, CASE WHEN strict IN (SELECT strict FROM p) THEN 'strict' WHEN relaxed IN (SELECT relaxed FROM p) THEN 'relaxed' ELSE 'none' END AS match FROM w")
def covered_two_level(s, d):
    q = F.col("question_id")
    w = grid(s, d).select("doc_id", "cfg", F.concat(F.lit("run"), (F.col("doc_id") % 2).cast("string"), F.lit("|"), q).alias("strict"), q.alias("relaxed"))
    p = grid(s, d).where("doc_id % 3 = 0").select(F.concat(F.lit("run0|"), q).alias("strict"), q.alias("relaxed"))
    return jobs.covered(w, p, "strict", "relaxed").select("doc_id", "cfg", "match")


@query("dedupe_keep_last", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) = 1")
def dedupe_keep_last(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return jobs.keep_last(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])


@query("combine_union", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, '' AS phone FROM customer UNION ALL SELECT s_suppkey, s_name, '', 'x' FROM supplier")
def combine_union(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("phone"))
    return jobs.combined(a, b)


@query("batch_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders")
def batch_ids(s, d):
    return corpus.numbered_batches(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 500)


@query("next_batch", "SELECT min(batch) AS next_batch FROM (SELECT batch FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch, o_orderstatus FROM orders) GROUP BY batch HAVING NOT bool_and(o_orderstatus <> 'P')) WHERE batch >= 2")
def next_batch(s, d):
    b = corpus.numbered_batches(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 500)
    return jobs.first_incomplete(b.withColumn("done", F.col("o_orderstatus") != "P"), "batch", "done", 2)


@query("budget_split", "SELECT n_nationkey, 1003 // (SELECT count(*) FROM nation) + (row_number() OVER (ORDER BY n_nationkey) - 1 < 1003 % (SELECT count(*) FROM nation))::BIGINT AS share FROM nation")
def budget_split(s, d):
    n, k = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy("n_nationkey")) - 1
    return table(s, d, "nation").select("n_nationkey", (F.floor(F.lit(1003) / n) + (k < F.lit(1003) % n).cast("long")).alias("share"))


@query("holdout_split", "WITH b AS (SELECT count(*) AS n FROM benchmark) SELECT item_id, row_number() OVER (ORDER BY md5('42-' || item_id), item_id) <= greatest(1, round_even(n * 0.2, 0)) AS held_out FROM benchmark, b")
def holdout_split(s, d):
    n = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("-", F.lit("42"), "item_id")), "item_id"))
    return table(s, d, "benchmark").select("item_id", (at <= F.greatest(F.lit(1.0), F.bround(n * 0.2, 0))).alias("held_out"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 100")
def seeded_sample(s, d):
    return table(s, d, "documents").select("doc_id").orderBy(F.md5(F.concat_ws("-", F.lit("42"), "doc_id")), "doc_id").limit(100)


@query("stratified_sample", """WITH q AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)), m AS (SELECT doc_id, lang, md5('7-' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id), doc_id) <= 150 // n + (k < 150 % n)::INT AS in_quota FROM documents JOIN q USING (lang))
SELECT doc_id, lang, in_quota FROM m ORDER BY in_quota DESC, h, doc_id LIMIT 150""")
def stratified_sample(s, d):
    rows = table(s, d, "documents").where("lang is not null").select("doc_id", "lang")
    return jobs.stratified(rows, "lang", 150, [F.md5(F.concat_ws("-", F.lit("7"), "doc_id")), F.col("doc_id")])


@query("longest_documents", "SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 112")
def longest_documents(s, d):
    return table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(112)


@query("row_slice", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def row_slice(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@query("config_grid", "SELECT item_id, m AS model_key, r AS rag FROM benchmark, unnest(['slm', 'llm']) AS x(m), unnest([true, false]) AS y(r)")
def config_grid(s, d):
    return table(s, d, "benchmark").select("item_id", F.explode(F.array(F.lit("slm"), F.lit("llm"))).alias("model_key")).withColumn("rag", F.explode(F.array(F.lit(True), F.lit(False))))


@query("reference_lookup", "WITH r AS (SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0) SELECT c.conv_id, c.turn, coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.item_id IS NOT NULL THEN 'full' WHEN b.item_id IS NOT NULL THEN 'prefix' ELSE 'no_reference' END AS found FROM conversations c LEFT JOIN r a ON a.item_id = c.conv_id LEFT JOIN r b ON b.item_id = c.conv_id + c.turn")
def reference_lookup(s, d):
    r = table(s, d, "benchmark").where("item_id % 2 = 0").select("item_id")
    c = table(s, d, "conversations").select("conv_id", "turn")
    x = c.join(r.select(F.col("item_id").alias("a")), F.col("conv_id") == F.col("a"), "left").join(r.select(F.col("item_id").alias("b")), F.col("conv_id") + F.col("turn") == F.col("b"), "left")
    return x.select("conv_id", "turn", F.coalesce("a", "b").alias("item_id"), F.when(F.col("a").isNotNull(), "full").when(F.col("b").isNotNull(), "prefix").otherwise("no_reference").alias("found"))


# --- energy, carbon, cost --------------------------------------------------------------------

# kWh per query by strategy, grid intensity in kg per kWh, electricity price and token energy.
GRID_KG = [("low", 0.05), ("reference", 0.385), ("high", 0.7)]
USD_PER_KWH, KWH_PER_TOKEN = 0.12, 1e-5
#: Watts that a model draws while it answers; an answer's energy is that times its latency.
SLM_WATTS, LLM_WATTS = 70, 150
KWH_SQL = GRID + f""", jo AS (SELECT *, latency * CASE WHEN model_key = 'slm' THEN {SLM_WATTS} ELSE {LLM_WATTS} END AS j FROM grid),
ro AS (SELECT doc_id, CASE WHEN {sql_hits(T.COMPLEX_WORDS, "coalesce(text, '')")} >= {sql_hits(T.SIMPLE_WORDS, "coalesce(text, '')")} THEN 'llm' ELSE 'slm' END AS route FROM documents),
k AS (SELECT model_name AS strategy, avg(j) / 3600000.0::DOUBLE AS kwh FROM jo GROUP BY 1 UNION ALL SELECT 'Routing_Hybrid', avg(j) / 3600000.0::DOUBLE FROM jo JOIN ro USING (doc_id) WHERE rag_flag AND model_key = route HAVING count(*) > 0)"""


def strategies(s, d) -> DataFrame:
    """Energy of an answer, by configuration, and when each document's text is routed to a model with retrieval."""
    j = grid(s, d).withColumn("j", F.col("latency") * F.when(F.col("model_key") == "slm", SLM_WATTS).otherwise(LLM_WATTS))
    route = table(s, d, "documents").select("doc_id", T.route(F.coalesce("text", F.lit(""))).alias("route"))
    routed = j.where("rag_flag").join(route, "doc_id").where("model_key = route").agg(F.avg("j").alias("j")).where("j is not null")
    of = lambda rows, name: rows.select(name.alias("strategy"), (F.col("j") / 3600000).alias("kwh"))
    return of(j.groupBy("model_name").agg(F.avg("j").alias("j")), F.col("model_name")).union(of(routed, F.lit("Routing_Hybrid")))


@query("energy_carbon", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS tokens, round(sum(n_chars) * 0.00001::DOUBLE, 6) AS kwh, round(sum(n_chars) * 0.00001::DOUBLE * 0.385, 6) AS kg FROM documents GROUP BY 1")
def energy_carbon(s, d):
    kwh = F.sum("n_chars") * KWH_PER_TOKEN
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("tokens"), F.round(kwh, 6).alias("kwh"), F.round(kwh * 0.385, 6).alias("kg"))


@query("eie_minmax", f"{KWH_SQL} SELECT strategy, round((kwh - min(kwh) OVER ()) / (max(kwh) OVER () - min(kwh) OVER ()), 6) AS scaled FROM k")
def eie_minmax(s, d):
    w = Window.partitionBy()
    low, high = F.min("kwh").over(w), F.max("kwh").over(w)
    return strategies(s, d).select("strategy", F.round(F.when(high == low, 0.5).otherwise((F.col("kwh") - low) / (high - low)), 6).alias("scaled"))


@query("pairwise_ratio", f"{KWH_SQL} SELECT a.strategy AS numerator, b.strategy AS denominator, round(a.kwh / b.kwh, 6) AS ratio FROM k a, k b")
def pairwise_ratio(s, d):
    k = strategies(s, d)
    return k.select(F.col("strategy").alias("numerator"), F.col("kwh").alias("x")).crossJoin(k.select(F.col("strategy").alias("denominator"), F.col("kwh").alias("y"))).select("numerator", "denominator", F.round(F.col("x") / F.col("y"), 6).alias("ratio"))


@query("grid_carbon", f"{KWH_SQL}, g(site, kg) AS (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in GRID_KG) + ") SELECT site AS grid, strategy, round(kwh * kg * 1000000, 4) AS kg_per_million FROM k, g")
def grid_carbon(s, d):
    g = F.explode(F.array(*[F.struct(F.lit(n).alias("grid"), F.lit(v).alias("kg")) for n, v in GRID_KG]))
    return strategies(s, d).withColumn("g", g).select("g.grid", "strategy", T.rounded(F.col("kwh") * F.col("g.kg") * 1000000, 4).alias("kg_per_million"))


@query("scaling_cost", f"{KWH_SQL} SELECT volume, strategy, round(kwh * volume * 365 / 1000, 4) AS mwh_year, round(kwh * volume * 365 * 0.12, 2) AS usd_year FROM k, unnest([1000, 100000, 1000000]) AS v(volume)")
def scaling_cost(s, d):
    v = F.explode(F.array(*map(F.lit, [1000, 100000, 1000000])))
    year = F.col("kwh") * F.col("volume") * 365
    return strategies(s, d).withColumn("volume", v).select("volume", "strategy", T.rounded(year / 1000, 4).alias("mwh_year"), T.rounded(year * USD_PER_KWH, 2).alias("usd_year"))
