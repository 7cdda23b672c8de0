"""Queries on which context an answer is judged by, evidence blocks, and what a batch of scores still lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators.retrieval import lexical_score
from sparkmill.plans.queries import GRID, TOK3, grid, query, table

# --- context support --------------------------------------------------------------------------

# The marks of evidence in a context.
CITED, CHUNK = r"\[\d+\]", r"Chunk \d+ \("


def support(context: Column, answer: Column, question: Column) -> Column:
    """0.55 of the answer's and 0.45 of the question's lexical score, more for citations, an evidence header and chunks; half for a short context without marks, 0 for an empty one."""
    words = lambda x: F.array_distinct(T.tokens(x, 3))
    score = 0.55 * lexical_score(answer, context, words(answer), words(context)) + 0.45 * lexical_score(question, context, words(question), words(context))
    cited = context.rlike(CITED)
    score = score + F.when(cited, 0.08).otherwise(0.0) + F.when(F.lower(context).rlike("retrieved (medical )?evidence"), 0.04).otherwise(0.0) + F.when(context.rlike(CHUNK), 0.05).otherwise(0.0)
    bare = (F.length(context) < 200) & ~cited & ~F.contains(context, F.lit("Chunk"))
    return F.when(F.length(context) == 0, 0.0).otherwise(score * F.when(bare, 0.5).otherwise(1.0))


def support_sql(c: str, a: str, q: str) -> str:
    def lexical(x: str) -> str:
        xs, cs = f"list_distinct({TOK3.format(x=x)})", f"list_distinct({TOK3.format(x=c)})"
        return f"""round(CASE WHEN len(list_distinct(list_concat({xs}, {cs}))) = 0 THEN 0 ELSE len(list_intersect({xs}, {cs}))::DOUBLE / len(list_distinct(list_concat({xs}, {cs}))) END
+ 0.08::DOUBLE * least(len(list_intersect({xs}, {cs})), 40) + 0.02::DOUBLE * len(list_filter({xs}, lambda t: length(t) >= 5 AND contains(lower({c}), t))), 6)"""

    cited = f"regexp_matches({c}, '\\[\\d+\\]')"
    return f"""CASE WHEN length({c}) = 0 THEN 0.0::DOUBLE ELSE (0.55::DOUBLE * {lexical(a)} + 0.45::DOUBLE * {lexical(q)} + CASE WHEN {cited} THEN 0.08::DOUBLE ELSE 0 END
+ CASE WHEN regexp_matches(lower({c}), 'retrieved (medical )?evidence') THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN regexp_matches({c}, 'Chunk \\d+ \\(') THEN 0.05::DOUBLE ELSE 0 END)
* CASE WHEN length({c}) < 200 AND NOT {cited} AND NOT contains({c}, 'Chunk') THEN 0.5::DOUBLE ELSE 1 END END"""


def contexts(s, d) -> DataFrame:
    """A turn as fresh evidence, with marks or without, the turn before as the stored context, and the one before that as the answer; null counts as empty."""
    t = table(s, d, "conversations").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("x"))
    fresh = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Retrieved evidence: Chunk 1 (a) "), "x", F.lit(" [1]"))).when(F.col("turn") % 3 == 2, F.concat(F.lit("Chunk 2 (b) "), "x")).otherwise(F.col("x"))
    one = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("x").alias("stored"))
    two = t.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("x").alias("answer"))
    return t.select("conv_id", "turn", fresh.alias("fresh")).join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left").fillna("", ["stored", "answer"])


CONTEXTS = """t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS x FROM conversations),
c AS (SELECT t.conv_id, t.turn, CASE t.turn % 3 WHEN 1 THEN 'Retrieved evidence: Chunk 1 (a) ' || t.x || ' [1]' WHEN 2 THEN 'Chunk 2 (b) ' || t.x ELSE t.x END AS fresh, coalesce(o.x, '') AS stored, coalesce(w.x, '') AS answer
FROM t LEFT JOIN t o ON o.conv_id = t.conv_id AND o.turn + 1 = t.turn LEFT JOIN t w ON w.conv_id = t.conv_id AND w.turn + 2 = t.turn)"""
SUPPORTS = f"{CONTEXTS}, s AS (SELECT *, round({support_sql('fresh', 'answer', 'stored')}, 4) AS fs, round({support_sql('stored', 'answer', 'fresh')}, 4) AS ss FROM c)"


def supports(s, d) -> DataFrame:
    c = contexts(s, d)
    fresh, stored, answer = F.col("fresh"), F.col("stored"), F.col("answer")
    return c.withColumn("fs", F.round(support(fresh, answer, stored), 4)).withColumn("ss", F.round(support(stored, answer, fresh), 4))


@query("context_support", f"WITH {SUPPORTS} SELECT conv_id, turn, fs, ss FROM s")
def context_support(s, d):
    return supports(s, d).select("conv_id", "turn", "fs", "ss")


@query("context_choice", f"""WITH {SUPPORTS} SELECT conv_id, turn, CASE WHEN length(fresh) < 80 THEN CASE WHEN stored <> '' THEN 'stored' ELSE 'reretrieve' END
WHEN length(stored) < 80 OR conv_id % 5 = 0 THEN 'reretrieve' WHEN ss >= fs * 1.45::DOUBLE AND ss >= 0.2::DOUBLE AND ss > fs + 0.04::DOUBLE THEN 'stored_better_support'
WHEN conv_id % 2 = 0 AND (length(fresh) >= 120 AND regexp_matches(fresh, 'Chunk \\d+ \\(|\\[\\d+\\]')) THEN 'reretrieve_plus_stored' WHEN (length(fresh) >= 120 AND regexp_matches(fresh, 'Chunk \\d+ \\(|\\[\\d+\\]')) AND fs >= ss * 0.88::DOUBLE THEN 'reretrieve'
WHEN ss >= fs * 1.15::DOUBLE AND ss >= 0.12::DOUBLE THEN 'stored_better_support' ELSE 'reretrieve' END AS choice FROM s""")
def context_choice(s, d):
    """conv_id stands for the benchmark: a multiple of 5 is one whose fresh context always holds, an even one has choices."""
    fs, ss, chunks = F.col("fs"), F.col("ss"), (F.length("fresh") >= 120) & F.col("fresh").rlike(f"{CHUNK}|{CITED}")
    choice = (
        F.when(F.length("fresh") < 80, F.when(F.col("stored") != "", "stored").otherwise("reretrieve"))
        .when((F.length("stored") < 80) | (F.col("conv_id") % 5 == 0), "reretrieve")
        .when((ss >= fs * 1.45) & (ss >= 0.2) & (ss > fs + 0.04), "stored_better_support")
        .when((F.col("conv_id") % 2 == 0) & chunks, "reretrieve_plus_stored")
        .when(chunks & (fs >= ss * 0.88), "reretrieve")
        .when((ss >= fs * 1.15) & (ss >= 0.12), "stored_better_support")
        .otherwise("reretrieve")
    )
    return supports(s, d).select("conv_id", "turn", choice.alias("choice"))


@query("merged_evidence", f"""WITH {CONTEXTS}, b AS (SELECT conv_id, turn, list_concat(string_split(regexp_replace(fresh, '(Chunk \\d+ \\()', chr(1) || '\\1', 'g'), chr(1)), string_split(regexp_replace('Chunk 7 (c) ' || stored || ' ' || fresh, '(Chunk \\d+ \\()', chr(1) || '\\1', 'g'), chr(1))) AS x FROM c),
p AS (SELECT conv_id, turn, i, trim(x[i]) AS chunk FROM b, unnest(range(1, len(x) + 1)) AS r(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(substr(chunk, 1, 200)) ORDER BY i) AS n FROM p WHERE chunk <> '')
SELECT conv_id, turn, string_agg(chunk, chr(10) || chr(10) ORDER BY i) AS merged FROM k WHERE n = 1 GROUP BY 1, 2""")
def merged_evidence(s, d):
    """Chunks of two evidence blocks in order, those with equal first 200 characters once."""
    cut = lambda x: F.split(F.regexp_replace(x, rf"({CHUNK})", "\x01$1"), "\x01")
    x = F.concat(cut(F.col("fresh")), cut(F.concat(F.lit("Chunk 7 (c) "), "stored", F.lit(" "), "fresh")))
    chunks = F.filter(F.transform(x, lambda c: F.trim(c)), lambda c: c != "")
    key = lambda c: F.lower(F.substring(c, 1, 200))
    first = F.transform(chunks, lambda c, i: F.when(F.array_position(F.transform(chunks, key), key(c)) == i + 1, c))
    return contexts(s, d).select("conv_id", "turn", F.array_join(F.filter(first, lambda c: c.isNotNull()), "\n\n").alias("merged")).where("merged <> ''")


# --- batches of scores ------------------------------------------------------------------------


@query("score_overlay", GRID + """, n AS (SELECT doc_id, cfg, faith FROM grid WHERE doc_id % 3 = 0 AND faith IS NOT NULL), o AS (SELECT doc_id, cfg, faith FROM grid WHERE doc_id % 2 = 0)
SELECT g.doc_id, g.cfg, coalesce(n.faith, o.faith) AS faith, CASE WHEN n.faith IS NOT NULL THEN 'new' WHEN o.doc_id IS NOT NULL THEN 'existing' ELSE 'pending' END AS origin FROM grid g LEFT JOIN n USING (doc_id, cfg) LEFT JOIN o USING (doc_id, cfg)""")
def score_overlay(s, d):
    """For each row the new score, else the existing file's row, else nothing yet."""
    g, key = grid(s, d), ["doc_id", "cfg"]
    new = g.where("doc_id % 3 = 0 and faith is not null").select(*key, F.col("faith").alias("nf"))
    old = g.where("doc_id % 2 = 0").select(*key, F.col("faith").alias("of"), F.lit(True).alias("has"))
    origin = F.when(F.col("nf").isNotNull(), "new").when(F.col("has"), "existing").otherwise("pending")
    return g.select(*key).join(new, key, "left").join(old, key, "left").select(*key, F.coalesce("nf", "of").alias("faith"), origin.alias("origin"))


@query("score_coverage", GRID + """SELECT benchmark, count(*) AS target, count(faith) AS scored, count(*) - count(faith) AS pending, ceil((count(*) - count(faith)) / 200.0)::BIGINT AS batches_left FROM grid GROUP BY 1""")
def score_coverage(s, d):
    pending = F.count("*") - F.count("faith")
    return grid(s, d).groupBy("benchmark").agg(F.count("*").alias("target"), F.count("faith").alias("scored"), pending.alias("pending"), F.ceil(pending / 200).alias("batches_left"))


@query("arm_counts", GRID + "SELECT model_key, count(*) FILTER (WHERE rag_flag) AS rag_rows, count(*) FILTER (WHERE NOT rag_flag) AS norag_rows FROM grid WHERE faith IS NOT NULL GROUP BY 1")
def arm_counts(s, d):
    return grid(s, d).where("faith is not null").groupBy("model_key").agg(F.count_if("rag_flag").alias("rag_rows"), F.count_if(~F.col("rag_flag")).alias("norag_rows"))


@query("throughput", GRID + "SELECT model_name, round(avg(100 + doc_id % 150) / avg(latency), 6) AS tokens_per_second, round(avg(latency) / min(avg(latency)) OVER (), 6) AS inflation FROM grid GROUP BY 1")
def throughput(s, d):
    """Mean tokens over mean latency, and latency over the fastest configuration's."""
    g = grid(s, d).groupBy("model_name").agg(F.avg(F.lit(100) + F.col("doc_id") % 150).alias("tokens"), F.avg("latency").alias("latency"))  # a row a configuration
    return g.select("model_name", F.round(F.col("tokens") / F.col("latency"), 6).alias("tokens_per_second"), F.round(F.col("latency") / F.min("latency").over(Window.partitionBy()), 6).alias("inflation"))


@query("bonferroni", GRID + "SELECT benchmark, count(DISTINCT model_key) AS contrasts, 0.05::DOUBLE / (count(DISTINCT model_key) * 3) AS alpha FROM grid GROUP BY 1")
def bonferroni(s, d):
    """RAG against none of each model is a contrast; alpha is shared by the contrasts of all three benchmarks."""
    contrasts = F.count_distinct("model_key")
    return grid(s, d).groupBy("benchmark").agg(contrasts.alias("contrasts"), (F.lit(0.05) / (contrasts * 3)).alias("alpha"))


@query("distinct_keys", GRID + "SELECT benchmark, question_id FROM grid WHERE rag_flag AND doc_id % 2 = 0 UNION SELECT benchmark, question_id FROM grid WHERE NOT rag_flag AND doc_id % 3 = 0")
def distinct_keys(s, d):
    g = grid(s, d)
    return g.where("rag_flag and doc_id % 2 = 0").select("benchmark", "question_id").union(g.where("not rag_flag and doc_id % 3 = 0").select("benchmark", "question_id")).distinct()


@query("clamped_scores", GRID + "SELECT doc_id, cfg, CASE WHEN faith IS NOT NULL THEN least(greatest(faith * 1.5 - 20, 0), 100)::DOUBLE END AS score, CASE WHEN length(question_id) > 4 THEN substr(question_id, 1, 4) || '...' ELSE question_id END AS shown FROM grid")
def clamped_scores(s, d):
    """Scores held within 0 to 100, null staying null, and identifiers cut to a limit."""
    score = F.when(F.col("faith").isNotNull(), F.least(F.greatest(F.col("faith") * 1.5 - 20, F.lit(0.0)), F.lit(100.0)))
    shown = F.when(F.length("question_id") > 4, F.concat(F.substring("question_id", 1, 4), F.lit("..."))).otherwise(F.col("question_id"))
    return grid(s, d).select("doc_id", "cfg", score.alias("score"), shown.alias("shown"))
