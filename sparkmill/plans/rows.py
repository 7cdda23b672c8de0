"""Queries on what rows hold: letters, options, predicates, rankings, and summaries of retrieval by configuration."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkmill.functions import text as T
from sparkmill.functions.stemmer import stem
from sparkmill.operators import stats
from sparkmill.plans.queries import GRID, SQL, boot_sql, grid, query, table, turn_pairs
from sparkmill.plans.scoring import CHUNK, CITED, CONTEXTS, contexts

# --- letters and options ------------------------------------------------------------------------

LETTER = "CASE WHEN regexp_matches({x}, '^\\p{{L}}$') THEN {x} ELSE regexp_extract({x}, '^([A-Z])(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) END"
ANSWERS = "a AS (SELECT conv_id, turn, upper(trim(coalesce(text, ''))) AS t, upper(trim(chr((65 + turn % 30)::INT) || ['', ') x', '.y', 'bc', ' z', '_q'][(conv_id % 6)::INT + 1])) AS s FROM conversations)"


@query("judge_letter", f"WITH {ANSWERS} SELECT conv_id, turn, {LETTER.format(x='t')} AS own, {LETTER.format(x='s')} AS short FROM a")
def judge_letter(s, d):
    endings = F.array(*map(F.lit, ["", ") x", ".y", "bc", " z", "_q"]))
    short = F.concat(F.char(65 + F.col("turn") % 30), F.element_at(endings, (F.col("conv_id") % 6 + 1).cast("int")))
    return table(s, d, "conversations").select("conv_id", "turn", T.answer_letter(F.col("text")).alias("own"), T.answer_letter(short).alias("short"))


#: Choices of an item as an object, as a list, as a list with letters out of place, or broken; the letter asked for goes round.
CHOICES = """c AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{"A":" one ' || item_id || '","b. two":"two ' || item_id || ' "}' WHEN 1 THEN '["A. one ' || item_id || '","b) two","three"]' WHEN 2 THEN '["one","C: three ' || item_id || '"]' ELSE '["A. one' END AS choices,
chr((65 + item_id // 4 % 4)::INT) AS letter FROM benchmark)"""


def choices(s, d):
    i, k = F.col("item_id").cast("string"), F.col("item_id") % 4
    made = (
        F.when(k == 0, F.concat(F.lit('{"A":" one '), i, F.lit('","b. two":"two '), i, F.lit(' "}')))
        .when(k == 1, F.concat(F.lit('["A. one '), i, F.lit('","b) two","three"]')))
        .when(k == 2, F.concat(F.lit('["one","C: three '), i, F.lit('"]')))
        .otherwise('["A. one')
    )
    return table(s, d, "benchmark").select("item_id", made.alias("choices"), F.char(65 + F.floor(F.col("item_id") / 4) % 4).alias("letter"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))


@query("option_text", f"""WITH {CHOICES}, j AS (SELECT item_id, letter, CASE WHEN json_valid(choices) THEN choices::JSON END AS j FROM c),
x AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN list_filter(json_keys(j), lambda k: upper(trim(k))[1] = letter)[1] END AS named, CASE WHEN json_type(j) = 'ARRAY' THEN list_transform(j->>'$[*]', lambda o: trim(o)) END AS l, '(?i)^\\s*' || letter || '[.):\\-]\\s*' AS p FROM j)
SELECT item_id, coalesce(trim(j->>('$."' || named || '"')), trim(regexp_replace(coalesce(l[ascii(letter) - 64], list_filter(l, lambda o: regexp_matches(o, p))[1]), p, '')), '') AS option FROM x""")
def option_text(s, d):
    return choices(s, d).select("item_id", T.option_text(F.col("choices"), F.col("letter")).alias("option"))


@query("row_predicates", GRID + f""", x AS (SELECT doc_id, cfg, CASE doc_id % 4 WHEN 0 THEN ' PubMedQA' WHEN 1 THEN 'medmcqa' ELSE benchmark END AS b, CASE WHEN doc_id % 5 = 0 THEN 'pubmedqa_' || doc_id ELSE question_id END AS q, upper(CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE gold || '. x' END) AS r FROM grid)
SELECT doc_id, cfg, lower(trim(b)) = 'pubmedqa' OR starts_with(lower(q), 'pubmedqa') AS is_label, lower(trim(b)) IN ('medqa', 'mmlu_med', 'mmlu-med', 'mmlu') AS is_choice, {LETTER.format(x='r')} <> '' OR doc_id % 2 = 0 AS is_letter FROM x""")
def row_predicates(s, d):
    """Benchmarks told by name or identifier, and rows whose reference is a letter or that have two choices or more (here: each other document)."""
    i, name = F.col("doc_id"), F.lower(F.trim(F.when(F.col("doc_id") % 4 == 0, " PubMedQA").when(F.col("doc_id") % 4 == 1, "medmcqa").otherwise(F.col("benchmark"))))
    key = F.when(i % 5 == 0, F.concat(F.lit("pubmedqa_"), i.cast("string"))).otherwise(F.col("question_id"))
    letter = T.answer_letter(F.when(i % 3 == 0, "yes").otherwise(F.concat("gold", F.lit(". x"))))
    return grid(s, d).select("doc_id", "cfg", ((name == "pubmedqa") | F.lower(key).startswith("pubmedqa")).alias("is_label"), name.isin("medqa", "mmlu_med", "mmlu-med", "mmlu").alias("is_choice"), ((letter != "") | (i % 2 == 0)).alias("is_letter"))


@query("arm_rows", GRID + "SELECT doc_id, cfg, rag_flag FROM grid WHERE lower(benchmark) = lower('MedQA') AND rag_flag AND CASE WHEN faith > 50 THEN letter ELSE '' END <> '' AND recall_at_1 IS NOT NULL")
def arm_rows(s, d):
    """Rows of one benchmark, in any case, and one arm, that have an answer (here: those of a score over 50) and can be evaluated."""
    answer = F.when(F.col("faith") > 50, F.col("letter")).otherwise("")
    return grid(s, d).where((F.lower("benchmark") == "MedQA".lower()) & F.col("rag_flag") & (answer != "") & F.col("recall_at_1").isNotNull()).select("doc_id", "cfg", "rag_flag")


@query("norag_grounding", f"""WITH {CHOICES}, j AS (SELECT item_id, text, CASE WHEN json_valid(choices) THEN choices::JSON END AS j FROM c JOIN benchmark USING (item_id)),
o AS (SELECT *, CASE json_type(j) WHEN 'OBJECT' THEN list_transform(list_sort(json_keys(j)), lambda k: k || '. ' || (j->>('$."' || k || '"'))) WHEN 'ARRAY' THEN list_transform((j->>'$[*]')[1:6], lambda x, i: chr((64 + i)::INT) || '. ' || x) ELSE [] END AS o FROM j)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN trim(coalesce(text, '')) ELSE trim(array_to_string(list_concat(CASE WHEN trim(coalesce(text, '')) <> '' THEN [trim(text)] ELSE [] END, o), chr(10) || chr(10))) END AS grounding FROM o""")
def norag_grounding(s, d):
    """Evidence without retrieval: the abstract (here: every third item), or the question and its options."""
    stem = F.when(F.col("text") != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    return choices(s, d).select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.trim(F.array_join(F.concat(stem, T.option_lines(F.col("choices"))), "\n\n"))).alias("grounding"))


@query("evidence_chunks", f"WITH {CONTEXTS} SELECT conv_id, turn, regexp_matches(fresh, 'Chunk \\d+ \\(|\\[\\d+\\]') AS chunks FROM c")
def evidence_chunks(s, d):
    return contexts(s, d).select("conv_id", "turn", F.col("fresh").rlike(f"{CHUNK}|{CITED}").alias("chunks"))


RANKED = """r AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '["a' || item_id || '","","b"]' WHEN 1 THEN 'a,b' ELSE ' ["x","y","z"]' END AS ranked, CASE item_id % 4 WHEN 0 THEN '["p","q","r","s"]' WHEN 1 THEN '["p"' WHEN 2 THEN '["p' || item_id || '"]' END AS diag FROM benchmark)"""


@query("ranked_choice", f"""WITH {RANKED}, l AS (SELECT item_id, CASE WHEN starts_with(trim(ranked), '[') AND json_valid(ranked) THEN list_filter(ranked::JSON->>'$[*]', lambda x: x <> '') ELSE [] END AS a, CASE WHEN starts_with(trim(diag), '[') AND json_valid(diag) THEN list_filter(diag::JSON->>'$[*]', lambda x: x <> '') ELSE [] END AS b FROM r)
SELECT item_id, array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ',') AS ranked FROM l""")
def ranked_choice(s, d):
    """The diagnostics' ranking stands in for the prompt's only where it is longer; what isn't a JSON list is an empty one."""
    i, text = F.col("item_id"), F.col("item_id").cast("string")
    ranked = F.when(i % 3 == 0, F.concat(F.lit('["a'), text, F.lit('","","b"]'))).when(i % 3 == 1, "a,b").otherwise(' ["x","y","z"]')
    diag = F.when(i % 4 == 0, '["p","q","r","s"]').when(i % 4 == 1, '["p"').when(i % 4 == 2, F.concat(F.lit('["p'), text, F.lit('"]')))
    one, two = T.json_list(ranked), T.json_list(diag)
    return table(s, d, "benchmark").select("item_id", F.array_join(F.when(F.size(two) > F.size(one), two).otherwise(one), ",").alias("ranked"))


# --- summaries ----------------------------------------------------------------------------------


@query("health_mean", GRID + ", r AS (SELECT doc_id % 3 AS run, avg(recall_at_1) AS r1, avg(recall_at_3) AS r3, avg(mrr) AS m FROM grid GROUP BY 1) SELECT count(*) AS runs, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(m), 6) AS mrr FROM r")
def health_mean(s, d):
    """Each run counts once, however many rows it has."""
    r = grid(s, d).groupBy((F.col("doc_id") % 3).alias("run")).agg(*(F.avg(c).alias(c) for c in ("recall_at_1", "recall_at_3", "mrr")))
    return r.agg(F.count("*").alias("runs"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall_at_1", "recall_at_3", "mrr")))


@query("label_rescore", f"WITH l AS ({SQL['label_normalise']}) SELECT conv_id % 2 AS model, count(*) AS n, round(avg((label = ['yes', 'no', 'maybe', ''][(turn % 4)::INT + 1])::INT), 6) AS accuracy FROM l GROUP BY 1")
def label_rescore(s, d):
    gold = F.element_at(F.array(*map(F.lit, ["yes", "no", "maybe", ""])), (F.col("turn") % 4 + 1).cast("int"))
    right = (T.yes_no_maybe(F.col("text")) == gold).cast("int")
    return table(s, d, "conversations").groupBy((F.col("conv_id") % 2).alias("model")).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@query("config_retrieval", GRID + ", e AS (SELECT model_name, doc_id, CASE WHEN model_key = 'slm' THEN 0 ELSE recall_at_1 END AS r FROM grid WHERE rag_flag), t AS (SELECT model_name, count(*) AS n_evaluable, max(r) <= 1e-9 AS metrics_na FROM e GROUP BY 1), f AS (SELECT e.* FROM e JOIN t USING (model_name) WHERE NOT metrics_na), ci AS (WITH " + boot_sql("f", "model_name", "r", "doc_id", 2000) + ") SELECT model_name, n_evaluable, metrics_na, mean, low, high FROM t LEFT JOIN ci USING (model_name)")
def config_retrieval(s, d):
    """Recall with its interval by configuration, over rows that can be evaluated; not applicable where nothing is ever found (here: the small model, whose corpus has no gold)."""
    e = grid(s, d).where("rag_flag").select("model_name", "doc_id", F.when(F.col("model_key") == "slm", 0.0).otherwise(F.col("recall_at_1")).alias("r"))
    t = e.groupBy("model_name").agg(F.count("*").alias("n_evaluable"), (F.max("r") <= 1e-9).alias("metrics_na"))
    ci = stats.bootstrap_ci(e.join(t.where("not metrics_na"), "model_name", "left_semi"), "model_name", "r", "doc_id").drop("n")
    return t.join(ci, "model_name", "left")


@query("macro_retrieval", GRID + ", x AS (SELECT model_name, recall_at_1, CASE WHEN doc_id % 4 = 0 THEN 'nan'::DOUBLE ELSE recall_at_3 END AS r3, mrr FROM grid) SELECT model_name, count(*) AS n_queries, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(r3) FILTER (WHERE NOT isnan(r3)), 6) AS recall_at_3, round(avg(mrr), 6) AS mrr FROM x GROUP BY 1")
def macro_retrieval(s, d):
    """Means that leave out NaN (here: recall at 3 of every fourth document), and the number of all queries."""
    x = grid(s, d).withColumn("recall_at_3", F.when(F.col("doc_id") % 4 == 0, float("nan")).otherwise(F.col("recall_at_3")))
    mean = lambda c: F.round(F.avg(F.nanvl(c, F.lit(None).cast("double"))), 6).alias(c)
    return x.groupBy("model_name").agg(F.count("*").alias("n_queries"), *map(mean, ("recall_at_1", "recall_at_3", "mrr")))


@query("dense_share", GRID + ", x AS (SELECT model_name, ['faiss', 'lexical', 'hybrid+rerank', 'stub'][((doc_id + cfg) % 4)::INT + 1] AS source FROM grid WHERE rag_flag) SELECT model_name, round(avg((source IN ('faiss', 'hybrid', 'dense', 'hybrid+rerank', 'dense+rerank'))::INT) * 100, 4) AS dense_pct, round(avg((source = 'lexical')::INT) * 100, 4) AS lexical_pct, bool_and(source = 'lexical') AS all_lexical FROM x GROUP BY 1")
def dense_share(s, d):
    source = F.element_at(F.array(*map(F.lit, ["faiss", "lexical", "hybrid+rerank", "stub"])), ((F.col("doc_id") + F.col("cfg")) % 4 + 1).cast("int"))
    x = grid(s, d).where("rag_flag").select("model_name", source.alias("source"))
    dense, lexical = F.col("source").isin("faiss", "hybrid", "dense", "hybrid+rerank", "dense+rerank"), F.col("source") == "lexical"
    share = lambda c, name: F.round(F.avg(c.cast("int")) * 100, 4).alias(name)
    return x.groupBy("model_name").agg(share(dense, "dense_pct"), share(lexical, "lexical_pct"), F.bool_and(lexical).alias("all_lexical"))


@query("combined_scores", GRID + ", x AS (SELECT doc_id // 5 AS key, cfg, 'batch_' || doc_id % 3 AS path, doc_id AS line, CASE doc_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'nan' ELSE ((doc_id * 31 + cfg * 7) % 121)::VARCHAR END AS score FROM grid), n AS (SELECT *, try_cast(score AS DOUBLE) AS v FROM x) SELECT key, cfg, arg_max(v, (path, line)) AS score FROM n WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2")
def combined_scores(s, d):
    """Batches of scores as one: those that aren't numbers go, and of a key the last by path and line stays."""
    i, c = F.col("doc_id"), F.col("cfg")
    text = F.when(i % 6 == 0, "x").when(i % 6 == 1, "nan").otherwise(((i * 31 + c * 7) % 121).cast("string"))
    x = grid(s, d).select(F.floor(i / 5).alias("key"), "cfg", F.struct(F.concat(F.lit("batch_"), (i % 3).cast("string")).alias("path"), i.alias("line")).alias("at"), T.number(text).alias("v"))
    return x.where("v is not null").groupBy("key", "cfg").agg(F.max_by("v", "at").alias("score"))


@query("ordered_union", "SELECT origin, id FROM (SELECT 0 AS origin, item_id AS id FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn FROM conversations) ORDER BY origin, id LIMIT 500")
def ordered_union(s, d):
    """The first source in order, then the second, up to a target of 500."""
    one = table(s, d, "benchmark").select(F.lit(0).alias("origin"), F.col("item_id").alias("id"))
    two = table(s, d, "conversations").select(F.lit(1).alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return one.union(two).orderBy("origin", "id").limit(500)


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit a token of a, all of which a token of b moves at once."""
    places: dict[str, int] = {}
    for k, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


@query("rouge_l")
def rouge_l(s, d):
    """ROUGE-L's F of each turn against the one before, over tokens that aren't stemmed; 0 where either has none."""

    @pandas_udf("double")
    def f(pred: pd.Series, ref: pd.Series) -> pd.Series:
        n = [longest_common(list(r), list(p)) for p, r in zip(pred, ref, strict=True)]
        return 2.0 * pd.Series(n, index=pred.index) / (pred.map(len) + ref.map(len)).clip(lower=1)

    return turn_pairs(s, d).select("conv_id", "turn", F.round(f(T.tokens(F.col("pred")), T.tokens(F.col("ref"))), 6).alias("f"))


@query("rouge_l_stemmed")
def rouge_l_stemmed(s, d):
    """ROUGE-L's F over stemmed tokens; tokens of three letters or fewer stay."""

    @pandas_udf("double")
    def f(pred: pd.Series, ref: pd.Series) -> pd.Series:
        stems = lambda ts: [stem(t) if len(t) > 3 else t for t in ts]
        n = [longest_common(stems(r), stems(p)) for p, r in zip(pred, ref, strict=True)]
        return 2.0 * pd.Series(n, index=pred.index) / (pred.map(len) + ref.map(len)).clip(lower=1)

    return turn_pairs(s, d).select("conv_id", "turn", F.round(f(T.tokens(F.col("pred")), T.tokens(F.col("ref"))), 6).alias("f"))
