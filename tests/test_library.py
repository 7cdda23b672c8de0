"""Operators of the library: each query against its SQL on the smallest tables, golden cases, sources, sinks and streams."""

import hashlib
import re
import json
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.operators import corpus, jobs, models, retrieval, stats
import sparkmill.plans.evaluation  # noqa: F401
import sparkmill.plans.rows  # noqa: F401
import sparkmill.plans.scoring  # noqa: F401
from sparkmill.plans.queries import QUERIES, SQL
from sparkmill.sources import files, sinks
from sparkmill.streaming import events

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split() + ["labels", "conversations"]


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows_of(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v if isinstance(v, (str, bool)) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.sql(SQL[name]).df())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("response", "letter"), [("FINAL ANSWER LETTER: C", "C"), ("A patient ...", "A"), ("the answer is (b)", "B"), ("ANSWER:D", "D"), ("zzz", ""), (None, ""), ("", ""), ("xCx", "C")]
)
def test_choice_letter(spark, response, letter):
    assert value(spark, T.choice_letter(F.lit(response).cast("string"))) == letter


@pytest.mark.parametrize(("gold", "letter"), [("b", "B"), ("2", "C"), ("7", "7"), ("Dose", "D"), (None, "")])
def test_gold_letter(spark, gold, letter):
    assert value(spark, T.gold_letter(F.lit(gold).cast("string"))) == letter


@pytest.mark.parametrize(("response", "label"), [("Yes, it does", "yes"), ("no.", "no"), ("it is unclear, yes", "maybe"), ("clearly yes", "yes"), ("yes and no", "yes"), ("both yes or no", ""), ("", ""), (None, "")])
def test_yes_no_maybe(spark, response, label):
    assert value(spark, T.yes_no_maybe(F.lit(response).cast("string"))) == label


def test_thinking_and_numbers(spark):
    assert value(spark, T.without_thinking(F.lit("<think>a</think> ok <THINK>b</THINK>!"))) == "ok !"
    assert [value(spark, T.number(F.lit(x))) for x in ("1.5", "x", "NaN")] == [1.5, None, None]


def test_prefix_matching_metrics(spark):
    hits = spark.createDataFrame([(1, "pubmedqa_12", 1), (1, "pubmedqa_1_long", 2), (2, "z", 1)], "query_id long, source string, rank int")
    gold = spark.createDataFrame([(1, "pubmedqa_1"), (1, "pubmedqa_1_long"), (2, "q")], "query_id long, gold string")
    got = {r.query_id: r for r in retrieval.retrieval_metrics(hits, gold).collect()}
    assert got[1].recall_at_1 == 0 and got[1].recall_at_3 == 1 and got[1].mrr == 0.5 and got[2].mrr == 0


def test_packing_and_greedy_dedupe(spark):
    assert value(spark, F.transform(retrieval.packed(F.array(F.lit("a" * 100), F.lit("b" * 300), F.lit("c")), 300), lambda b: F.length(b))) == [100, 118]
    assert value(spark, retrieval.greedy_distinct(F.array(F.lit("one two three"), F.lit("three two one"), F.lit("four five")))) == [0, 2]


def test_bootstrap_draws_2000_times(spark):
    values = [((k * k) % 17) / 17 for k in range(9)]
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)], "g string, k int, v double")
    draw = lambda b, j: int(hashlib.md5(f"17-g-{b}-{j}".encode()).hexdigest()[:8], 16) % 9
    means = sorted(sum(values[draw(b, j)] for j in range(9)) / 9 for b in range(2000))
    got = stats.bootstrap_ci(df, "g", "v", "k").first()
    assert (got.n, got.low, got.high) == (9, pytest.approx(means[50], abs=2e-6), pytest.approx(means[1950], abs=2e-6))


def test_bootstrap_takes_the_whole_grid(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert {r.n for r in QUERIES["bootstrap_ci"](spark, DATA).collect()} == {n}


def test_merge_and_pairs_take_the_whole_grid(spark):
    docs = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    assert sum(r.n for r in QUERIES["weighted_merge"](spark, DATA).collect()) == 4 * len(docs)
    right = lambda i, c: (i * 7 + c * 3) % 4 == i % 4
    want = {(m, f): sum(right(i, x) and not right(i, y) for i in docs) for m, no, rag in (("slm", 0, 1), ("llm", 2, 3)) for f, x, y in (("b", no, rag), ("c", rag, no))}
    got = QUERIES["paired_mcnemar"](spark, DATA).collect()
    assert want == {(m, f): sum(r[f] for r in got if r.model_key == m) for m in ("slm", "llm") for f in "bc"}


def test_mcnemar(spark):
    assert value(spark, stats.mcnemar(F.lit(0), F.lit(0))) is None
    assert value(spark, stats.mcnemar(F.lit(1), F.lit(5))) == pytest.approx(0.21875)
    assert value(spark, stats.mcnemar(F.lit(400), F.lit(600))) == pytest.approx(2.7e-10, rel=0.1)


def test_windows_of_short_and_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "w " * 39), (4, "w " * 40), (5, "w " * 600)], "doc_id long, text string")
    assert sorted((r.doc_id, r.source, r.n_words) for r in corpus.word_windows(df).collect()) == [(4, "doc_4", 40), (5, "doc_5", 300), (5, "doc_5_1", 300), (5, "doc_5_2", 108)]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert sorted(tuple(r) for r in jobs.keep_last(df, ["k"], ["n"]).collect()) == [("a", 2, "y"), ("b", 1, None)]
    assert sorted(r.n for r in jobs.keep_last(df, ["k"], ["n"], last=False).collect()) == [1, 1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "x": 2}\n\n{"id": "2", "x": 3}\n')
    assert files.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, x int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), "id string, x int").collect()
    (tmp_path / "p.json").write_text(json.dumps({"meta": {"a": 1}, "rows": [{"k": 1}, {"k": 2}]}))
    assert [r.k for r in files.predictions(spark, str(tmp_path / "p.json")).collect()] == [1, 2]
    (tmp_path / "c.txt").write_text('{"chunk": "t", "id": "s"}\n"bare"\nplain\n{"text": "u"}\n')
    assert [tuple(r) for r in files.chunk_lines(spark, str(tmp_path / "c.txt")).collect()] == [("t", "s"), ("bare", ""), ("plain", ""), ("u", "")]
    (tmp_path / "r.json").write_text('{"q": "answer"}')
    assert [tuple(r) for r in files.reference_map(spark, str(tmp_path / "r.json")).collect()] == [("q", "answer")]
    df = files.missing_as_null(spark.createDataFrame([(" ", float("nan")), ("x", 1.0)], "a string, b double"))
    assert [tuple(r) for r in df.collect()] == [(None, None), ("x", 1.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", ["x"]), (2, None, None)], "id int, t string, l array<string>")
    sinks.predictions_csv(df, str(tmp_path / "p.csv"), ["t", "z"])
    back = files.predictions_csv(spark, str(tmp_path / "p.csv"))
    assert back.columns == ["t", "z", "id", "l"] and {r.t for r in back.collect()} == {"a\nb", ""}
    sinks.batch(df, str(tmp_path / "b"), 0)
    sinks.batch(df.limit(1), str(tmp_path / "b"), 1)
    sinks.batch(df.limit(1), str(tmp_path / "b"), 0)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    with pytest.raises(ValueError):
        sinks.vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<double>"), str(tmp_path / "v"), "id", "v")


def test_model_interface(spark):
    df = spark.createDataFrame([(str(k), f"r{k}") for k in range(70)], "key string, response string")
    got = models.run_model(df, models.mock_judge, "key string, judge_correctness long, judge_model string").collect()
    assert len(got) == 70 and all(1 <= r.judge_correctness <= 5 and r.judge_model == "mock" for r in got)


def test_stream_windows(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/events.parquet")
    src.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    q = events.write(events.windowed(events.read_events(spark, str(tmp_path / "in")), "1 hour", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0 < got <= src.count()


def test_rouge_l_equals_the_table_of_prefixes(spark):
    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    turns = {(r.conv_id, r.turn): re.findall("[a-z0-9]+", (r.text or "").lower()) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = QUERIES["rouge_l"](spark, DATA).collect()
    assert got
    for r in got:
        a, b = turns[r.conv_id, r.turn], turns[r.conv_id, r.turn - 1]
        assert r.f == pytest.approx(2 * length(a, b) / max(len(a) + len(b), 1), abs=1e-6)


@pytest.mark.parametrize(
    ("choices", "letter", "text"),
    [('{"B. x":" two "}', "B", "two"), ('["A) one","two"]', "A", "one"), ('["A) one","two"]', "B", "two"), ('["x","d - four"]', "D", ""), ("[", "A", ""), (None, "A", ""), ("[]", "A", ""), ('["d: four"]', "D", "four"), ('["x"]', ".", "")],
)
def test_option_text(spark, choices, letter, text):
    assert value(spark, T.option_text(F.lit(choices).cast("string"), F.lit(letter))) == text


@pytest.mark.parametrize(("answer", "letter"), [("b", "B"), ("c) yes", "C"), ("D\nx", "D"), ("Both", ""), ("a_b", ""), (None, ""), (" e", "E"), ("5", "")])
def test_answer_letter(spark, answer, letter):
    assert value(spark, T.answer_letter(F.lit(answer).cast("string"))) == letter


def test_labels_are_parted_at_ascii_edges(spark):
    said = [value(spark, T.yes_no_maybe(F.lit(x))) for x in ("noé", "ciónno or", "éno x", "_no", "\u00a0no yes", "İnconclusive", "yesé or no")]
    assert said == ["no", "", "no", "", "no", "maybe", "yes"]
    assert value(spark, T.choice_letter(F.lit("xx ñb a"))) == "B"


def test_ties_are_rounded_as_duckdb_does(spark):
    got = {(r.volume, r.strategy): r.usd_year for r in QUERIES["scaling_cost"](spark, os.path.join(os.path.dirname(DATA), "sf0.01")).collect()}
    assert got[100_000, "LLM_NoRAG"] == 632.54
    xs = [632.545, 1.005, 2.5, -0.125, 1e-9, 0.00014441666666666666 * 100000 * 365 * 0.12]
    assert [value(spark, T.rounded(F.lit(x), 2)) for x in xs] == [duckdb.execute("SELECT round(?::DOUBLE, 2)", [x]).fetchall()[0][0] for x in xs]


def test_bootstrap_adds_up_hashed_draws_in_parts(spark, monkeypatch):
    import numpy as np

    from sparkmill.operators.draws import adder

    values = np.array([k % 7 / 7 for k in range(1203)])
    for lead in (b"17-g-", b"17-" + b"x" * 60 + b"-"):  # of the latter, a hash has two blocks
        want = [sum(values[int(hashlib.md5(lead + f"{b}-{j}".encode()).hexdigest()[:8], 16) % 1203] for j in range(1203)) for b in range(8, 12)]
        assert adder()(lead, (8, 12), 1203, values) == pytest.approx(want)
    df = spark.range(1203).selectExpr("'g' AS g", "id AS k", "id % 7 / 7 AS v")
    whole = stats.bootstrap_ci(df, "g", "v", "k", 64).collect()
    monkeypatch.setattr(stats, "SPAN", 512)
    monkeypatch.setattr(stats, "CHUNK", 128)
    assert stats.bootstrap_ci(df, "g", "v", "k", 64).collect() == whole
