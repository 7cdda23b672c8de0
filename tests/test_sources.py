"""Item sets, positions, scans that stop, XML, and sources and sinks in small."""

import hashlib
import json
import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import text as T
from sparkmill.functions.stemmer import stem
from sparkmill.operators import models, overlap
from sparkmill.sources import files, items, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- items ------------------------------------------------------------------------------------


def test_medqa_items(spark):
    rows = [("1", " a ", "b", "w", "x", None, "z", "2"), ("2", "a", None, "w", "x", "y", "z", "7"), (None, None, None, None, None, None, None, None)]
    got = items.medqa(spark.createDataFrame(rows, "id string, sent1 string, sent2 string, ending0 string, ending1 string, ending2 string, ending3 string, label string")).collect()
    assert [tuple(r) for r in got] == [("1", "a\nb", ["w", "x", "", "z"], "C"), ("2", "a", ["w", "x", "y", "z"], "7"), ("", "", ["", "", "", ""], "None")]


def test_medmcqa_items(spark):
    rows = [(1, " q ", "a", None, "c", "d", 1, None), (2, "q", "a", "b", "c", "d", 9, "3"), (3, None, "a", "b", "c", "d", None, "b")]
    got = items.medmcqa(spark.createDataFrame(rows, "id int, question string, opa string, opb string, opc string, opd string, cop int, answer string")).collect()
    assert [(r.id, r.question, r.answer) for r in got] == [("1", "q", "B"), ("2", "q", "D"), ("3", "", "B")] and got[0].choices == ["a", None, "c", "d"]


def test_pubmedqa_items(spark):
    rows = [(11, "q", "{'contexts': ['one', 'two']}", "long", "Yes"), (12, "q", "plain", None, "perhaps"), (13, None, None, None, "maybe")]
    got = items.pubmedqa(spark.createDataFrame(rows, "pubid long, question string, context string, long_answer string, final_decision string")).collect()
    assert [tuple(r) for r in got] == [("11", "q", "one\n\ntwo", "{'contexts': ['one', 'two']}", "long", "yes"), ("13", "", "", "", "", "maybe")]


def test_mmlu_items(spark):
    rows = [("virology", 5, "q5", ["a"], "b"), ("virology", 2, "q2", ["a"], "0"), ("anatomy", 1, "q1", ["a"], "9"), ("law", 1, "q", ["a"], "1")]
    got = items.mmlu(spark.createDataFrame(rows, "subject string, position int, question string, choices array<string>, answer string")).collect()
    assert sorted((r.id, r.question, r.answer) for r in got) == [("anatomy_0", "q1", "9"), ("virology_0", "q2", "A"), ("virology_1", "q5", "B")]


@pytest.mark.parametrize(
    ("raw", "flat"),
    [
        ("{'contexts': ['a', \"it's\", 'b\\nc'], 'labels': ['X']}", "a\n\nit's\n\nb\nc"),
        ('{"contexts": ["he said \\"no\\"", " two "]}', 'he said "no"\n\ntwo'),
        ("{'contexts': [['nested', 1], 'x', '', None]}", "['nested', 1]\n\nx"),
        ("{'contexts': ['unclosed}", "{'contexts': ['unclosed}"),
        ("{'contexts': 'no list'}", "{'contexts': 'no list'}"),
        ("{'contexts': []}", "{'contexts': []}"),
        ("{'contexts': [open('x')]}", "{'contexts': [open('x')]}"),
        (" just contexts ", "just contexts"),
        ("{" * 5000 + " contexts", "{" * 5000 + " contexts"),
        (None, ""),
        ("", ""),
    ],
)
def test_flattened_contexts(spark, raw, flat):
    assert spark.createDataFrame([(raw,)], "t string").select(items.flatten_contexts("t")).first()[0] == flat


def test_retrieval_queries(spark):
    assert value(spark, items.retrieval_query(F.lit(" q "))) == "q"
    assert value(spark, items.retrieval_query(F.lit("q"), F.lit("c" * 900), 10)) == "q\n\n" + "c" * 500
    assert value(spark, items.retrieval_query(F.lit(None).cast("string"), F.lit("abs"))) == "abs" and value(spark, items.retrieval_query(F.lit("q"), F.lit(None).cast("string"))) == "q"
    assert value(spark, items.query_with_choices(F.lit("q"), F.lit('["one", " two "]'))) == "q\n\nAnswer choices:\none two"
    assert value(spark, items.query_with_choices(F.lit("q"), F.lit('{"B": "y", "A": "x"}'))) == "q\n\nAnswer choices:\nA. x B. y"
    assert value(spark, items.query_with_choices(F.lit("q"), F.lit("broken"))) == "q" and value(spark, items.query_with_choices(F.lit(""), F.lit('["x"]'))) == ""


# --- positions, capped scans, XML -------------------------------------------------------------


def test_positions_over_several_files(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 7).alias("x"))
    df.repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "a"))
    assert all(r.id == r.position for r in files.positioned(spark, str(tmp_path / "a")).collect())
    df.select(F.concat(F.lit("t"), "id").alias("t"), "id").repartitionByRange(3, "id").sortWithinPartitions("id").select("t").write.parquet(str(tmp_path / "b"))
    both = files.positional_join(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert len(both) == 1000 and all(r.t == f"t{r.id}" for r in both)


def test_positional_join_fails_on_unequal_counts(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a"))
    spark.range(11).select(F.col("id").alias("x")).write.parquet(str(tmp_path / "b"))
    for left, right in (("a", "b"), ("b", "a")):
        with pytest.raises(Exception, match="different numbers of rows"):
            files.positional_join(spark, str(tmp_path / left), str(tmp_path / right)).collect()


def test_capped_scan_leaves_files_unread(spark, tmp_path):
    paths = []
    for k in range(12):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"f{k:02d}"))
        paths.append(str(tmp_path / f"f{k:02d}"))
    for p in paths[5:]:  # a scan that opened these would fail
        for f in Path(p).glob("*.parquet"):
            f.write_bytes(b"broken")
    make = lambda rows: rows.where("id % 2 = 0").withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1))))
    for first, growth in ((1, 4), (3, 1), (5, 1)):
        got, read = files.capped_scan(spark, paths, make, 25, first, growth)
        assert read == (3 if first == 3 else 5)
        assert sorted((r.id, r._n) for r in got.collect()) == [(i, n) for i in range(0, 30, 2) for n in (0, 1)][:25]
    got, read = files.capped_scan(spark, paths[:5], make, 1000)
    assert got.count() == 50 and read == 5
    with pytest.raises(ValueError):
        files.capped_scan(spark, [], make, 5)


def test_xml_texts(spark, tmp_path):
    long = "A sentence that is longer than thirty characters."
    (tmp_path / "a.xml").write_text(f"<r xmlns='u'><Title>{long}</Title><p>short</p><sec>{long} tail<p>{long}<b>bold</b></p></sec><x>{long}</x></r>")
    (tmp_path / "b.xml").write_text(f"<r><p>{long}</p>")
    (tmp_path / "c.xml").write_text("<r/>")
    got = {r.path[-5:]: (r.text, r.ok) for r in files.xml_texts(spark, str(tmp_path / "*.xml")).collect()}
    assert got == {"a.xml": (f"{long}\n\n{long} tail\n\n{long}", True), "b.xml": ("", False), "c.xml": ("", True)}
    pick = lambda base, extra: value(spark, files.enriched(F.lit(base), F.lit(extra).cast("string")))
    assert (pick("x" * 10, "y" * 13), pick("x" * 10, "y" * 12), pick("x" * 10, None), pick("", "y")) == ("y" * 13, "x" * 10, "x" * 10, "y")


# --- sources and sinks ------------------------------------------------------------------------


def test_json_rows(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "dict.json").write_text('{"meta": {"a": 1}, "found": [{"k": 3}]}')
    (tmp_path / "none.json").write_text('{"meta": {"a": 1}, "n": 4}')
    assert [r.k for r in files.json_rows(spark, str(tmp_path / "list.json")).collect()] == [1, 2]
    assert [r.k for r in files.json_rows(spark, str(tmp_path / "dict.json")).collect()] == [3]
    for name in ("none", "dict"):
        with pytest.raises(ValueError):
            files.json_rows(spark, str(tmp_path / f"{name}.json"), "rows" if name == "dict" else None)


def test_batch_files_runs_and_profiles(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x_batch_1.csv").write_text("a\n1\n")
    (tmp_path / "y_batch_2.csv").write_text("a\n2\n3\n")
    (tmp_path / "z_batch_3_combined.csv").write_text("a\n9\n")
    (tmp_path / "other.csv").write_text("a\n8\n")
    assert sorted((r.a, r.source_file) for r in files.batch_files(spark, str(tmp_path)).collect()) == [("1", "x_batch_1.csv"), ("2", "y_batch_2.csv"), ("3", "y_batch_2.csv")]
    for k in (10, 9, 2):
        (tmp_path / f"run{k}.json").write_text(str(k))
    runs = files.newest_run(spark, str(tmp_path)).collect()
    assert [r.run for r in runs] == [2, 9, 10] and runs[0].sha256 == hashlib.sha256(b"2").hexdigest()
    rows = spark.createDataFrame([("a", "pubmedqa_1"), ("b", "x"), ("b", "y"), (None, "z")], "k string, source string")
    keys = spark.createDataFrame([("b",), ("b",), ("q",), (None,)], "k string")
    assert sorted(r.source for r in files.keyed_lookup(rows, keys, "k").collect()) == ["x", "y"]
    assert tuple(files.corpus_profile(rows).first()) == (4, 1)


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ünï")], "k int, t string")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()] == [{"k": 1, "t": "ünï"}]
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    judged = sinks.judged(spark.createDataFrame([(1, (4, 5)), (2, None)], "k int, judge_scores struct<a:int,b:int>")).collect()
    assert [tuple(r) for r in judged] == [(1, 4, 5, True), (2, None, None, False)]


def test_truth_and_embedder(spark):
    assert [value(spark, T.truth(F.lit(x))) for x in ("TRUE", " yes ", "1.0", "0", "", "no")] == [True, True, True, False, False, False]
    assert value(spark, T.truth(F.lit(None).cast("string"))) is False
    got = models.run_model(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, text string"), models.mock_embedder, "id string, embedding array<double>").collect()
    v = {r.id: r.embedding for r in got}
    assert v["a"] == v["b"] != v["c"] and all(abs(sum(x * x for x in y) - 1) < 1e-6 for y in v.values())


# --- BLEU and stems ---------------------------------------------------------------------------


def brute_bleu(p, r):
    p, r = p.split(), r.split()
    logs, matched, missed = [], 0, 0
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        total, hit = max(len(p) - n + 1, 0), sum((grams(p) & grams(r)).values())
        if total:
            matched += hit
            missed += not hit
            logs.append(math.log(hit / total if hit else 1 / (2**missed * total)))
    if not matched:
        return 0.0
    return math.exp(sum(logs) / len(logs)) * (math.exp(1 - len(r) / len(p)) if len(p) < len(r) else 1)


def test_bleu_equals_brute_force(spark):
    pairs = [("the cat sat on the mat", "the cat sat on a mat"), ("a", "a"), ("a", "b"), ("", "a"), ("a", ""), ("", ""), ("the the the the", "the cat"), ("a b c", "a b c d e f"), ("x y z w v", "x q z r v"), ("a b c d e", "a b c d e")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, p string, r string")
    got = {x.k: x.bleu for x in overlap.sentence_bleu(df, ["k"], "p", "r").collect()}
    assert got == {k: pytest.approx(brute_bleu(*p), abs=1e-6) for k, p in enumerate(pairs)}
    assert overlap.sentence_bleu(spark.createDataFrame([(1, None, "x")], "k int, p string, r string"), ["k"], "p", "r").first().bleu == 0.0


def test_bleu_tokens(spark):
    assert value(spark, overlap.bleu_tokens(F.lit("It's 3.5, well-known (a&amp;b)! 1990-01"))) == ["It's", "3.5", ",", "well-known", "(", "a", "&", "b", ")", "!", "1990", "-", "01"]


def test_stems():
    # words and stems that the algorithm's author gives as examples
    given = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
    tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
    radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
    sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
    gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
    homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
    assert [(w, stem(w)) for w in given[::2]] == list(zip(given[::2], given[1::2]))
    assert [stem(w) for w in ("", "a", "is", "y", "yy")] == ["", "a", "is", "y", "yy"]
    assert re.fullmatch("[a-z]+", stem("generalizations")) and stem("generalizations") == "gener"
