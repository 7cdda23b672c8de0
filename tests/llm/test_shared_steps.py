"""Steps that several operators share: bitmaps before joins, components that grow, vocabularies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmill.llm import bpe, common
from sparkmill.llm.components import merged, stars


@pytest.mark.parametrize("most", [1 << 24, 1 << 6])
def test_marks_never_drop_what_is_wanted(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_MARKS", most)
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("_at"), (F.col("id") % 3).alias("_wordy"))
    keys = spark.range(0, 20_000, 97).select((F.col("id") + 5).alias("key"))
    got = {r.k: r for r in common.only_marked(rows, "k", keys, "key", keys.count()).collect()}
    wanted = {k for k in range(5, 20_000, 97)}
    assert wanted <= set(got) and next(iter(got.values())).asDict().keys() == {"k", "_at", "_wordy"}
    if most > 1 << 6:
        assert len(got) < len(wanted) + 20_000 / 8 and {r._at for r in got.values()} == {"x"}
    assert common.only_marked(rows, "k", keys.where("key < 0"), "key", 0).count() == 0


def test_components_that_grow_equal_components_of_all_links(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    nodes = spark.range(300).select(F.col("id").alias("node"), F.col("id").alias("component"))
    step, at = nodes, 0
    for size in (60, 1, 0, 159):
        some = spark.createDataFrame(links[at : at + size], "a long, b long")
        step, at = merged(step, some), at + size
    whole = {r.node: r.component for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {r.node: r.component for r in step.collect()} == {k: whole.get(k, k) for k in range(300)}


def test_components_settle_without_a_round_that_changes_nothing(spark, monkeypatch):
    """Each table of links is a round for the driver to plan: links that one round makes stars of take that one, none take none."""
    made = []
    monkeypatch.setattr(common, "shared_path", lambda session, label, path=common.shared_path: made.append(label) or path(session, label))
    links = [(1, k) for k in range(2, 40)] + [(50, k) for k in range(51, 60)]
    got = {r.node: r.component for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {k: 50 for k in range(50, 60)} and made == ["links"] * 2
    made.clear()
    assert stars(spark.createDataFrame([(7, 7)], "a long, b long")).collect() == [] and made == ["links"]


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.PrefixBpe(json.dumps({"model": {"vocab": {"a": 0, "b": 1}, "merges": []}, "added_tokens": []}).encode())
