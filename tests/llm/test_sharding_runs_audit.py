"""op11 to op13 against brute force: nulls, empties, long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmill.llm import filter_audit, queries, resharding, run_detection

DOCS = "doc_id long, text string, lang string, source string, shard int, size long, part string, mask int, runs string"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 7, 8, "p", 9, "r") for i, t, lang in rows], DOCS)


def save(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


# --- op12 -------------------------------------------------------------------------------------


def brute_runs(words):
    """By definition: every maximal stretch of every period, if that is the stretch's smallest."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            smaller = any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p))
            if length >= max(6, 4 * p) and not smaller:
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        words += (unit * 8)[: rng.randrange(1, 30)]
        words += [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
    return words


def run_rows(texts):
    numbers = {}
    codes = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
    return run_detection.runs_of(np.concatenate(codes), np.array([len(c) for c in codes], np.int64))


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    texts = [periodic_words(rng) for _ in range(400)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 200, list("ab") * 4, list("ab") * 3 + ["a"]]
    want = [brute_runs(t) for t in texts]
    assert sum(map(len, want)) > 300
    assert run_rows(texts) == want
    monkeypatch.setattr(run_detection, "CHUNK_PAIRS", 50)
    assert run_rows(texts) == want


def test_runs_survive_equal_hashes(monkeypatch):
    """Hashes that are often equal by accident change nothing, as words verify what they say."""
    rng = random.Random(4)
    texts = [periodic_words(rng) for _ in range(150)]
    monkeypatch.setattr(run_detection, "PRIME", np.int64(3))
    assert run_rows(texts) == [brute_runs(t) for t in texts]


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a a a a a a", "a\x0ba\x0ca\ra\ta\na", "a a a a a a a", "x y " * 40, "é é é é é é é"] + [" ".join(periodic_words(rng)) for _ in range(60)]
    texts += [texts[3], " ".join(f"w{k}" for k in range(500)), " ".join(["u v w x y"] * 30 + [f"w{k}" for k in range(300)])]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, texts[3], None), (3, texts[3], None)]
    save(docs_of(spark, rows), tmp_path, "documents")
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = [brute_digest(i, t) for i, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows) >= 3
    save(docs_of(spark, [(None, "a a a a a a a", None)]), tmp_path, "documents")
    assert [r.n_runs for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()] == [1]
    save(docs_of(spark, []), tmp_path, "documents")
    assert queries.op12_periodic_runs(spark, str(tmp_path)).collect() == []


def test_periodic_runs_of_a_very_long_text(spark):
    words = [f"w{k}" for k in range(60_000)] + ["p", "q", "r"] * 20_000 + ["z"] * 20_000
    got = run_detection.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(60_000, 60_000, 3), (120_000, 20_000, 1)]
    assert len(got.collapsed.split()) == 60_000 + 3 + 1


# --- op13 -------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    masks = []
    for i, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        own = [x for x in labels if x[0] == i and i is not None]
        masks.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                here = [m for m in mine if m[1][f] and not any(m[1][x] for x in order[:step])]
                kept = sum(not any(m[1][x] for x in order[: step + 1]) for m in mine)
                removed_by[f] += len(here)
                out[part, order, step + 1] = [kept, len(here), sum(m[1][f] for m in mine) - len(here), sum(m[1][f] and sum(m[1].values()) == 1 for m in mine), sum(m[2] for m in here), sum(m[3] for m in here)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def audit_rows(rng):
    many = [" ".join(f"w{rng.randrange(90 + 200 * (k % 2))}" for _ in range(60 + 15 * (k % 6))) for k in range(30)]
    texts = [None, "", " \n", "A B C", "A" * 9 + "b" * 81, "Ab" + "c" * 18, "# x", "100%", "é É Ü" * 40] + many
    texts += [many[3]] * 9 + [many[4].upper()] * 3 + [many[5] + " #"] * 2 + [""]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, rng.choice(["en", "de", "", None])) for i, t in zip(ids, texts)]
    rows += [rows[12], rows[12], (None, many[3], "en"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows[::2]] + [(rows[0][0], 1, 0), (None, 1, 1), (5000, 1, 1)]
    return rows, labels


def test_filter_audit_equals_brute_force_and_sql(spark, tmp_path):
    rows, labels = audit_rows(random.Random(8))
    save(docs_of(spark, rows), tmp_path, "documents")
    save(spark.createDataFrame(labels, LABELS), tmp_path, "labels")
    got = {tuple(r) for r in queries.op13_filter_audit(spark, str(tmp_path)).collect()}
    assert got == brute_audit(rows, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names = ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert set(con.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.ORACLE_SQL})").fetchall()) == got


def test_filter_audit_of_nothing(spark, tmp_path):
    save(docs_of(spark, []), tmp_path, "documents")
    save(spark.createDataFrame([], LABELS), tmp_path, "labels")
    assert queries.op13_filter_audit(spark, str(tmp_path)).collect() == []
    save(docs_of(spark, [(1, "x", None)]), tmp_path, "documents")
    got = queries.op13_filter_audit(spark, str(tmp_path)).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.good_lost for r in got} == {0}


def test_audit_of_three_filters(spark):
    rows = spark.createDataFrame([("p", 0b101, True, False), ("p", 0, False, False), ("q", 0b010, False, True)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, "XYZ").collect()}
    assert len(got) == 2 * 6 * 3
    assert (got["p", "XYZ", 1].removed, got["p", "XYZ", 3].removed, got["p", "XYZ", 3].redundant, got["p", "ZYX", 1].good_lost) == (1, 0, 1, 1)
    assert got["p", "XYZ", 1].shapley == 3 and got["q", "XYZ", 2].unique_fails == 1


# --- op11 -------------------------------------------------------------------------------------


def residual_has_cheaper(flow, cost, room):
    """Whether some cycle in the residual graph, a common sink included, lowers the cost."""
    n, m = flow.shape
    edges = []
    for i in range(n):
        for j in range(m):
            edges.append((i, n + j, cost[i, j]))
            if flow[i, j]:
                edges.append((n + j, i, -cost[i, j]))
    for j in range(m):
        if room[j]:
            edges.append((n + j, n + m, 0))
        if flow[:, j].any():
            edges.append((n + m, n + j, 0))
    far = [0] * (n + m + 1)
    for _ in range(n + m + 1):
        changed = False
        for a, b, c in edges:
            if far[a] + c < far[b]:
                far[b], changed = far[a] + c, True
        if not changed:
            return False
    return True


def test_flow_is_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 7, 2)
        sizes = rng.integers(0, 50, n)
        capacities = rng.multinomial(sizes.sum() + int(rng.integers(0, 20)), [1 / m] * m)
        cost = rng.integers(0, 6, (n, m))
        flow = resharding.cheapest_flow(sizes.tolist(), capacities.tolist(), cost)
        assert (flow >= 0).all() and (flow.sum(1) == sizes).all() and (flow.sum(0) <= capacities).all()
        assert not residual_has_cheaper(flow, cost, capacities - flow.sum(0))
    sizes, capacities = [90, 10, 50, 0], [40, 40, 40, 30]
    flow = resharding.cheapest_flow(sizes, capacities)
    assert flow.sum() - np.trace(flow) == sum(max(0, s - c) for s, c in zip(sizes, capacities))
    with pytest.raises(ValueError):
        resharding.cheapest_flow([5], [4])


def check_shards(got, rows, spread=None):
    want = Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), dict.fromkeys(range(40), 0)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if spread:
        assert max(sizes.values()) - min(sizes.values()) <= spread * sum(sizes.values()) / 40


def test_reshard_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, "x" * rng.randrange(1, 400), "en") for k in range(4000)]
    rows += [(10_000 + k, "the same text in a third of all rows " * 5, None) for k in range(2000)]
    rows += [(None, "no id", None), (None, None, None), (20_000, None, None), (20_001, "", None), (20_002, "ü" * 5000, None)] + [rows[7]] * 3
    save(docs_of(spark, rows), tmp_path, "documents")
    got = queries.op11_reshard(spark, str(tmp_path)).collect()
    check_shards(got, rows, 0.02)
    assert sorted(got, key=repr) == sorted(queries.op11_reshard(spark, str(tmp_path)).collect(), key=repr)
    few = [(1, "a", None), (1, "a", None), (2, "b" * 9999, None)]
    save(docs_of(spark, few), tmp_path, "documents")
    check_shards(queries.op11_reshard(spark, str(tmp_path)).collect(), few)
    save(docs_of(spark, []), tmp_path, "documents")
    assert queries.op11_reshard(spark, str(tmp_path)).collect() == []


def folder_files(path):
    return {str(f) for f in Path(path.removeprefix("file://")).rglob("*.parquet")}


def test_reshard_rewrites_only_what_it_touches(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(k, "y" * rng.randrange(50, 150), f"u{k}", k % 3) for k in range(5000)], "doc_id long, text string, url string, shardmill_shard int")
    old = resharding.lay_out(df, 8)
    assert old.prefix == "_shardmill_"
    before = folder_files(old.generations[0][0])
    sizes = {r[0]: r[1] for r in old.rows(spark).groupBy("_shardmill_shard").agg(F.sum("_shardmill_size")).collect()}
    # two shards give a little, one takes it, five are left alone
    capacities = [sizes[j] for j in range(8)]
    capacities[0] -= 4000
    capacities[1] -= 2000
    capacities[2] += 6000
    new = resharding.reshard(spark, old, capacities)
    assert folder_files(old.generations[0][0]) == before
    assert 5000 <= new.moved_bytes <= 6000
    replaced = new.generations[0][1]
    assert replaced and {x // resharding.PIECES for x in replaced} == {0, 1} and len(replaced) <= 6
    assert sorted(new.rows(spark).select(*df.columns).collect()) == sorted(df.collect())
    after = {r[0]: r[1] for r in new.rows(spark).groupBy("_shardmill_shard").agg(F.sum("_shardmill_size")).collect()}
    assert all(abs(after[j] - capacities[j]) <= 600 for j in range(8))
    plan = new.rows(spark)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [NOT" in plan
    # nothing to move: nothing is written
    assert resharding.reshard(spark, new, [after[j] for j in range(8)]).generations == new.generations
    assert resharding.reshard(spark, new, [after[j] + 500 for j in range(8)]).generations == new.generations
    grown = resharding.reshard(spark, new, 10)
    spread = [r[1] for r in grown.rows(spark).groupBy("_shardmill_shard").agg(F.sum("_shardmill_size")).collect()]
    assert len(spread) == 10 and max(spread) - min(spread) <= 0.02 * sum(spread) / 10
    assert sorted(grown.rows(spark).select(*df.columns).collect()) == sorted(df.collect())
    bound = sum(max(0, after[j] - sum(spread) // 10) for j in range(8))
    assert grown.moved_bytes <= bound * 1.02
