"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learnt on a bounded sample: each starts from a random rotation of the centred sample's
principal axes and alternates between the signs of the rotated sample and the rotation that best
turns the sample into those signs (an orthogonal Procrustes problem). The signs are a balanced
binary code. The codes' substrings are the Hamming tables: vectors that agree in one
substring meet, and their cosine is computed in double precision from the vectors themselves. Substrings grow with the
logarithm of the table, so that a bucket holds some BUCKET_ROWS vectors at any size, and tables are added as longer
substrings agree less often; short vectors get more rotations to fill them.

Equal vectors are one class from the start, with a count. A bucket of a table may be large: its rows
are dealt to blocks, and each pair of blocks is a task of its own, which returns a row for each of its
vectors that has links, never its pairs: how many vectors it links with, and a link to the smallest vector of its group
there. A pair that agrees in several tables counts in the first of them only.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are kept. Vectors whose lengths differ never link. Equal vectors link with each other.
A repeated id is a vector for each of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import written
from sparkmill.llm.components import stars

LEAST_COSINE = 0.95
#: Bound of the sample that the rotations are learnt on.
SAMPLE_ROWS = 4000
TABLES, LEAST_CHUNK_BITS, ITERATIONS = 16, 16, 30
#: Vectors of a bucket, on average, from which substrings get longer; and the chance that a bit of two vectors at the least cosine agrees, by their angle.
BUCKET_ROWS, AGREEING = 64, 0.9
#: Vectors of a bucket that one task compares with as many others.
BLOCK_ROWS = 1024


def tables_for(rows: int) -> tuple[int, int]:
    """Bits of a substring, and tables, for so many vectors."""
    bits = max(LEAST_CHUNK_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))
    return bits, math.ceil(TABLES * AGREEING ** (LEAST_CHUNK_BITS - bits))


def learn_rotations(x: np.ndarray, rotations: int, iterations: int = ITERATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the sample, and one matrix a rotation that turns a centred vector into what its code is the sign of."""
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ axes
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(iterations):
            signs = np.where(projected @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(projected.T @ signs)
            r = u @ v
        out.append(axes @ r)
    return mean, np.stack(out)


def codes_of(x: np.ndarray, mean: np.ndarray, rotations: np.ndarray, chunk_bits: int, tables: int) -> np.ndarray:
    """Substrings of the codes: a column of chunk_bits bits a table. The rotations' bits suffice for all tables; those beyond are left out."""
    bits = np.concatenate([(x - mean) @ r >= 0 for r in rotations], 1)[:, : chunk_bits * tables]
    powers = 1 << np.arange(chunk_bits, dtype=np.int64)
    return bits.reshape(len(x), tables, chunk_bits) @ powers


def usable(column: str):
    x = F.col(column)
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(broken, F.lit(True)) & F.exists(x, lambda v: v != 0)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each of n places under the links a-b."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


RESULT = ["rep", "links", "root"]


def wide(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def reported(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each place with links: how many vectors it links with, and the smallest id of its group."""
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    has = links > 0
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][roots_of(len(ids), place[a], place[b])][place]
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(root[has])], names=RESULT)


def compared(keys: np.ndarray, side: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, codes: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Whole tasks, one after the other: small ones together, by the distance of two rows in the run, large ones as products of matrices."""
    t = keys[:, 0]
    starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(keys)]])
    size = np.diff(starts)
    task = np.repeat(np.arange(len(size)), size)
    small = np.nonzero((size <= 64)[task])[0]
    a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        """Pairs that agree in no earlier table, and of two blocks only those that lie across."""
        for d in range(codes.shape[1]):
            new = (t[a] <= d) | (codes[a, d] != codes[b, d])
            a, b = a[new], b[new]
        a_all.append(a), b_all.append(b)

    crossed = keys[:, 2] != keys[:, 3]
    for k in range(1, 64):
        a, b = small[:-k], small[k:]
        same = task[a] == task[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        a, b = (v[~crossed[a] | (side[a] != side[b])] for v in (a, b))
        near = np.einsum("ij,ij->i", x[a], x[b]) >= least
        keep(a[near], b[near])
    for n in np.nonzero(size > 64)[0]:
        rows = np.arange(starts[n], starts[n + 1])
        one, two = (rows[side[rows] == 0], rows[side[rows] == 1]) if crossed[rows[0]] else (rows, rows)
        for at in range(0, len(one), 256):
            near = x[one[at : at + 256]] @ x[two].T >= least
            if two is one:
                near &= np.arange(len(two))[None, :] > np.arange(at, at + len(near))[:, None]
            a, b = np.nonzero(near)
            keep(one[a + at], two[b])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    if len(a):
        yield reported(ids, copies, a, b)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Returns id_col, n_links, component_id and kept for every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = rows.where(usable("v")).select("vec_id", F.transform("v", lambda c: c.cast("double") + F.lit(0.0)).alias("v"))
    classes = written(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "vector-classes")
    dims = classes.groupBy("dim").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "dim").collect()
    parts = [_found(classes.where(F.col("dim") == r.dim), r.dim, r.k, least, sample_rows) for r in dims]
    none = rows.sparkSession.createDataFrame([], "rep long, links long, root long")
    found = none
    for p in parts:
        found = found.union(p)
    found = written(found, "vector-links")
    members = good.join(classes, "v").select("vec_id", "rep", "copies")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # ids that repeat with other vectors hold their classes together, so members' links count as well
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    repeated = members.groupBy("vec_id").agg(F.countDistinct("rep").alias("k"), F.min("rep").alias("a")).where("k > 1")
    edges = edges.union(members.join(repeated, "vec_id").select("a", F.col("rep").alias("b")))
    component = stars(edges)
    member = members.join(linked, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("vec_id", F.col("rep"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    bad = rows.where(~usable("v")).select("vec_id", F.col("vec_id").alias("rep"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.union(bad).select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _found(classes: DataFrame, dim: int, count: int, least: float, sample_rows: int) -> DataFrame:
    """rep, links, root: for the classes of one vector length."""
    spark = classes.sparkSession
    sample = [r.v for r in classes.orderBy(F.xxhash64("v"), "rep").limit(sample_rows).select("v").collect()]
    x = np.array(sample, np.float64).reshape(len(sample), dim)
    peak = np.abs(x).max(1, keepdims=True)
    x = x / peak
    bits, tables = tables_for(count)
    model = spark.sparkContext.broadcast(learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), math.ceil(bits * tables / dim)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rotations = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, dim)
            v = v / np.abs(v).max(1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            c = codes_of(v, mean, rotations, bits, tables)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim), pa.int32()), pa.array(v.ravel()))
            chunks = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]), pa.int32()), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wide, chunks], names=["rep", "copies", "unit", "codes"])

    coded = written(classes.select("rep", "copies", "v").mapInArrow(code, "rep long, copies long, unit array<double>, codes array<long>"), "vector-codes")
    entries = coded.select("rep", F.posexplode("codes").alias("t", "key"))
    buckets = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    entries = entries.join(buckets, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("rep", "t"), "blocks").cast("int"))
    # a block meets itself and each other block of its bucket: it is copied once for each
    partner = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    tasks = entries.select("rep", "t", "key", "block", F.explode(partner).alias("p")).select("rep", "t", "key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.when(F.col("block") == F.col("p.i"), 0).otherwise(1).alias("side"))
    full = tasks.join(coded, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; whole tasks are taken together, the last of a batch waits for the next batch."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [np.column_stack([batch.column(k).to_numpy() for k in range(4)]), *(batch.column(k).to_numpy() for k in (4, 5, 6)), wide(batch.column(7)), wide(batch.column(8))]
            if held is not None:
                got = [np.concatenate(v) for v in zip(held, got)]
            last = len(got[0]) - int((got[0] == got[0][-1]).all(1)[::-1].cumprod().sum())
            if last:
                yield from compared(*(v[:last] for v in got), least)
            held = [v[last:] for v in got]
        if held is not None:
            yield from compared(*held, least)

    ordered = full.select("t", "key", "i", "j", "side", "rep", "copies", "unit", "codes").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return ordered.mapInArrow(run, "rep long, links long, root long")
