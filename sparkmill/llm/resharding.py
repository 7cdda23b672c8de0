"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes, and rewrite only the files they touch.

A layout is a folder `shard=S/piece=P/` of Parquet files: rows are dealt to shards and pieces by a hash of doc_id, and
within a piece to blocks. Resharding to other capacities goes in four steps.

1. The blocks' sizes are added up from the columns `size` of the files, map-side first. A row larger than a 256th of the
   mean new shard is a block of its own, so there are at most 256 blocks an old shard and 256 a new one, whatever the
   table's size: that many rows reach the driver, and no more are broadcast.
2. `cheapest_flow` solves how many bytes go from each old shard to each new one: the sources give the old sizes, the
   sinks take the capacities, a byte that stays costs nothing, and one that moves costs 1 (or what the caller says).
3. `transfers` turns bytes into blocks: an old shard gives whole pieces while they fit, then blocks of one more, largest
   first, so that few files are touched; blocks go to the shards with the most room in the flow. While one move
   of a block from the shard furthest above its capacity to the one furthest below narrows a gap of over half a per cent of the mean, it is made.
4. Pieces that give a block are rewritten: what stays and what leaves goes to a new generation of the layout, without a
   shuffle. Pieces that give nothing are never read nor written: `Layout.rows` reads them where they are. An old
   generation is not changed, so a lost executor or an interrupted run leaves the old layout as it was.

Defined results: a null text has size 16 and the checksum of an empty text, a null id is dealt like any value. Rows equal
in id and text are in one block and go together, wherever they lie; a text shared by many ids spreads over all shards. Blocks of equal size keep
their order by shard, piece and key. An empty table has empty shards. Extra columns are carried along,
and may have any name: the layout keeps its own under a prefix that no column of the table starts with.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import shared_path, written

PIECES, BLOCKS = 16, 256
#: Blocks are moved until the shards are as full as each other, but for this part of the mean.
TOLERANCE = 0.005
#: Bytes of text that a task writes into a layout, about.
TASK_BYTES = 32 << 20
#: Rows of a shard that are numbered by one task, about.
NUMBERED_ROWS = 100_000


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text, and 16 for the rest of a row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def cheapest_flow(sizes: list[int], capacities: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from old shard i to new shard j, of least total cost, by successive shortest paths; capacities must hold all sizes.

    cost[i, j] is a byte's, whole and not negative; by default 0 for i = j and 1 otherwise. Paths are found over the residual graph, with
    potentials that keep its costs from falling below zero; each path carries all it can, and all are integers.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the capacities don't hold all bytes")
    n, m = len(sizes), len(capacities)
    if cost is None:
        cost = (np.arange(n)[:, None] != np.arange(m)).astype(np.int64)
    flow = np.zeros((n, m), np.int64)
    left, room = np.array(sizes, np.int64), np.array(capacities, np.int64)
    far = np.iinfo(np.int64).max // 4
    up, vp = np.zeros(n, np.int64), np.zeros(m, np.int64)  # potentials
    while left.any():
        # Dijkstra from all shards that have bytes left, over dense rows
        ud, vd = np.where(left > 0, 0, far), np.full(m, far)
        came_v, came_u = np.full(m, -1), np.full(n, -1)
        open_u, open_v = np.ones(n, bool), np.ones(m, bool)
        while True:
            u, v = int(np.where(open_u, ud, far).argmin()), int(np.where(open_v, vd, far).argmin())
            du, dv = (ud[u] if open_u[u] else far), (vd[v] if open_v[v] else far)
            if min(du, dv) >= far:
                break
            if du <= dv:
                open_u[u] = False
                way = du + cost[u] + up[u] - vp
                nearer = open_v & (way < vd)
                vd, came_v = np.where(nearer, way, vd), np.where(nearer, u, came_v)
            else:
                open_v[v] = False
                way = dv - cost[:, v] + vp[v] - up
                nearer = open_u & (flow[:, v] > 0) & (way < ud)
                ud, came_u = np.where(nearer, way, ud), np.where(nearer, v, came_u)
        up, vp = up + np.minimum(ud, far // 2), vp + np.minimum(vd, far // 2)
        reached = (room > 0) & (vd < far)
        end = int(np.where(reached, vp, far).argmin())
        path, v = [], end
        while True:
            u = int(came_v[v])
            path.append((u, v, 1))
            if came_u[u] < 0:
                break
            v = int(came_u[u])
            path.append((u, v, -1))
        carried = min([int(left[u]), int(room[end])] + [int(flow[a, b]) for a, b, sign in path if sign < 0])
        for a, b, sign in path:
            flow[a, b] += sign * carried
        left[u] -= carried
        room[end] -= carried
    return flow


def transfers(blocks: list[tuple[int, int, int, int]], flow: np.ndarray, capacities: list[int]) -> dict[int, int]:
    """blocks: (old shard, piece, key, bytes). The new shard of each block, by its place in the list, that realises the flow."""
    n, m = flow.shape
    target = [i if i < m else int(flow[i].argmax()) for i in range(n)]
    to = {k: target[b[0]] for k, b in enumerate(blocks)}
    by_shard: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, (old, piece, _, _) in enumerate(blocks):
        by_shard[old][piece].append(k)
    for old, pieces in by_shard.items():
        room = {j: int(flow[old, j]) for j in range(m) if j != target[old] and flow[old, j] > 0}
        leave = sum(room.values())
        going: list[int] = []
        for piece in sorted(pieces):
            own = sorted(pieces[piece], key=lambda k: (-blocks[k][3], k))
            whole = sum(blocks[k][3] for k in own) <= leave
            for k in own:
                if whole or blocks[k][3] <= leave:
                    going.append(k)
                    leave -= blocks[k][3]
            if not whole:
                break
        for k in sorted(going, key=lambda k: (-blocks[k][3], k)):
            to[k] = max(room, key=lambda j: (room[j], -j))
            room[to[k]] -= blocks[k][3]
    level(blocks, to, capacities)
    return to


def level(blocks: list[tuple[int, int, int, int]], to: dict[int, int], capacities: list[int]) -> None:
    """Move blocks from the shard furthest above its capacity to the one furthest below while that narrows a gap above the tolerance.

    Where the capacities hold more than there is, it is enough that no shard is above its own by over half the tolerance.
    """
    m = len(capacities)
    held: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    over = [-c for c in capacities]
    for k, j in to.items():
        held[j].append((blocks[k][3], k))
        over[j] += blocks[k][3]
    most, roomy = TOLERANCE * sum(b[3] for b in blocks) / m, sum(over) < 0
    full, empty = [(-s, j) for j, s in enumerate(over)], [(s, j) for j, s in enumerate(over)]
    heapq.heapify(full)
    heapq.heapify(empty)
    for _ in range(4 * len(blocks)):
        while -full[0][0] != over[full[0][1]]:
            heapq.heappop(full)
        while empty[0][0] != over[empty[0][1]]:
            heapq.heappop(empty)
        a, b = full[0][1], empty[0][1]
        gap = over[a] - over[b]
        # the block nearest to half the gap leaves the smallest
        fits = [x for x in held[a] if 0 < x[0] < gap]
        if gap <= most or (roomy and over[a] <= most / 2) or not fits:
            break
        size, k = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[a].remove((size, k))
        held[b].append((size, k))
        to[k] = b
        for j, change in ((a, -size), (b, size)):
            over[j] += change
            heapq.heappush(full, (-over[j], j))
            heapq.heappush(empty, (over[j], j))


def own_prefix(columns: list[str]) -> str:
    """A start that no column has, in any case."""
    name = "shardmill_"
    while any(c.lower().startswith(name) for c in columns):
        name = "_" + name
    return name


@dataclass
class Layout:
    """Folders of generations, oldest first; each has its pieces that a later one replaced, as shard * PIECES + piece."""

    generations: list[tuple[str, list[int]]]
    shards: int
    prefix: str
    schema: str
    moved_bytes: int = 0

    def rows(self, spark, columns: list[str] | None = None) -> DataFrame:
        """The table's columns, with the layout's own: <prefix>shard, piece, block, size, crc. Replaced folders are pruned, never read."""
        p, out = self.prefix, None
        for path, replaced in self.generations:
            df = spark.read.schema(self.schema).parquet(path)
            df = df.select(*columns) if columns else df
            if replaced:
                df = df.where(~(F.col(f"{p}shard") * PIECES + F.col(f"{p}piece")).isin(replaced))
            out = df if out is None else out.unionByName(df)
        return out


def lay_out(docs: DataFrame, shards: int) -> Layout:
    """Write docs (doc_id, text, more) as shards by a hash of doc_id. Folders are dealt to tasks by piece and a part of it that grows with the table."""
    spark, p = docs.sparkSession, own_prefix(docs.columns)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(shards * BLOCKS))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        *docs.columns,
        F.floor(bucket / BLOCKS).cast("int").alias(f"{p}shard"), (F.floor(bucket / (BLOCKS // PIECES)) % PIECES).cast("int").alias(f"{p}piece"), (bucket % BLOCKS).cast("int").alias(f"{p}block"),
        row_size(F.col("text")).alias(f"{p}size"), F.crc32(text.cast("binary")).alias(f"{p}crc"),
    )
    total = docs.agg(F.sum(row_size(F.col("text")))).first()[0] or 0
    tasks = max(shards, total // TASK_BYTES)
    # no more parts of a piece than tasks that can share its blocks
    salt = F.col(f"{p}block") % F.lit(min(BLOCKS // PIECES, 1 + tasks // (shards * PIECES)))
    path = shared_path(spark, "layout")
    own.repartition(tasks, F.col(f"{p}shard"), F.col(f"{p}piece"), salt).write.option("compression", "zstd").partitionBy(f"{p}shard", f"{p}piece").parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return Layout([(path, [])], shards, p, schema)


def reshard(spark, layout: Layout, capacities: list[int] | int, cost: np.ndarray | None = None) -> Layout:
    """The layout with new capacities in bytes, or as many shards of equal capacity: a new generation that holds the pieces that gave a block."""
    p = layout.prefix
    size = F.col(f"{p}size")
    rows = layout.rows(spark, [f"{p}shard", f"{p}piece", f"{p}block", f"{p}size", "doc_id", f"{p}crc"])
    sizes = [0] * layout.shards
    for r in rows.groupBy(f"{p}shard").agg(F.sum(size).alias("bytes")).collect():  # one row a shard
        sizes[r[0]] = r["bytes"]
    total = sum(sizes)
    if isinstance(capacities, int):
        capacities = [total // capacities + (j < total % capacities) for j in range(capacities)]
    large = max(1, total // (len(capacities) * BLOCKS))
    # a row above that is a block of its own: total / large of them at most
    key = F.when(size > large, F.xxhash64("doc_id", f"{p}crc", f"{p}size")).otherwise(F.col(f"{p}block"))
    place = [F.col(f"{p}shard").alias("shard"), F.col(f"{p}piece").alias("piece"), key.alias("key"), (size > large).alias("large")]
    found = rows.groupBy(*place).agg(F.sum(size).alias("bytes")).collect()
    found.sort(key=lambda r: tuple(r)[:4])
    blocks = [(r["shard"], r["piece"], r["key"], r["bytes"]) for r in found]
    to = transfers(blocks, cheapest_flow(sizes, capacities, cost), capacities)
    moving = [(r["shard"], r["piece"], r["key"], r["large"], to[k]) for k, r in enumerate(found) if to[k] != r["shard"]]
    if not moving:
        return Layout(layout.generations, len(capacities), p, layout.schema)
    touched = sorted({shard * PIECES + piece for shard, piece, *_ in moving})
    schema = f"{p}shard int, {p}piece int, {p}key long, {p}large boolean, {p}new int"
    plan = F.broadcast(spark.createDataFrame(moving, schema))  # no more rows than blocks
    old = layout.rows(spark).where((F.col(f"{p}shard") * PIECES + F.col(f"{p}piece")).isin(touched))
    keyed = old.withColumns({f"{p}key": key, f"{p}large": size > large})
    on = [f"{p}shard", f"{p}piece", f"{p}key", f"{p}large"]
    dealt = keyed.join(plan, on, "left").withColumn(f"{p}shard", F.coalesce(f"{p}new", f"{p}shard")).drop(f"{p}key", f"{p}large", f"{p}new")
    path = shared_path(spark, "layout")
    dealt.write.option("compression", "zstd").partitionBy(f"{p}shard", f"{p}piece").parquet(path)
    gone = set(touched)
    generations = [(where, sorted({*replaced, *gone})) for where, replaced in layout.generations]
    moved = sum(blocks[k][3] for k, j in to.items() if j != blocks[k][0])
    return Layout([*generations, (path, [])], len(capacities), p, layout.schema, moved)


def numbered(rows: DataFrame) -> DataFrame:
    """rows: doc_id, size, text_crc32, shard. One row each with slot, gapless from 0 within the shard.

    Equal rows are counted first. A shard's rows are dealt to parts by a hash, whose number grows with the table; parts are numbered each by a task, starting
    after the parts before them.
    """
    columns = ["doc_id", "size", "text_crc32", "shard"]
    once = written(rows.groupBy(*columns).agg(F.count("*").alias("n")), "shard-rows")
    per_shard = once.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(16, 1 << (int(per_shard) // NUMBERED_ROWS).bit_length())
    once = once.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    sums = once.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = once.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, ["shard", "part"])
    # equal rows come out of their count in bundles, dealt anew, so that a count of any size fits
    bundle = 4096
    few = first.where(F.col("n") == 1).select(*columns, (F.col("before") + F.col("at")).alias("slot"))
    many = first.where(F.col("n") > 1).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / bundle)))).repartition("doc_id", "k")
    each = F.explode(F.sequence(F.col("k") * bundle, F.least((F.col("k") + 1) * bundle, F.col("n")) - 1))
    return few.unionByName(many.withColumn("i", each).select(*columns, (F.col("before") + F.col("at") + F.col("i")).alias("slot")))
