"""Connected components of a graph of links, as a table, without gathering it anywhere.

Alternates large-star and small-star steps (Kiverie et al., "Connected components in MapReduce and
beyond"): each step replaces a node's links by links to the smallest node it knows, so every
component ends as a star around its smallest node. Each round is written to the shared folder, and
deleted once the next one is. Each round is judged by the links it gives, not by another round. A graph that isn't settled after ROUNDS rounds is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import counted, discard, parts_of, written

ROUNDS = 60


def linked(links: DataFrame) -> tuple[DataFrame, int]:
    """links: a, b. Returns u, v, and how many rows: for every node that reaches a smaller one, u, the smallest that it reaches, v."""
    edges, count = counted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(ROUNDS):
        if not count:
            break
        # stages of few rows get few tasks, whatever the session's shuffle partitions are
        parts = parts_of(edges, count)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        # large star: what is larger than the node hangs on its smallest neighbour
        large = edges.select(F.col("v").alias("node"), F.col("u").alias("larger")).join(least.withColumnRenamed("u", "node"), "node").select(F.col("larger").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(parts).distinct().coalesce(parts)
        # small star: a node's smaller neighbours, and itself, hang on the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(small_least, "u").select(F.col("v").alias("x"), "m").where("x <> m").coalesce(parts).union(small_least.select(F.col("u").alias("x"), "m"))
        after, count = counted(small.select(F.col("x").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts), "links")
        discard(edges)
        edges = after
        if settled(edges, parts_of(edges, count)):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges, count


def settled(edges: DataFrame, parts: int) -> bool:
    """Whether every node hangs on one other, and no centre on any: a further round would give the same links, so none is run to see that."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1))).coalesce(parts)
    each = ends.groupBy("node").agg((F.sum("hangs") + F.max("holds")).alias("k"), F.max("hangs").alias("hangs")).coalesce(parts)
    return each.where("hangs = 1").agg(F.max("k")).first()[0] == 1


def stars(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component for every node that has a link, component being the smallest node it reaches.

    Links of a node to itself count for nothing; an empty table gives an empty table.
    """
    edges, count = linked(links)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v").alias("component")).distinct()).coalesce(parts_of(edges, count))


def merged(component: DataFrame, links: DataFrame, nodes: int | None = None) -> DataFrame:
    """component (node, component; every node once) after further links (a, b): only the components that links join are looked at anew. nodes: how many there are, if known."""
    parts = parts_of(component, component.count() if nodes is None else nodes)
    label = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    joined = links.coalesce(parts).join(label("a"), "a").coalesce(parts).join(label("b"), "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).where("a <> b").coalesce(parts)
    renamed = linked(joined)[0].select(F.col("u").alias("component"), F.col("v").alias("_into"))
    return written(component.join(renamed, "component", "left").select("node", F.coalesce("_into", "component").alias("component")).coalesce(parts), "components")
