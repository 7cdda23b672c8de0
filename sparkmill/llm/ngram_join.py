"""Exact Jaccard self-join on word n-grams by vertical partitioning.

Every document is the set of 64-bit hashes of its n-grams. One global order of n-grams, rare ones by hash before
those that are known to be frequent, is cut into FRAGMENTS; a set falls into a segment for each fragment, overlaps are counted
segment by segment, in separate rows, and sum up to a pair's intersection.

Which pairs are counted: two sets as alike as the threshold share one of their first n-grams in the
global order (the prefix), and their sizes and parity bitmaps differ little; both bounds are exact.
Documents with equal sets are one class from the start. An n-gram's bucket, the classes with it in their prefix, never turns
into all its pairs. First each bucket's smallest member meets the others. Then only buckets whose members the links found
so far leave in several components go on, with what is left of them: CENTRES members, and in each further round CENTRES times as many, meet
the others, and are done with; components are found anew after each round. Once no more than PAIRS_LEFT
pairs a class lie across components, those are looked at all together. Pairs within a component add nothing to
what a document can reach. What leaves a bucket are the pairs that sizes and bitmaps allow, nearly all of them links.

Defined results: words are runs of anything but ASCII white space, A-Z in lower case. A text with
fewer words than n is one n-gram, its whole word sequence; without words the set is empty and links
with nothing. Repeated ids are one node whose texts' links all count, and each row keeps its own n_shingles; their rows
without words still link with nothing. Only the id and text columns are read, under names of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import bytes_of, counted, discard, held, only_marked, parts_of, slices, written
from sparkmill.llm.components import merged

#: Words of an n-gram and the threshold, as a percentage.
WORDS, PERCENT = 3, 90
FRAGMENTS = 8
#: Bits of the smallest parity bitmap.
LEAST_BITS = 256
#: The order of n-grams is fitted on about SAMPLE_DOCS documents: what two of them or more share, up to FREQUENT_KEPT n-grams, comes last. Any order gives the same result.
SAMPLE_DOCS, FREQUENT_KEPT = 20_000, 500_000
#: Members of a bucket that meet all others in a round, and the pairs a class that are few enough to be looked at without further rounds.
CENTRES, PAIRS_LEFT = 8, 20
#: Members of a bucket that one task holds against its centres, about.
BLOCK_ROWS = 4096


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(h) - n + 1
    mixed = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[k : k + size]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def rank_of(s: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Place of each n-gram among the frequent ones (keys, sorted, with their places), from 1 on; 0 for the others."""
    if not len(keys):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return np.where(keys[at] == s, places[at] + 1, 0)


def frequent(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """N-grams that several documents of a sample share, rarest first. Which documents: those whose texts hash lowest, about; equal texts count once.

    The order only has to be the same everywhere for the join to be exact; what is kept bounds the broadcast.
    """
    total = docs.agg(F.count("*")).first()[0]
    part = max(1, int(min(1.0, SAMPLE_DOCS / max(total, 1)) * 2**48))
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(2**48)) < part).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [shingles(t, n) for t in set(bytes_of(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))], names=["g"])

    top = sample.mapInArrow(run, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "g").limit(FREQUENT_KEPT)
    return top.select("g").toArrow().column("g").to_numpy()[::-1].copy()


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, order) -> DataFrame:
    """doc_id, n_shingles, digest, parity and prefix of each row. The parity bitmap has a bit or two a member, a power of two in all: whether an even or odd number of members fall on each bit.

    order: a broadcast of the frequent n-grams, sorted, and their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngrams", dict)  # drops what other operators left
        keys, places = order.value
        for batch in slices(batches, 1, 1024):
            size, digest, parity, prefix = [], [], [], []
            for text in bytes_of(batch.column(1)):
                s = shingles(text, n)
                size.append(len(s))
                digest.append(set_digest(s) if len(s) else None)
                width = max(LEAST_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else LEAST_BITS
                bits = np.bincount(s & (width - 1), minlength=width) & 1
                parity.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                # sets of size m with the least overlap m * percent / 100 share one of the first m - that + 1
                first = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                prefix.append(s[np.lexsort((s, rank_of(s, keys, places)))][:first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array([p.tolist() for p in parity], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate([*prefix, np.empty(0, np.int64)]))),
                ],
                names=["doc_id", "n_shingles", "digest", "parity", "prefix"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, parity array<long>, prefix array<long>"), "shingle-signatures")


def alike_in_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def differing_bits(p: Column, q: Column) -> Column:
    """In how many bits two parity bitmaps differ; a longer one is folded to the length of the other. Nothing is said of more than twofold lengths."""
    short = F.least(F.size(p), F.size(q))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > short, F.zip_with(F.slice(x, F.lit(1), short), F.slice(x, short + 1, short), lambda a, b: a.bitwiseXOR(b))).otherwise(x)

    differ = F.aggregate(F.zip_with(folded(p), folded(q), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, bits: total + bits)
    return F.when(F.greatest(F.size(p), F.size(q)) <= 2 * short, differ).otherwise(0)


def may_link(na: Column, pa: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sizes and parity bitmaps allow a link: the number of bits in which two bitmaps differ is at most the number of n-grams in only one of the sets."""
    # 100 * i >= percent * (na + nb - i), so that na + nb - 2 * i is at most this
    most = na + nb - 2 * F.ceil(percent * (na + nb) / (100 + percent))
    return alike_in_size(na, nb, percent) & (differing_bits(pa, pb) <= most)


def fold_of(parity: Column) -> Column:
    """The parity bitmap of LEAST_BITS bits that a larger one folds to."""
    words = LEAST_BITS // 64
    every = lambda k: F.filter(parity, lambda _, i: i % words == k)
    return F.array(*[F.aggregate(every(k), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)) for k in range(words)])


def first_shared(nx: Column, ix: Column, px: Column, ny: Column, iy: Column, py: Column, percent: int) -> Column:
    """Whether two sets may link whose first shared n-gram has places ix and iy in them: what follows must hold the least overlap, and the folded bitmaps may not differ too much.

    A pair that links passes in the bucket of its first shared n-gram, and need not in others.
    """
    least = F.ceil(percent * (nx + ny) / (100 + percent))
    differ = sum((F.bit_count(px[k].bitwiseXOR(py[k])) for k in range(LEAST_BITS // 64)), F.lit(0))
    return alike_in_size(nx, ny, percent) & (F.least(nx - ix, ny - iy) >= least) & (differ <= nx + ny - 2 * least)


def segments_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int, order) -> DataFrame:
    """node, fragment, segment: of the sets of the wanted nodes, made again from their texts. The last fragment has the frequent n-grams, the others equal shares of the order of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = order.value
        for batch in slices(batches, 2, 512):
            nodes, fragment, segment = [], [], []
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2)), strict=True):
                s = shingles(text, n)
                if set_digest(s) != digest:
                    continue  # another text of a repeated id
                often = rank_of(s, keys, places) > 0
                rare = s[~often]
                cuts = np.searchsorted(rare, [-(1 << 63) + (k << 64) // (FRAGMENTS - 1) for k in range(1, FRAGMENTS - 1)])
                for k, part in enumerate([*np.split(rare, cuts), s[often]]):
                    if len(part):
                        nodes.append(node), fragment.append(k), segment.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(fragment, pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, segment)]), pa.int32()), pa.array(np.concatenate([*segment, np.empty(0, np.int64)])))],
                names=["node", "fragment", "segment"],
            )

    one, count = counted(wanted.join(sets, "node").select("node", "digest", F.col("least").alias("doc_id")), "wanted")
    likely = only_marked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", one, "doc_id", count)
    texts = likely.join(one, "doc_id").select("node", "digest", "text").coalesce(parts_of(docs, count, 4000))
    return texts.mapInArrow(run, "node long, fragment int, segment array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Returns id_col, n_shingles, component_id, and class_id: the smallest id with the same set (its own, if that is empty)."""
    often = frequent(docs, text_col, n)
    by_hash = np.argsort(often, kind="stable")
    order = docs.sparkSession.sparkContext.broadcast((often[by_hash], by_hash.astype(np.int64)))
    rows = signatures(docs, id_col, text_col, n, percent, order)
    filled = rows.where("n_shingles > 0")
    distinct = filled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"))
    sets, classes = counted(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("fold", fold_of(F.col("parity"))), "sets")
    parity = sets.select("node", "n", "parity")
    parts = parts_of(docs, classes, 20_000)

    def verified(likely: DataFrame) -> DataFrame:
        """likely: a, b, na, nb. Those whose overlaps, counted by fragment and summed, reach the threshold."""
        wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).coalesce(parts).distinct().coalesce(parts)
        segments = written(segments_of(docs, sets.select("node", "digest", "least"), wanted, id_col, text_col, n, order), "segments")
        left = segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("sa"))
        right = segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("sb"))
        each = likely.withColumn("fragment", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
        # a fragment of which either has nothing adds nothing; rows that repeat an id and text give a segment twice
        met = each.join(left, ["a", "fragment"]).coalesce(parts).join(right, ["b", "fragment"])
        shared = met.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).alias("shared")).coalesce(parts).distinct().coalesce(parts)
        total = shared.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        found = written(total.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b").coalesce(parts), "links-found")
        discard(segments)
        return found

    member = sets.select("node", "n", "fold", F.posexplode("prefix").alias("i", "g"))
    buckets, some = counted(member.groupBy("g").agg(F.count("*").alias("k"), F.min(F.struct("node", "n")).alias("first")).where("k > 1").select("g", "first").coalesce(parts), "buckets")
    # most n-grams of prefixes are one class's own: they go before the join
    member = written(only_marked(member, "g", buckets, "g", some).join(buckets, "g").coalesce(parts), "prefix-members")
    # first pass: each bucket's smallest member and the others
    pairs = member.where((F.col("node") != F.col("first.node")) & alike_in_size(F.col("n"), F.col("first.n"), percent)).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct().coalesce(parts)
    one, two = parity.toDF("a", "na", "pa"), parity.toDF("b", "nb", "pb")
    ends = may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
    likely = written(pairs.join(one, "a").coalesce(parts).join(two, "b").where(ends).select("a", "b", "na", "nb").coalesce(parts), "likely-pairs")
    seen = likely.select("a", "b")
    # sets that may link lie in one band of sizes or in two that follow each other, so a member stands in its own band's bucket and in the next one's
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * 1.000001)) if percent < 100 else F.col("n")
    banded = member.where(F.col("node") != F.col("first.node")).select("g", "node", "n", "i", "fold", band.alias("band")).withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    rest = banded.select(F.xxhash64("g", F.when(F.col("own"), F.col("band")).otherwise(F.col("band") + 1)).alias("g"), "node", "n", "i", "fold", "own")
    component = merged(sets.select("node", F.col("node").alias("component")), verified(likely).union(same_ids(filled, sets)), classes)

    round_ = 0
    while True:
        # what is left of the buckets that mix components
        placed = rest.join(component, "node").select("g", "node", "n", "i", "fold", "own", "component").coalesce(parts)
        mixed = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k"), F.bool_or("own").alias("owned")).where("low <> high and owned").select("g", "k")
        placed = written(placed.join(mixed, "g").coalesce(parts), "mixed-members")
        sums = placed.groupBy("g", "component").agg(F.count("*").alias("k")).coalesce(parts)
        across = sums.groupBy("g").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("within"))
        left = across.agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2)).first()[0] or 0
        if not left:
            break
        last = left <= PAIRS_LEFT * classes
        chance = F.pmod(F.xxhash64("g", "node", F.lit(round_)), F.lit(2**30)) / F.lit(float(2**30)) * F.col("k") < float(CENTRES ** (round_ + 1))
        whole = placed.withColumn("centre", F.lit(True) if last else chance).withColumn("blocks", F.ceil(F.col("k") / BLOCK_ROWS).cast("int"))
        # a large bucket lies in blocks, each of which meets the centres
        centres = whole.where("centre").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("fold").alias("px"), F.col("own").alias("ox"), F.col("component").alias("cx"))
        others = whole.select("g", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("fold").alias("py"), F.col("own").alias("oy"), F.col("component").alias("cy"), F.col("centre").alias("other"))
        # two centres meet once, and a pair in the bucket of the higher band of the two
        once = (~F.col("other") | (F.col("x") < F.col("y"))) & (F.col("ox") | F.col("oy"))
        met = centres.join(others, (centres["g"] == others["g"]) & (centres["block"] == others["block"]) & (F.col("cx") != F.col("cy")) & once & first_shared(*map(F.col, ["nx", "ix", "px", "ny", "iy", "py"]), percent))
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).coalesce(parts).distinct().coalesce(parts)
        fresh = pairs.join(seen, ["a", "b"], "left_anti").coalesce(parts)
        likely, some = counted(fresh.join(one, "a").coalesce(parts).join(two, "b").where(ends).select("a", "b", "na", "nb").coalesce(parts), "likely-pairs")
        if some:
            component = merged(component, verified(likely), classes)
            seen = seen.union(likely.select("a", "b"))
        if last:
            break
        rest = placed.withColumn("centre", chance).where("NOT centre").select("g", "node", "n", "i", "fold", "own")
        round_ += 1

    named = sets.join(component, "node").select("digest", "least", "component")
    reached = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(reached, "component").select("digest", F.col("least").alias("class_id"), "smallest")
    return rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def same_ids(filled: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between the sets of ids that have several."""
    several = filled.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id", "low")
    nodes = sets.select("digest", "node")
    both = filled.select("doc_id", "digest").join(several, "doc_id").where("digest <> low").distinct()
    return both.join(nodes, "digest").join(nodes.toDF("low", "a"), "low").select("a", F.col("node").alias("b"))
