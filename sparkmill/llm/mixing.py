"""Mixing sources to target weights, with DataFrame operations only.

The words of each source, its documents laid end to end in a pseudorandom order, are cut into blocks
of a fixed number of words. A source has as many output slots as its target asks for, and each slot falls on a shard by an even
draw of its own: so the counts of a source over the shards are multinomial, given their total, and
every source's total is its quota, whatever its size. The n-th slot
of a source takes block n of the source under a keyed permutation of its blocks (a Feistel network on a grid
just as large as the range, walked on until it is back in the range), once round for each pass over the source. Slots and blocks meet by a join
on source and block index. No block is taken more than CAP times, so no document is either.

Sources by code point, null last, weigh WEIGHTS in turn. Their targets share `share` of all words; a
target stops at CAP times its source's words and the rest goes to the others by weight.

Defined results: documents without words have size 0 and are never taken; a null source is a source
of its own; all that is drawn hashes ids and a seed, so runs agree. Rows that repeat an id, text and
source are laid out one after the other, each with its own words. Columns of any name may accompany the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import WORD_PATTERN, written

BLOCK_WORDS, ROUNDS = 32, 4
#: Slots of a shard, about. Slots are made from stretches of slots, and those from long stretches, so that none comes of one task.
SHARD_SLOTS, STRETCH, LONG_STRETCH = 4096, 4096, 2**24
#: Slots that a task makes, about.
TASK_SLOTS = 100_000
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents that are laid out in one task, about.
RUN_DOCS = 4096


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def named(source: Column) -> Column:
    """A source's name, or that it has none."""
    return F.when(source.isNull(), "none").otherwise(F.concat(F.lit("="), source))


def unit(*parts: Column | str) -> Column:
    """A pseudorandom number in [0, 1) from what it hashes."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 11) / F.lit(float(2**53))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Targets stop at the cap where weight is large for the size: with the sources in rising order of
    size over weight, there is one level such that those before it get their cap and the others
    level times weight. Sums over that order give the level of every prefix at once.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # a row a source
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = F.array(*[F.lit(w) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(places, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        rows.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("capped", cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(after))
        # the first source, in that order, that its level leaves under its cap sets the level
        .withColumn("fits", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    )
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce(level * F.col("weight"), cap * F.col("source_size").cast("double")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, digest (of the text), size, start: where the document's words begin among those of its source.

    Documents are dealt by hash to runs of about RUN_DOCS; offsets add up within runs, and the runs'
    sums within their source, so that no task holds a whole source.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("digest"), F.xxhash64(F.lit("order"), id_col).alias("order"))
    runs = written(rows, "mix-sizes")
    counts = runs.groupBy("source").agg(F.ceil(F.count("*") / RUN_DOCS).alias("runs"))
    dealt = runs.join(counts, runs["source"].eqNullSafe(counts["source"])).select(runs["*"], F.pmod("order", "runs").alias("run"))
    sums = dealt.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    ahead = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "run", F.coalesce(F.sum("run_size").over(ahead), F.lit(0)).alias("run_start"))
    within = Window.partitionBy("source", "run").orderBy("order", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(starts, placed["source"].eqNullSafe(starts["source"]) & (placed["run"] == starts["run"])).select(
        "doc_id", placed["source"], "digest", "size", (F.col("run_start") + F.col("ahead")).alias("start")
    )


def plan(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row a source: its target, its number of blocks, and its number of slots."""
    rows = targets(sizes)
    blocks = F.ceil(F.col("source_size") / block_words)
    return rows.withColumn("blocks", blocks).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(F.lit(CAP) * blocks, F.col("target") * blocks / F.col("source_size"))).otherwise(F.lit(0.0))
    )


def dealt_slots(planned: DataFrame, seed: str, total: float) -> DataFrame:
    """s, blocks, at, shard: a row for each slot of each source. A quota's fraction is one more slot with that probability."""
    shards = max(1, math.ceil(total / SHARD_SLOTS))
    whole = F.floor("quota")
    rows = planned.select(named(F.col("source")).alias("s"), "blocks", "quota").where(F.col("quota") > 0)
    rows = rows.withColumn("n", F.least(CAP * F.col("blocks"), whole + (unit("rest", F.lit(seed), F.col("s")) < F.col("quota") - whole).cast("long")).cast("long")).where("n > 0")
    tasks = math.ceil(total / TASK_SLOTS) + 1
    for size in (LONG_STRETCH, STRETCH):  # few small rows become many: they are dealt out before that
        low, high = (F.lit(0), F.col("n")) if size == LONG_STRETCH else (F.col("low"), F.col("high"))
        start = F.explode(F.sequence(low.cast("long"), high - 1, F.lit(size).cast("long")))
        rows = rows.select("s", "blocks", "n", start.alias("low")) if size == LONG_STRETCH else rows.select("s", "blocks", "n", F.col("high").alias("end"), start.alias("low"))
        end = F.col("n") if size == LONG_STRETCH else F.col("end")
        rows = rows.select("s", "blocks", "n", "low", F.least(F.col("low") + size, end).alias("high")).repartition(tasks, "s", "low")
    slots = rows.select("s", "blocks", F.explode(F.sequence("low", F.col("high") - 1)).alias("at"))
    return slots.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "s", "at"), F.lit(shards)))


def shard_counts(planned: DataFrame, seed: str, total: float) -> DataFrame:
    """shard, source, n: how many of the shard's slots each source has."""
    counts = dealt_slots(planned, seed, total).groupBy("shard", "s").agg(F.count("*").alias("n"))
    return counts.join(planned.select("source", named(F.col("source")).alias("s")), "s").select("shard", "source", "n")


def slots(planned: DataFrame, seed: str, total: float) -> DataFrame:
    """shard, at, s, block, lap: the block of its source that each output slot takes."""
    rows = dealt_slots(planned, seed, total).withColumn("lap", F.floor(F.col("at") / F.col("blocks")).cast("int"))
    rows = rows.select("shard", "at", "s", "lap", "blocks", F.pmod("at", "blocks").alias("x"), F.xxhash64(F.lit(seed), F.col("s"), F.col("lap")).alias("key"))
    return permuted(rows).select("shard", "at", "s", "block", "lap")


def permuted(rows: DataFrame) -> DataFrame:
    """rows: x, blocks, key. Adds block: where a keyed permutation of 0..blocks-1 takes x.

    The grid has a columns and b rows, blocks cells at least and fewer than blocks + a. ROUNDS times a cell's column is
    moved on by a hash of its row, and then its row by a hash of its column; both can be undone, so cells are permuted.
    A cell beyond the range is permuted again until it is in it, which it is after as many steps as there are such cells at most.

    Each step is a column of its own: within one expression every step repeats those before it, and the driver copies and prints
    plans of tens of thousands of nodes each time that a stage ends.
    """
    a, b, n, key = map(F.col, ["a", "b", "blocks", "key"])
    rows = rows.withColumn("a", F.ceil(F.sqrt(n))).withColumn("b", F.ceil(n / a))
    rows = rows.withColumn("column", F.pmod(F.col("x"), a)).withColumn("row", F.floor(F.col("x") / a))

    def moved_column(column: Column, row: Column, step: Column) -> Column:
        return F.pmod(column + F.pmod(F.xxhash64(step, key, row), a), a)

    def moved_row(column: Column, row: Column, step: Column) -> Column:
        return F.pmod(row + F.pmod(F.xxhash64(step, key, column), b), b)

    for r in range(ROUNDS):
        rows = rows.withColumn("column", moved_column(F.col("column"), F.col("row"), F.lit(2 * r)))
        rows = rows.withColumn("row", moved_row(F.col("column"), F.col("row"), F.lit(2 * r + 1)))

    def round_(cell: Column, r: Column) -> Column:
        column = moved_column(cell["column"], cell["row"], 2 * r)
        return F.struct(column.alias("column"), moved_row(column, cell["row"], 2 * r + 1).alias("row"))

    def moved(z: Column) -> Column:
        start = F.struct(F.pmod(z, a).alias("column"), F.floor(z / a).alias("row"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda cell: cell["row"] * a + cell["column"])

    rows = rows.withColumn("once", F.col("row") * a + F.col("column"))
    walk = F.aggregate(F.sequence(F.lit(0), (a * b - n).cast("int")), F.col("once"), lambda z, _: F.when(z < n, z).otherwise(moved(z)))
    # never null, and said so: a join's own filter for nulls would bring the whole expression twice
    return rows.withColumn("block", F.coalesce(F.when(F.col("once") < n, F.col("once")).otherwise(walk), F.lit(-1)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents (doc_id, source, size, start), the sources' plan, and the output's slots."""
    placed = written(laid_out(docs, id_col, text_col, source_col), "mix-placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = written(plan(sizes, block_words), "mix-plan")
    total = planned.agg(F.sum("quota")).first()[0] or 0.0
    return placed, planned, slots(planned, seed, total)


def spans(placed: DataFrame, taken: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Join documents and taken blocks by source and block: doc_id, digest, s, start, size, block, words (of the block within the document), and taken's other columns.

    Slots and blocks are dealt by source and block index, so a large source spreads over all tasks.
    """
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = placed.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    begin = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    parts = parts.select("doc_id", "digest", named(F.col("source")).alias("s"), "start", "size", "block", (end - begin).alias("words"))
    # both sides grow with the corpus, though slots come of a small table
    return parts.hint("merge").join(taken.hint("merge"), ["s", "block"])


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    placed, planned, chosen = mix(docs, id_col, text_col, source_col, seed, block_words)
    # a block that is taken twice counts twice: counting before the join keeps it narrow
    times = chosen.groupBy("s", "block").agg(F.count("*").alias("times"))
    got = spans(placed, times, block_words)
    got = got.groupBy("s", "doc_id", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = placed.withColumn("s", named(F.col("source"))).join(got, ["s", "doc_id", "start", "size"], "left")
    aims = planned.select(named(F.col("source")).alias("s"), "source_size", "target")
    return rows.join(aims, "s", "left").select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def numbered(rows: DataFrame, keys: list[str], repeated: bool) -> DataFrame:
    """Rows that agree in keys get different numbers, so that each meets one other."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) if repeated else F.lit(1))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of docs: a row for each document and lap of which a block is taken.

    A row's text is the document's own where all its words are taken, else the words of its taken
    blocks, joined by single spaces. Documents of which nothing is taken are left out.
    """
    placed, _, chosen = mix(docs, id_col, text_col, source_col, seed, block_words)
    keys = ["id", "digest"]
    narrow = placed.where("size > 0").select(F.col("doc_id").alias("id"), "digest", named(F.col("source")).alias("s"), "start", "size")
    repeated = not narrow.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    laps = spans(placed, chosen, block_words).groupBy("s", "start", "lap").agg(F.sort_array(F.collect_set("block")).alias("blocks"), F.sum("words").alias("words"))
    # two laps at most; written, so that one plan doesn't hold the slots and the documents' texts both
    laps = written(laps.groupBy("s", "start").agg(F.collect_list(F.struct("lap", "blocks", "words")).alias("laps")), "mix-laps")
    found = numbered(narrow, keys, repeated).hint("merge").join(laps.hint("merge"), ["s", "start"]).select(*keys, "number", "start", "size", "laps")
    # the documents' own columns stay together, whatever their names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    rows = numbered(rows, keys, repeated).hint("merge").join(found.hint("merge"), [*keys, "number"]).withColumn("lap", F.explode("laps"))
    own = F.col("row").getField(text_col)
    words = F.regexp_extract_all(own, F.lit(f"({WORD_PATTERN})"), F.lit(1))

    def part(b: Column) -> Column:
        begin = F.greatest(b * block_words - F.col("start"), F.lit(0))
        return F.slice(words, (begin + 1).cast("int"), ((b + 1) * block_words - F.col("start") - begin).cast("int"))

    some = F.array_join(F.flatten(F.transform(F.col("lap.blocks"), part)), " ")
    text = F.when(F.col("lap.words") == F.col("size"), own).otherwise(some)
    return rows.select(*((text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
