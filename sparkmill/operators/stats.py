"""Statistics: bootstrap intervals from hashed draws, exact McNemar, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.sources.shared import written


#: Values that a task holds at once (32 MB), and those of a row that carries them.
SPAN, CHUNK = 1 << 22, 1 << 14


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with i, their number within the group by an order, from 0; ranges are numbered each by its own task, so no group is one task's."""
    ranged = written(rows.repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()), "bootstrap-ranges")
    counts = ranged.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = written(counts.select(group, "_p", before.alias("_before")), "bootstrap-starts")
    at = F.row_number().over(Window.partitionBy(group, "_p").orderBy(order)) - 1 + F.col("_before")
    return ranged.join(before, [group, "_p"]).withColumn("i", at).drop("_p", "_before")


def bootstrap_ci(values: DataFrame, group: str, value: str, order: str, resamples: int = 2000, alpha: float = 0.05, seed: str = "17") -> DataFrame:
    """group, mean, low, high: percentile bootstrap of the mean; draw j of resample b takes row hash(seed, group, b, j) mod n.

    A draw is never a row: a group's values are packed, sent to each of some ranges of resamples, and a task hashes its resamples' draws and adds up what they take.
    Of a group of more than SPAN values a task has a part, and partial sums are added; each part hashes all draws anew.
    """
    import pyarrow as pa

    from sparkmill.operators.draws import adder

    sums, span = adder(), SPAN
    rows = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    rows = written(numbered(rows, "g", "o").select("g", "v", "i"), "bootstrap-values")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    packs = rows.groupBy("g", F.floor(F.col("i") / SPAN).alias("span"), F.floor(F.col("i") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("vs"))
    ranges = min(resamples, max(32, 4 * values.sparkSession.sparkContext.defaultParallelism))
    lead = F.concat_ws("-", F.lit(seed), "g", F.lit(""))
    keys = ["g", "span", "part"]
    sent = packs.join(F.broadcast(sizes), "g").select("g", "span", "chunk", "n", lead.alias("lead"), "vs", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part")).repartition(4 * ranges, *keys)

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        at = t.column("part")[0].as_py()
        b = at * resamples // ranges, (at + 1) * resamples // ranges
        held = t.column("vs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        s = sums(t.column("lead")[0].as_py().encode(), b, t.column("n")[0].as_py(), held, t.column("span")[0].as_py() * span)
        return pa.table([pa.array([t.column("g")[0].as_py()] * len(s), t.schema.field("g").type), pa.array(range(*b), pa.int32()), pa.array(s)], names=["g", "b", "s"])

    of = sent.groupBy(*keys).applyInArrow(added, f"g {rows.schema['g'].dataType.simpleString()}, b int, s double")
    means = of.groupBy("g", "b").agg(F.sum("s").alias("s")).join(F.broadcast(sizes), "g").select("g", "b", (F.col("s") / F.col("n")).alias("m"))
    at = means.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("m", "b")) - 1)
    low, high = int(alpha / 2 * resamples), min(int((1 - alpha / 2) * resamples), resamples - 1)
    ends = at.groupBy("g").agg(F.max(F.when(F.col("k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("m"))).alias("high"))
    return sizes.join(ends, "g").select(F.col("g").alias(group), "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; null without any. Sums binomial terms in log space."""
    n, m = b + c, F.least(b, c)
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), m),
        F.struct((n * F.log(F.lit(0.5))).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] + F.log((n - i) / (i + 1))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * terms))


def mean_std(value: Column) -> list[Column]:
    """Mean and sample standard deviation, 0 for one value."""
    return [F.round(F.avg(value), 6).alias("mean"), F.when(F.count(value) > 0, F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6)).alias("std")]


def agreement(pairs: DataFrame, a: str, b: str, tolerance: float = 10) -> DataFrame:
    """n, r, mae and the share within tolerance, over pairs of which neither is missing."""
    full = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    gap = F.abs(F.col(a) - F.col(b))
    return full.agg(F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("r"), F.round(F.avg(gap), 6).alias("mae"), F.round(F.avg((gap <= tolerance).cast("double")), 6).alias("within"))


# --- ranks ------------------------------------------------------------------------------------


def tie_ranks(counts: DataFrame, value: str, n: str = "n", parts: int = 0) -> DataFrame:
    """counts with rank: the mean rank that the n equal rows of a value have among all, from 1.

    counts has a value once, with the number of rows it stands for, so ties of any size are one row. Values are dealt to ranges, ranges are numbered each by its own task,
    and a range starts after the sums of those before it, of which there are as many as ranges.
    """
    spark = counts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(parts, value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sorted((r["_part"], r["s"]) for r in ranged.groupBy("_part").agg(F.sum(n).alias("s")).collect())  # one row a range
    before, starts = 0, []
    for part, s in sums:
        starts.append((part, before))
        before += s
    first = F.broadcast(spark.createDataFrame(starts, "_part int, _before long"))
    earlier = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum(n).over(earlier), F.lit(0))
    return ranged.join(first, "_part").withColumn("rank", at + (F.col(n) + 1) / 2).drop("_part", "_before")


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho: Pearson's r of mean ranks, null for fewer than two pairs or a column without variance. Pairs with a null or NaN don't count."""
    full = pairs.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    cells = written(full.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    ranks = lambda c: tie_ranks(cells.groupBy(c).agg(F.sum("n").alias("n")), c).select(c, F.col("rank").alias(f"r{c}"))
    middle = (cells.agg(F.sum("n")).first()[0] or 0) / 2 + 0.5
    x, y = F.col("ra") - middle, F.col("rb") - middle
    s = cells.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * x * y).alias("xy"), F.sum(F.col("n") * x * x).alias("xx"), F.sum(F.col("n") * y * y).alias("yy"))
    return s.select(F.col("n").cast("long").alias("n"), F.round(F.when((F.col("n") > 1) & (F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))), 6).alias("rho"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by a rational approximation whose error is below 1.5e-7 / 2."""
    # fixed values: constants of the approximation of erf
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-z * z / 2)


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n (differences other than 0), w_plus, w_minus, z, p (two-sided, by the normal approximation with the correction for ties); z and p null without any."""
    d = pairs.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d is not null and not isnan(d) and d <> 0")
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    r = tie_ranks(sizes, "size")
    t = F.col("n").cast("double")
    s = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("n") - F.col("up")) * F.col("rank")), F.lit(0.0)).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    m = F.col("n").cast("double")
    z = F.when(m > 0, (F.least("w_plus", "w_minus") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48))
    return s.withColumn("z", z).select(F.col("n").cast("long").alias("n"), "w_plus", "w_minus", F.round("z", 6).alias("z"), F.round(F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), 2 * normal_tail(F.abs("z")))), 5).alias("p"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of two columns of labels; kappa null where expected is 1. Pairs with a null don't count."""
    cells = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n{c}"))
    chance = side("a").join(side("b"), "label").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("chance"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    s = total.crossJoin(chance).withColumn("observed", F.when(F.col("n") > 0, F.col("same") / F.col("n"))).withColumn("expected", F.when(F.col("n") > 0, F.col("chance") / F.col("n") / F.col("n")))  # two rows of one
    return s.select(F.col("n").cast("long").alias("n"), F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))), 6).alias("kappa"))


def icc(scores: DataFrame, target: str, rater: str, score: str) -> DataFrame:
    """targets, raters, icc: two-way random effects, absolute agreement, single rater. Targets that not every rater scored once are left out.

    Mean squares come of sums by target and by rater, over scores less their grand mean.
    """
    rows = scores.select(F.col(target).alias("t"), F.col(rater).alias("r"), F.col(score).cast("double").alias("x")).where("t is not null and r is not null and x is not null and not isnan(x)")
    k = rows.select("r").distinct().count()
    full = rows.groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("r").alias("d")).where((F.col("n") == k) & (F.col("d") == k)).select("t")
    rows = written(rows.join(full, "t", "left_semi"), "ratings")
    n, mean = rows.agg(F.count_distinct("t"), F.avg("x")).first()
    x = rows.withColumn("x", F.col("x") - F.lit(mean or 0.0))
    square = lambda by: x.groupBy(by).agg(F.sum("x").alias("s")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias(by))
    s = square("t").crossJoin(square("r")).crossJoin(x.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("all")))  # rows of one
    rows_ms, columns_ms = F.col("t") / k / (n - 1), F.col("r") / n / (k - 1)
    error = (F.col("all") - F.col("t") / k - F.col("r") / n) / ((n - 1) * (k - 1))
    if n < 2 or k < 2:
        return s.select(F.lit(n).cast("long").alias("targets"), F.lit(k).cast("long").alias("raters"), F.lit(None).cast("double").alias("icc"))
    below = rows_ms + (k - 1) * error + F.lit(k) * (columns_ms - error) / n
    return s.select(F.lit(n).cast("long").alias("targets"), F.lit(k).cast("long").alias("raters"), F.round(F.when(below > 0, (rows_ms - error) / below), 6).alias("icc"))
