"""Overlap of a prediction with a reference by n-grams: sentence BLEU, as counts that Spark joins and adds up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4

# The tokeniser of the usual BLEU scripts, as replacements made one after the other.
TOKENISER = [
    (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
    (r"([{-~\[-` -&(-+:-@/])", r" $1 "), (r"([^0-9])([.,])", r"$1 $2 "), (r"([.,])([^0-9])", r" $1 $2"), (r"([0-9])(-)", r"$1 $2 "),
]


def bleu_tokens(text: Column) -> Column:
    bare = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), TOKENISER[:7], F.coalesce(text, F.lit("")))
    cut = reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), TOKENISER[7:], F.concat(F.lit(" "), bare, F.lit(" ")))
    return F.filter(F.split(cut, r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def sentence_bleu(pairs: DataFrame, key: list[str], prediction: str, reference: str) -> DataFrame:
    """key, bleu (0 to 1) of each pair of texts.

    Precisions of 1- to 4-grams, each gram counted no more often than the reference has it; an order without a match counts as one over
    twice, four times, ... its grams, orders that the prediction is too short for don't count, and a prediction shorter than the reference is
    penalised. 0 where nothing matches, or either text has no token. Keys must be unique. Grams are counted by groups, so no row holds more than its own text's.
    """
    rows = pairs.select(*key, F.explode(F.array(*[F.struct(F.lit(side).alias("side"), bleu_tokens(F.col(c)).alias("t")) for side, c in ((0, prediction), (1, reference))])).alias("_s")).select(*key, "_s.*")
    sizes = rows.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.size("t"))).alias("np"), F.max(F.when(F.col("side") == 1, F.size("t"))).alias("nr"))
    orders = rows.withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(ORDER)))).where(F.size("t") >= F.col("o"))
    grams = orders.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("o") + 1), lambda i: F.array_join(F.slice("t", i, F.col("o")), " "))))
    counts = grams.groupBy(*key, "o", "g").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("r"))
    right = counts.groupBy(*key).agg(*[F.sum(F.when(F.col("o") == n, F.least("p", "r")).otherwise(0)).alias(f"m{n}") for n in range(1, ORDER + 1)])
    s = sizes.join(right, key, "left").fillna(0, [f"m{n}" for n in range(1, ORDER + 1)])
    total, missed = F.lit(0.0), F.lit(0)
    for n in range(1, ORDER + 1):
        grams_n, matched = F.greatest(F.col("np") - (n - 1), F.lit(0)), F.col(f"m{n}")
        missed = missed + F.when((grams_n > 0) & (matched == 0), 1).otherwise(0)
        share = F.when(matched > 0, matched / grams_n).otherwise(1 / (F.pow(F.lit(2.0), missed) * grams_n))
        total = total + F.when(grams_n > 0, F.log(share)).otherwise(0.0)
    penalty = F.when(F.col("np") < F.col("nr"), F.exp(1 - F.col("nr") / F.col("np"))).otherwise(1.0)
    score = F.when(F.col("m1") + F.col("m2") + F.col("m3") + F.col("m4") == 0, 0.0).otherwise(penalty * F.exp(total / F.least(F.col("np"), F.lit(ORDER))))
    return s.select(*key, F.round(score, 6).alias("bleu"))
