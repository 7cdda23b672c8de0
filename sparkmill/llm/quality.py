"""Quality rules: document statistics, hard rules, and gradient-boosted trees over the statistics.

The trees are fitted here, on histograms of a bounded labelled sample, with logistic loss. Splits on
a constrained statistic are allowed only in the direction asked for, and bounds handed down to the
children keep the whole tree monotone. The fitted forest lies flat in numpy arrays (statistic,
threshold, left child, leaf value), and a batch of rows moves down all trees together.

Defined results: a null text has no words and all counts 0; texts without words fail the base rules.
Without labelled rows of both classes the verdict is that of the base rules alone. Repeated rows
each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import slices, texts_of

#: Bound of the labelled sample.
SAMPLE_ROWS = 8000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 60, 3, 32, 0.15, 40
#: A text is rejected if the trees give good quality less than this probability.
LEAST_QUALITY = 0.5

# The characters that count as symbols, and the ASCII separators of words.
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\v\f\r"

STATISTICS = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share", "mean_line_words"]
#: +1: quality may only rise with the statistic, -1: only fall.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1}

_digits, _upper, _punct = re.compile(r"\d").findall, re.compile(r"[A-Z]").findall, re.compile(r"[.,;:!?]").findall


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    n = len(hashes)
    if n < 4:
        return 0
    with np.errstate(over="ignore"):
        a = hashes * np.uint64(0x9E3779B97F4A7C15)
        b = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        c = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
        windows = (a[:-2] ^ (a[:-2] >> np.uint64(32))) + b[1:-1] * np.uint64(3) + c[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the values of STATISTICS."""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    dup = len(lines) - len(set(lines))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    repeat = repeated_words(hashes)
    w, chars = max(n, 1), max(word_chars, 1)
    more = [n, word_chars / w, symbols / w, dup / max(len(lines), 1), repeat / w, len(set(words)) / w, len(_upper(text)) / chars, len(_digits(text)) / chars, len(_punct(text)) / w, n / max(len(lines), 1)]
    return [n, word_chars, symbols, dup, repeat], more


@dataclass
class FlatForest:
    """Nodes of all trees in one set of arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray  # the right child follows it
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[at] >= 0
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray) -> FlatForest:
    """Boost TREES trees of DEPTH on logistic loss; monotone holds -1, 0 or 1 for each column."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), base)
    roots, feature, threshold, left, value = [], [], [], [], []

    def add() -> int:
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
        return len(feature) - 1

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + 1.0), low, high))

    def grow(node: int, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float, depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = RATE * leaf(g, h, low, high)
        if depth == 0 or len(rows) < 2 * LEAST_ROWS:
            return
        best = (1e-3, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            n = np.bincount(binned[rows, f], minlength=size).cumsum()[:-1]
            gs = np.bincount(binned[rows, f], grad[rows], size).cumsum()[:-1]
            hs = np.bincount(binned[rows, f], hess[rows], size).cumsum()[:-1]
            a, b = np.clip(gs / (hs + 1), low, high), np.clip((g - gs) / (h - hs + 1), low, high)
            gain = gs * a - (hs + 1) * a * a / 2 + (g - gs) * b - (h - hs + 1) * b * b / 2
            ok = (n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS) & ((b - a) * monotone[f] >= 0)
            if ok.any():
                k = int(np.where(ok, gain, -np.inf).argmax())
                gained = gain[k] - (g * leaf(g, h, low, high) - (h + 1) * leaf(g, h, low, high) ** 2 / 2)
                if gained > best[0]:
                    best = (gained, (f, k, a[k], b[k]))
        if best[1] is None:
            return
        f, k, a, b = best[1]
        middle = (a + b) / 2
        feature[node], threshold[node], left[node] = f, float(cuts[f][k]), add()
        add()
        down = binned[rows, f] <= k
        one, two = (low, high), (low, high)
        if monotone[f] > 0:
            one, two = (low, middle), (middle, high)
        elif monotone[f] < 0:
            one, two = (middle, high), (low, middle)
        grow(left[node], rows[down], grad, hess, *one, depth - 1)
        grow(left[node] + 1, rows[~down], grad, hess, *two, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(add())
        start = roots[-1]
        grow(start, np.arange(len(y)), y - p, p * (1 - p), -np.inf, np.inf, DEPTH)
        tree = FlatForest(np.array([start]), np.array(feature), np.array(threshold), np.array(left), np.array(value), 0.0, DEPTH)
        margin += tree.margin(x)
    return FlatForest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), base, DEPTH)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> FlatForest | None:
    """Fit on at most sample_rows labelled texts, those whose ids hash lowest; None without both classes."""
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # the limit bounds the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            rows = [statistics(t)[1] for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    got = sorted((tuple(r.x), r.y) for r in texts.select("text", "y").mapInArrow(run, "y int, x array<double>").collect())
    y = np.array([k for _, k in got], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([x for x, _ in got]), y, np.array([MONOTONE.get(s, 0) for s in STATISTICS]))


def judge_documents(docs: DataFrame, forest: FlatForest | None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, least: float = LEAST_QUALITY) -> DataFrame:
    """Returns id_col, extra's columns, the five counts, base_failed, quality (the trees' probability) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    rows = docs.select(id_col, *(c.alias(k) for k, c in (extra or {}).items()), F.col(text_col).alias("_text"))
    names = rows.columns[:-1]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: FlatForest | None = shared.value
        for batch in slices(batches, len(names)):
            got = [statistics(t) for t in texts_of(batch.column(len(names)))]
            base = np.array([b for b, _ in got], np.int64)
            quality = trees.probability(np.array([x for _, x in got])) if trees else np.ones(len(got))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            columns = [batch.column(k) for k in range(len(names))] + [pa.array(base[:, k]) for k in range(5)]
            columns += [pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= least))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *counts, "base_failed", "quality", "kept"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"{c} long" for c in counts]
    return rows.mapInArrow(run, ", ".join([*fields, "base_failed boolean", "quality double", "kept boolean"]))
