"""Periodic run detection: maximal stretches of words that repeat with a period, by a harmonic grid of comparisons.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), at least max(6, 4 q)
words long, which no neighbouring word extends with period q. Within such a run the words equal to the word p
places on make a stretch of max(6, 4 p) - p words or more, so for each period p only every so manieth word i need be
compared with word i + p: about n log n / 3 pairs of a text of n words. All pairs of a slice of documents are handled
together in numpy: prefix hashes tell by binary search how far the equality reaches forwards and backwards, words
then verify what was found, and stretches found under several periods stay with the smallest.

Hashes modulo 2^31 - 1 never find too short a stretch. One that is too long fails the verification, and the text's
stretches of that period are then found word by word, so results are exact.

Defined results: a null or empty text has no run and an empty collapsed text. A null id is passed through. Runs of
equal exponent keep their order by start, then period. Repeated rows each get their row, an empty table gives an empty
one, and columns besides doc_id and text are neither read nor returned, whatever their names. A long text is one row of
one task, whose memory grows with its words: pairs are made in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import bytes_of, slices

#: Shortest run, and how many periods it must hold.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs that are compared at once, and bytes of text in a slice.
CHUNK_PAIRS, CHUNK_BYTES = 1 << 20, 1 << 20

PRIME, BASE = np.int64(2**31 - 1), np.int64(1_103_515_245)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


class PrefixHashes:
    """Sums of word numbers times powers of a base, modulo a prime: equality of any two stretches in a few operations."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.ones(n + 1, np.int64)
        done, top = 1, BASE  # top is BASE to the power of done
        while done <= n:
            more = min(done, n + 1 - done)
            powers[done : done + more] = powers[:more] * top % PRIME
            top, done = top * top % PRIME, done + more
        self.powers = powers
        self.sums = np.concatenate([np.zeros(1, np.int64), np.cumsum((codes + 1) * powers[:-1] % PRIME)])

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of so many words from i and from j > i have equal hashes."""
        first = (self.sums[i + length] - self.sums[i]) % PRIME * self.powers[j - i] % PRIME
        return first == (self.sums[j + length] - self.sums[j]) % PRIME

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words after (step 1) or before (step -1) i and j are equal, `most` at most: one binary search for all pairs."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            same = self.equal(i, j, mid) if step > 0 else self.equal(i - mid, j - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def grid(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, word) of all grid points of documents that begin at starts, in chunks."""
    periods = np.where(lengths >= LEAST_WORDS, lengths // LEAST_PERIODS, 0)
    ends = np.cumsum(periods)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        some = np.arange(at, min(at + CHUNK_PAIRS, total))
        doc = np.searchsorted(ends, some, side="right")
        period = some - (ends[doc] - periods[doc]) + 1
        step = least_length(period) - period
        points = (lengths[doc] - period - 1) // step + 1
        upto = np.cumsum(points)
        taken = max(int(np.searchsorted(upto, CHUNK_PAIRS, side="right")), 1)
        doc, period, step, points, upto = doc[:taken], period[:taken], step[:taken], points[:taken], upto[:taken]
        k = np.arange(upto[-1]) - np.repeat(upto - points, points)
        yield np.repeat(doc, points), np.repeat(period, points), np.repeat(starts[doc], points) + k * np.repeat(step, points)
        at += taken


def stretches(codes: np.ndarray, period: int) -> list[tuple[int, int]]:
    """(start, end) of all maximal stretches with this period that are long enough, word by word."""
    same = np.concatenate([[False], codes[:-period] == codes[period:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    found = [(int(s), int(e) + period) for s, e in zip(edges[::2], edges[1::2])]
    return [(s, e) for s, e in found if e - s >= least_length(period)]


def runs_of(codes: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each of the documents whose word numbers follow each other in codes: its runs (start, length, period), by start, then period."""
    starts = np.cumsum(lengths) - lengths
    hashes = PrefixHashes(codes)
    found = []
    for doc, period, i in grid(lengths, starts):
        near = codes[i] == codes[i + period]
        doc, period, i = doc[near], period[near], i[near]
        first, last = starts[doc], starts[doc] + lengths[doc] - period - 1
        # the stretch of equal words has three words at least, so one beside i is equal too
        beside = ((i < last) & (codes[np.minimum(i + 1, last)] == codes[np.minimum(i + 1, last) + period])) | ((i > first) & (codes[np.maximum(i - 1, first)] == codes[np.maximum(i - 1, first) + period]))
        doc, period, i = doc[beside], period[beside], i[beside]
        if not len(i):
            continue
        j = i + period
        end = j + hashes.reach(i, j, starts[doc] + lengths[doc] - j, 1)
        start = i - hashes.reach(i, j, i - starts[doc], -1)
        long = end - start >= least_length(period)
        if long.any():
            found.append(np.unique(np.stack([start[long], end[long], period[long], doc[long]], 1), axis=0))
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    if not found:
        return out
    settled: dict[tuple[int, int], int] = {}
    scanned: set[tuple[int, int]] = set()
    # by start, end and period: the first period that holds is the stretch's smallest, and later ones are its multiples
    for start, end, period, doc in np.unique(np.concatenate(found), axis=0).tolist():
        if (start, end) in settled and period % settled[start, end] == 0:
            continue
        if np.array_equal(codes[start : end - period], codes[start + period : end]):
            settled[start, end] = period
            out[doc].append((start - int(starts[doc]), end - start, period))
        else:
            scanned.add((doc, period))
    for doc, period in sorted(scanned, key=lambda x: x[1]):  # hashes that were equal by accident
        first = int(starts[doc])
        held = {(s, n): p for s, n, p in out[doc]}
        for s, e in stretches(codes[first : first + int(lengths[doc])], period):
            held[s, e - s] = min(held.get((s, e - s), period), period)
        out[doc] = [(s, n, p) for (s, n), p in held.items()]
    for one in out:
        one.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when of each run only the first period does."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, rearranged: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """docs: doc_id, text. Per row doc_id, runs (word number of the start, length, period; by start, then period), collapsed.

    collapsed holds the words, joined by one space, without those that a run holds after its first period. rearranged may
    give, for a doc_id and a number of words, the word numbers that a text's words are replaced by before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1, most=CHUNK_BYTES):
            ids = batch.column(0).to_pylist()
            numbers: dict[bytes, int] = {}
            words, codes = [], []
            for doc_id, text in zip(ids, bytes_of(batch.column(1))):
                own = text.split()  # at the six ASCII separators
                code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
                order = rearranged(doc_id, len(own)) if rearranged and own else None
                if order is not None:
                    own, code = [own[k] for k in order.tolist()], code[order]
                words.append(own)
                codes.append(code)
            found = runs_of(np.concatenate(codes), np.array([len(c) for c in codes], np.int64))
            collapsed = []
            for own, runs in zip(words, found):
                if runs:
                    stay = kept_words(len(own), runs)
                    own = [own[k] for k in np.flatnonzero(stay).tolist()]
                collapsed.append(b" ".join(own))
            of_runs = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of_runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
