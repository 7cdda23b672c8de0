"""Toxicity by nearest labelled passages.

What makes a text toxic is a few words of it; the cosine of whole texts drowns them. So labelled
texts are indexed by passage, and a text is scored passage by passage. A passage is a word, as a
TF-IDF vector over its n-grams: its beginnings of EDGES letters and the whole word. Equal passages are
held once, with the number of labelled texts of either class that hold them; near copies among these
texts count once. No term is left out for what it says of the classes.

Passages are held in the order of their letters, in blocks of BLOCK. An inverted index has, for each
term and block, the largest weight of the term there, and the postings. The exact NEIGHBOURS nearest
passages of LEAST_COSINE or more come from visiting blocks in falling order of the bound that the largest
weights give, until it falls below what is already found. Neighbours vote with their texts of either
class, weighted by distance; the log odds of the two, each as a share of its class, are the passage's
evidence. A document's evidence is that of its BEST passages, as far as it speaks for label 1. A
logistic fit on leave-one-out evidence of labelled texts, weighted to the class rates, turns it into a
probability. The best passages, their nearest labelled texts and cosines are given as the reason.

Bounds: the labelled sample has per_class distinct texts a class, of any length, those whose texts hash lowest; the
passages of the index are those of two sample texts or more, a passage of one text alone proving nothing.

Defined results: a null or empty text, or one of whose passages none speaks for label 1, scores what
no evidence scores. Without labelled rows of both classes every score is the rate of label 1 (0.0
without labels). Repeated rows each get their row. Ties between neighbours go to the passage that is
first in code point order. Only the named columns are read, under names of their own; others are passed on if `keep` names them.
"""

from __future__ import annotations

import math
import pickle
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import discard, held, slices, texts_of, written

#: Bound of the labelled sample: distinct texts a class; those of them that the calibration scores again.
SAMPLE_PER_CLASS, CALIBRATED_PER_CLASS = 1500, 300
EDGES = (3, 4, 5, 6)
NEIGHBOURS, LEAST_COSINE, BLOCK = 32, 0.3, 64
#: Passages that a document is judged by.
BEST = 2
THRESHOLD = 0.7
#: Distinct passages whose evidence a worker keeps from one slice of rows to the next.
REMEMBERED = 150_000
#: Passages whose neighbours are looked up at once, and postings of their terms that are laid out together (those of one passage always are).
LOOKED_UP, LAID_OUT = 2000, 1 << 17
#: Rows, and bytes of text, that a worker splits into passages at once.
SPLIT_ROWS, SPLIT_BYTES = 64, 500_000

_words = re.compile(r"\w+").findall


def passages_of(text: str) -> set[str]:
    return set(_words(text.lower()))


def terms_of(passage: str) -> list[str]:
    """Its beginnings, and the whole passage, which ends in a blank."""
    return [passage[:n] for n in EDGES if len(passage) >= n] + [f"{passage} "]


def closeness(cosine: np.ndarray) -> np.ndarray:
    """Weight of a neighbour's vote: 1 for an equal passage, and less the farther it is."""
    return 0.05 / (1.05 - np.minimum(cosine, 1.0))


class PassageIndex:
    """Block-max inverted index over the passages of labelled texts.

    examples: id, passages and label of the labelled texts; rate: of label 1 among all labelled texts.
    """

    def __init__(self, examples: list[tuple[int, set[str], int]], rate: float, least_texts: int = 2):
        self.rate = rate
        self.totals = [sum(1 for *_, y in examples if y == k) for k in (0, 1)]
        counts = (Counter(), Counter())
        for _, passages, y in examples:
            counts[y].update(passages)
        self.passages = sorted(p for p in counts[0].keys() | counts[1].keys() if counts[0][p] + counts[1][p] >= least_texts)
        self.texts = np.array([[counts[y][p] for p in self.passages] for y in (0, 1)], np.float64).reshape(2, -1)
        del counts
        self.example, places = np.zeros(self.texts.shape, np.int64), self.where()
        for i, passages, y in reversed(examples):
            self.example[y][[places[p] for p in passages if p in places]] = i
        df = Counter(t for p in self.passages for t in terms_of(p))
        self.terms = {t: k for k, t in enumerate(df)}
        self.idf = np.log((1 + len(self.passages)) / (1 + np.fromiter(df.values(), np.float64, len(df)))) + 1
        self.unknown = math.log(1 + len(self.passages)) + 1
        term, place, weight = [], [], []
        for k, p in enumerate(self.passages):
            at = [self.terms[t] for t in terms_of(p)]
            w = self.idf[at]
            term += at
            place += [k] * len(at)
            weight.append(w / math.sqrt(float(w @ w)))
        term, place, weight = np.array(term, np.int64), np.array(place, np.int64), np.concatenate([*weight, np.empty(0)])
        order = np.lexsort((place, term))
        term, self.place, self.weight = term[order], place[order].astype(np.int32), weight[order]
        # an entry is a term in a block
        block = self.place // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        starts = np.nonzero(new)[0]
        self.block, self.start = block[starts], np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.empty(0)
        self.first = np.searchsorted(term[starts], np.arange(len(self.terms) + 1))
        self.slope, self.offset = 0.0, 0.0

    def where(self) -> dict[str, int]:
        return {p: k for k, p in enumerate(self.passages)}

    def nearest(self, passages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the passages its nearest of the index, as three columns: which passage, place and cosine; exact, in falling order of cosine."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        query, row, missing = [], [], np.zeros(len(passages))
        for k, p in enumerate(passages):
            for t in terms_of(p):
                r = self.terms.get(t)
                if r is None:
                    missing[k] += 1
                else:
                    query.append(k)
                    row.append(r)
        if not row:
            return none
        query, row = np.array(query, np.int64), np.array(row, np.int64)
        norm = np.sqrt(np.bincount(query, self.idf[row] ** 2, len(passages)) + missing * self.unknown**2)
        weight = self.idf[row] / norm[query]
        postings = np.cumsum(self.start[self.first[row + 1]] - self.start[self.first[row]])
        ends = np.append(np.nonzero(query[1:] != query[:-1])[0] + 1, len(query))
        share = (postings[ends - 1] - 1) // LAID_OUT
        cuts = [0, *ends[:-1][share[1:] != share[:-1]].tolist(), len(query)]
        found = [self.nearest_of(query[a:b], row[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:])]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def nearest_of(self, query: np.ndarray, row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `nearest`, for passages given by their terms and weights, a passage's together."""
        # which blocks can hold a neighbour
        entry, of = spread(self.first[row], self.first[row + 1])
        key = query[of] * (1 + len(self.passages) // BLOCK) + self.block[entry]
        _, same = np.unique(key, return_inverse=True)
        bound = np.bincount(same, weight[of] * self.most[entry])
        likely = bound[same] >= LEAST_COSINE - 1e-12
        entry, of = entry[likely], of[likely]
        # their postings
        posting, at = spread(self.start[entry], self.start[entry + 1])
        of = of[at]
        pair, same = np.unique(query[of] * len(self.passages) + self.place[posting], return_inverse=True)
        cosine = np.bincount(same, weight[of] * self.weight[posting])
        near = cosine >= LEAST_COSINE - 1e-12
        query, place, cosine = pair[near] // len(self.passages), pair[near] % len(self.passages), cosine[near]
        order = np.lexsort((place, -cosine.round(12), query))
        query, place, cosine = query[order], place[order], cosine[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return tuple(x[rank < NEIGHBOURS] for x in (query, place, cosine))

    def evidence(self, query: np.ndarray, place: np.ndarray, cosine: np.ndarray, size: int, without: tuple[int, np.ndarray] | None = None) -> np.ndarray:
        """Log odds of label 1 that each query's neighbours vote for; without: a label, and which neighbours a text of it holds that isn't to count."""
        if not min(self.totals):
            return np.zeros(size)
        doubt = 1 / min(self.totals)
        w = closeness(cosine)
        shares = [np.bincount(query, w * (self.texts[y][place] - (without[1] if without and without[0] == y else 0)), size) / self.totals[y] for y in (0, 1)]
        return np.log((shares[1] + doubt) / (shares[0] + doubt))

    def probability(self, evidence: np.ndarray | list[float]) -> float:
        if not min(self.totals):
            return self.rate
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * strongest(evidence)))))

    def calibrate(self, examples: list[tuple[int, set[str], int]], per_class: int = CALIBRATED_PER_CLASS) -> None:
        """Fit slope and offset on leave-one-out evidence of the first per_class examples of each class."""
        if not min(self.totals):
            return
        places, numbers = self.where(), {}
        chosen = [e for y in (0, 1) for e in [e for e in examples if e[2] == y][:per_class]]
        of = [np.array([numbers.setdefault(k, len(numbers)) for k in sorted(keys_of(passages, places))], np.int64) for _, passages, _ in chosen]
        keys = list(numbers)
        found = [(at, self.nearest(keys[at : at + LOOKED_UP])) for at in range(0, len(keys), LOOKED_UP)]
        query, place, cosine = (np.concatenate(x) for x in zip(*((q + at, p, c) for at, (q, p, c) in found), strict=True))
        first = np.searchsorted(query, np.arange(len(numbers) + 1))
        xs, held = [], np.zeros(len(self.passages))
        for (_, passages, y), own in zip(chosen, of, strict=True):
            mine = [places[p] for p in passages if p in places]
            held[mine] = 1
            flat, at = spread(first[own], first[own + 1])
            xs.append(strongest(self.evidence(at, place[flat], cosine[flat], len(own), (y, held[place[flat]]))))
            held[mine] = 0
        y = np.array([y for *_, y in chosen])
        taken = np.bincount(y, minlength=2)
        self.slope, self.offset = logistic(np.array(xs), y, np.where(y == 1, self.rate / taken[1], (1 - self.rate) / taken[0]) * len(y))
        self.slope = max(self.slope, 0.0)


def spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..end, one range after the other, and the range that each is of."""
    size = end - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size - first, size), of


def keys_of(passages: set[str], places: dict[str, int]) -> set[str]:
    """What the passages are looked up by: a word that no labelled text holds has the vector of its longest beginning, and of an unknown whole word. Those of one vector count once."""
    end = EDGES[-1]
    return {p if p in places else p[:end] + "\0" for p in passages}


def strongest(evidence: np.ndarray | list[float]) -> float:
    """The evidence of the BEST passages, as far as it speaks for label 1."""
    return float(sum(sorted((e for e in evidence if e > 0), reverse=True)[:BEST]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted, slightly regularised logistic fit by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (weight * (y - p)) - 1e-2 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Scorer:
    """An index, with the evidence of the passages that a worker has met."""

    def __init__(self, index: PassageIndex):
        self.index, self.places = index, index.where()
        self.known: dict[str, float] = {}

    def learn(self, keys: list[str]) -> None:
        query, place, cosine = self.index.nearest(keys)
        evidence = self.index.evidence(query, place, cosine, len(keys))
        evidence[np.bincount(query, minlength=len(keys)) == 0] = 0.0
        self.known.update(zip(keys, np.maximum(evidence, 0.0).tolist(), strict=True))

    def reasons(self, keys: list[str]) -> dict[str, list[dict]]:
        """The nearest labelled texts of each of the passages."""
        out: dict[str, list[dict]] = {k: [] for k in keys}
        for q, at, c in zip(*(x.tolist() for x in self.index.nearest(keys)), strict=True):
            if len(out[keys[q]]) < 3:
                label = int(self.index.texts[1][at] > 0)
                out[keys[q]].append({"passage": keys[q].rstrip("\0"), "id": int(self.index.example[label][at]), "label": label, "cosine": c})
        return out

    def score(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        """Score, and the nearest labelled texts of the best passages, for each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [keys_of(passages_of(t), self.places) for t in texts]
        new = sorted(set().union(*split).difference(self.known))
        for at in range(0, len(new), LOOKED_UP):
            self.learn(new[at : at + LOOKED_UP])
        value = self.known.__getitem__
        best = [sorted([(-e, w) for w, e in zip(keys, map(value, keys), strict=True) if e])[:BEST] for keys in split]
        wanted = sorted({w for b in best for _, w in b})
        reasons: dict[str, list[dict]] = {}
        for at in range(0, len(wanted), LOOKED_UP):
            reasons |= self.reasons(wanted[at : at + LOOKED_UP])
        return [(self.index.probability([-e for e, _ in b]), [r for _, w in b for r in reasons[w]]) for b in best]


def near_copies_once(examples: list[tuple[int, set[str], int]]) -> list[tuple[int, set[str], int]]:
    """The examples without those of whose words the same four hash lowest as of an earlier one with the same label."""
    seen, out = set(), []
    for i, passages, y in examples:
        key = (y, *sorted(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in passages)[:4])
        if key not in seen:
            seen.add(key)
            out.append((i, passages, y))
    return out


def build_index(examples: list[tuple[int, set[str], int]], rate: float) -> PassageIndex:
    once = near_copies_once(examples)
    index = PassageIndex(once, rate)
    index.calibrate(once)
    return index


def packed(index: PassageIndex) -> bytes:
    """The index pickled and compressed: a worker holds what was broadcast beside the index itself."""
    return zlib.compress(pickle.dumps(index), 1)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> bytes:
    """A packed index of at most per_class distinct labelled texts a class, those that hash lowest; docs holds the texts to learn from.

    One task builds it, from as many texts as the bound allows, so that the driver only passes it on.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # ids and hashes only until the sample is known: texts aren't shuffled
    known = written(texts.select("id", "h").join(marked, "id").groupBy("y", "h").agg(F.min("id").alias("id")), "toxicity-labelled")
    rates = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [r for y in rates for r in known.where(F.col("y") == y).orderBy("h", "id").limit(per_class).collect()]
    discard(known)
    rate = rates.get(1, 0) / max(1, sum(rates.values()))
    if not chosen:
        return packed(PassageIndex([], rate))
    wanted = spark.createDataFrame([(r.id, r.h, r.y) for r in chosen], texts.select("id", "h").schema.add("y", "integer"))  # per_class bounds the broadcast

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            each = pa.array([sorted(passages_of(t)) for t in texts_of(batch.column(3))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), each], names=["id", "h", "y", "words"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: dict[tuple, tuple] = {}  # rows that repeat an id and text are one example
        for batch in slices(batches, rows=32):
            for i, h, y, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                examples[h, y] = (i, set(map(sys.intern, own)), y)
        yield pa.RecordBatch.from_arrays([pa.array([packed(build_index([examples[k] for k in sorted(examples)], rate))], pa.binary())], names=["index"])

    sample = texts.join(F.broadcast(wanted), ["id", "h"]).select("id", "h", "y", "text").mapInArrow(words, "id long, h long, y int, words array<string>")
    return bytes(sample.repartition(1).mapInArrow(build, "index binary").first()["index"])


def score_documents(docs: DataFrame, index: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), extra: dict[str, Column] | None = None, threshold: float = THRESHOLD, names: tuple[str, str, str] = ("score", "predicted", "evidence")) -> DataFrame:
    """Returns id_col, keep's and extra's columns, and under names score, predicted, and evidence: the best passages with their nearest labelled texts, labels and cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    given = [F.col(c) for c in (id_col, *keep)] + list((extra or {}).values())
    passed = [id_col, *keep, *(extra or {})]
    # a text that is kept goes to the workers once
    place = [id_col, *keep].index(text_col) if text_col in (id_col, *keep) else len(passed)
    rows = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(given)), *[F.col(text_col).alias("whole")] * (place == len(passed)))
    kind = pa.list_(pa.struct([("passage", pa.string()), ("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", xxhash.xxh3_64_intdigest(shared.value)), lambda: Scorer(pickle.loads(zlib.decompress(shared.value))))
        for batch in slices(batches, place, SPLIT_ROWS, SPLIT_BYTES):
            got = scorer.score(texts_of(batch.column(place)))
            scores = [s for s, _ in got]
            columns = [batch.column(k) for k in range(len(passed))]
            columns += [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([e for _, e in got], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, *names])

    fields = [f"`{c}` {rows.schema[f'c{k}'].dataType.simpleString()}" for k, c in enumerate(passed)]
    return rows.mapInArrow(run, ", ".join([*fields, f"{names[0]} double", f"{names[1]} int", f"{names[2]} array<struct<passage:string,id:bigint,label:int,cosine:double>>"]))
