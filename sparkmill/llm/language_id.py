"""Language identification by cross-parsing entropy.

For each language the distinct words of its labelled sample, most frequent first up to a budget of
characters, make one training string, and a suffix automaton over it. A text is parsed against the
automaton: each phrase is the longest prefix of what is left that occurs in the training string.
The number of phrases times log2 of the string's length, over the length of the text, estimates the
cross entropy; the language that needs the fewest bits wins. Phrases end where a word ends, so the
parse of a word doesn't depend on its neighbours and is made once for each distinct word.

Defined results: a null text, an empty one and one without a letter give `und` with score 0; with no
labelled row at all every text does. Ties go to the language that comes first by code point.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import held, slices, texts_of

#: Bounds of the labelled sample and of a language's training string.
SAMPLE_DOCS, SAMPLE_CHARS, TRAINING_CHARS = 200, 20_000, 40_000
#: Distinct words whose parse a worker keeps from one slice of rows to the next.
REMEMBERED = 400_000
UNKNOWN = "und"

_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, by Unicode category, with the marks on them."""
    return _letters(text.lower())


class SuffixAutomaton:
    """All substrings of a text; built by the online construction of Blumer et al."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            state, p = len(self.next), last
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state

    def phrases(self, text: str) -> int:
        """Longest-match phrases that text falls into; a letter that never occurs is a phrase of its own."""
        count, state, follow = 0, 0, self.next
        for c in text:
            after = follow[state].get(c, 0)
            if not after:
                count += state > 0
                after = follow[0].get(c, 0)
                count += not after
            state = after
        return count + (state > 0)


class CrossParser:
    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        self.automata = [SuffixAutomaton(training[k]) for k in self.langs]
        self.bits = np.array([math.log2(max(2, len(training[k]))) for k in self.langs])
        self.place: dict[str, int] = {}
        self.counts = np.zeros((REMEMBERED, len(self.langs)), np.int32)

    def parse(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(self.place) if split else set()
        extra = {w: len(self.place) + k for k, w in enumerate(new)}
        found = [[a.phrases(f" {w} ") for a in self.automata] for w in new]
        counts = np.concatenate([self.counts[: len(self.place)], np.array(found, np.int32).reshape(len(new), len(self.langs))])
        self.place.update(extra)
        out = []
        for words in split:
            if not words or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            bits = counts[at].sum(0) * self.bits
            best = int(bits.argmin())
            out.append((self.langs[best], float(1 / np.exp2(np.maximum(-60, (bits[best] - bits) / self.bits[best])).sum())))
        room = REMEMBERED - (len(self.place) - len(extra))
        for k, w in enumerate(extra):
            if k >= room:
                del self.place[w]
        size = len(self.place)
        self.counts[size - min(len(new), max(room, 0)) : size] = counts[size - min(len(new), max(room, 0)) : size]
        return out


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, str]:
    """Training strings by language, from at most sample_docs texts a language.

    Which texts: those whose ids hash lowest; of a long one, the words of one stretch of SAMPLE_CHARS characters, which starts
    where its hash says. The row limit is applied before the shuffle, so what reaches the driver is bounded by languages x sample_docs x SAMPLE_CHARS.
    """
    room = F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(0)) + 1
    stretch = F.substr(F.col(text_col), (F.pmod(F.xxhash64(F.lit("stretch"), F.col(id_col)), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    ranked = (
        labelled.select(F.col(lang_col).alias("lang"), stretch.alias("text"), F.xxhash64(id_col, text_col).alias("h"))
        .where(F.col("lang").isNotNull() & (F.length("text") > 0))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .where(F.col("k") <= sample_docs)
        .select("lang", "text")
    )
    counts: dict[str, Counter] = {}
    for row in ranked.collect():
        counts.setdefault(row.lang, Counter()).update(words_of(row.text))
    out = {}
    for lang, c in counts.items():
        taken, size = [], 1
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            if size + len(w) + 1 <= TRAINING_CHARS:
                taken.append(w)
                size += len(w) + 1
        if taken:
            out[lang] = f" {' '.join(taken)} "
    return out


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: dict[str, Column] | None = None) -> DataFrame:
    """Returns id_col, the columns in extra, lang_pred string and score double for every row of docs."""
    training = learn(labelled, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(training)
    names = [id_col, *(extra or {})]
    rows = docs.select(id_col, *(c.alias(k) for k, c in (extra or {}).items()), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held(("language", hash(tuple(sorted(shared.value.items())))), lambda: CrossParser(shared.value))
        for batch in slices(batches, len(names)):
            got = p.parse(texts_of(batch.column(len(names))))
            columns = [batch.column(k) for k in range(len(names))]
            columns += [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
