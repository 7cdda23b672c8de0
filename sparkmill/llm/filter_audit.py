"""Filter interaction audit: what each of several filters removes, in every order that they could be applied in.

A document's failures are a mask with one bit a filter. For a mask and an order, the first filter of the order whose
bit is set removes the document, so a table of 2^k masks by k! orders answers every order at once (32 by 120 for five
filters). Documents are first counted by part, mask and labels, which shrinks them before the shuffle; `audit` then
looks those counts up in the table within mapInArrow, np.bincount adds them up by part, order and step, and the partial
arrays of all batches are summed.

Defined results: a null text is empty. A null part is the empty string and counts with a part of that name. Rows with a
null id are nobody's copy and have no label. Repeated rows each count, and rows of one id are not copies of each other. A
document with several label rows has a label if one of them says so. An empty table gives an empty table. Only the
columns named are read, so others may have any name. Ties do not arise, as an order's first failing filter is unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import bytes_of, slices, written

FILTERS = "ABCDE"

# Limits of the filters A to D, and the characters of C and D.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 100, 80, 10
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: bytes, chars: int) -> int:
    """The mask of the filters A to D for a whole text of so many code points."""
    words = text.split()  # at the six ASCII separators
    n = len(words)
    few = n < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * n
    upper = 100 * (len(text) - len(text.translate(None, UPPER))) > MOST_UPPER_PERCENT * chars
    signs = len(text.translate(None, SIGNS)) < len(text)
    return few | same << 1 | upper << 2 | signs << 3


def judged(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, part. doc_id, part and mask: bit f is set if filter f of FILTERS fails.

    E fails a document whose text a smaller id has. Only digests are shuffled. The rows that hold a text's smallest id are found by joining on digest and id together,
    so the copies of one text spread over all tasks.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            texts = bytes_of(batch.column(1))
            masks = [text_failures(t, n) for t, n in zip(texts, chars)]
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(batch.column(2), ""), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = written(docs.select("doc_id", "text", F.col("part").cast("string")).mapInArrow(run, f"doc_id {id_type}, part string, mask int, digest binary"), "judged")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, true where a label row of the id has quality 1 or toxic 1."""
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    return rows.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])


def first_failures(k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of k filters, and by mask and order the step (from 0) that removes such a document, k if none does."""
    orders = list(permutations(range(k)))
    masks = np.arange(1 << k)
    fails = np.stack([(masks[:, None] >> np.array(order)) & 1 for order in orders], 1)  # mask, order, step
    return orders, np.where(fails.any(2), fails.argmax(2), k).astype(np.int64)


def counted(parts: np.ndarray, masks: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_parts: int, table: np.ndarray, orders: list[tuple[int, ...]]) -> np.ndarray:
    """COUNTS by part, order and step, of n rows a part, mask and labels."""
    k, size = len(orders[0]), len(orders)
    order = np.array(orders)
    step = table[masks]  # row, order
    cell = (parts[:, None] * size + np.arange(size)) * (k + 1) + step

    def added(weight: np.ndarray) -> np.ndarray:
        return np.bincount(cell.ravel(), np.repeat(weight, size), n_parts * size * (k + 1)).astype(np.int64).reshape(n_parts, size, k + 1)[:, :, :k]

    removed, good_lost, toxic_lost = added(n), added(n * good), added(n * toxic)
    by_part = lambda weight: np.bincount(parts, weight, n_parts).astype(np.int64)
    fails = np.stack([by_part(n * (masks >> f & 1)) for f in range(k)], 1)
    only = np.stack([by_part(n * (masks == 1 << f)) for f in range(k)], 1)
    shapley = np.zeros((n_parts, k), np.int64)
    np.add.at(shapley, (slice(None), order), removed)
    kept = by_part(n)[:, None, None] - np.cumsum(removed, 2)
    return np.stack([kept, removed, fails[:, order] - removed, only[:, order], good_lost, toxic_lost, shapley[:, order]], 3)


def audit(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """rows: part, mask, good, toxic (booleans). Per part, filter_order and step, zeros included: COUNTS.

    names has a letter for each bit of the mask, 8 at most, as the orders are the factorial of their number.
    """
    k = len(names)
    if not 1 <= k <= 8:
        raise ValueError("between 1 and 8 filters")
    orders, table = first_failures(k)
    words = ["".join(names[f] for f in order) for order in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=max(1, 500_000 // factorial(k))):
            part = batch.column(0).dictionary_encode()
            masks, good, toxic, n = (batch.column(c).cast(pa.int64()).to_numpy() for c in range(1, 5))
            sums = counted(part.indices.to_numpy().astype(np.int64), masks, n, good, toxic, len(part.dictionary), table, orders)
            cells = len(orders) * k
            for at, name in enumerate(part.dictionary.to_pylist()):
                own = sums[at].reshape(cells, len(COUNTS))
                yield pa.RecordBatch.from_arrays([pa.array([name] * cells), pa.array(np.repeat(words, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))] + [pa.array(own[:, c]) for c in range(len(COUNTS))], names=["part", "filter_order", "step", *COUNTS])

    few = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    partial = few.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT w.doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, good, toxic, n, fails, o, [i FOR i IN [1, 2, 3, 4, 5] IF fails[o[i]]] AS steps FROM c, o),
g AS (SELECT part, array_to_string([substr('ABCDE', k, 1) FOR k IN o], '') AS filter_order, x.i AS step, substr('ABCDE', o[x.i], 1) AS f,
  coalesce(sum(n) FILTER (WHERE len(steps) = 0 OR steps[1] > x.i), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE steps[1] = x.i), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE fails[o[x.i]] AND steps[1] < x.i), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE fails[o[x.i]] AND len(steps) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE steps[1] = x.i AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE steps[1] = x.i AND toxic), 0)::BIGINT AS toxic_lost
  FROM s, x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
