"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text, of an Arrow batch that a worker holds as Python objects at once.
SLICE_ROWS, SLICE_BYTES = 4096, 6_000_000

#: Words are maximal runs of anything but the space and the five ASCII line and tab controls.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; only a local master does without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/sparkmill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As `written`, with the number of rows, which is counted as they are written."""
    seen = Observation()
    back = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return back, seen.get["rows"]


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned and that no plan will read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parts_of(df: DataFrame, rows: int, each: int = 100_000) -> int:
    """Tasks for so many rows: as many as hold `each`, but two a core at least."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // each)


#: Bits of the largest bitmap that tells which keys may be wanted: 262,144 words of 64.
MOST_MARKS = 1 << 24


def only_marked(rows: DataFrame, column: str, keys: DataFrame, key: str, count: int) -> DataFrame:
    """rows whose column is in keys, and a few others: cheaper than a join where rows are wide or many.

    Keys are put into a bitmap by their hashes, eight bits a key up to MOST_MARKS in all, whose words are broadcast; it drops fewer rows the fuller it is and never a wanted one.
    """
    bits = min(MOST_MARKS, max(1 << 12, 1 << (8 * count).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    shift = lambda name, x, c: F.call_function(name, x, (F.col(c) % 64).cast("int"))
    word = F.floor(F.col("_at") / 64).cast("int").alias("_word")
    marks = keys.select(at(key).alias("_at")).groupBy(word).agg(F.bit_or(shift("shiftleft", F.lit(1).cast("long"), "_at")).alias("_marks"))
    placed = rows.select(F.struct(*rows.columns).alias("_row"), at(column).alias("_at")).select("_row", "_at", word)
    return placed.join(F.broadcast(marks), "_word").where(shift("shiftright", F.col("_marks"), "_at").bitwiseAND(F.lit(1).cast("long")) == 1).select("_row.*")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of so many rows and, where text is a text column's place, of `most` bytes; a longer text comes alone."""
    for batch in batches:
        if text is None:
            cuts = [*range(0, batch.num_rows, rows), batch.num_rows]
        else:
            cuts, held = [0], 0
            for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
                if at > cuts[-1] and (at - cuts[-1] >= rows or held + size > most):
                    cuts.append(at)
                    held = 0
                held += size
            cuts.append(batch.num_rows)
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
        del batch
        pa.default_memory_pool().release_unused()


_HELD: dict = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """What make returns, kept by the worker for its next tasks until something else is asked for: a worker holds one operator's model at a time."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
        trim()
    return _HELD[key]


def trim() -> None:
    """Freed memory goes back to the system where the C library can do that."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
