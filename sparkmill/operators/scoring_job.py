"""A resumable scoring job: batches of a work table are scored, written and committed one after the other.

Layout of a job's folder:

    run-0001/identity.json                       what the run is of
    run-0001/data/attempt=<id>/batch=<n>/        rows of a batch, as Parquet
    run-0001/commits/batch-<n>.json              a batch's manifest: attempt, rows, rows without a score
    run-0001/complete.json                       once every batch has one

A batch is there if its manifest is, and its rows are those of the attempt that the manifest names. Data is written first and
a manifest appears by a rename, so a job that is killed in between leaves rows that nobody reads, and the next start scores that batch again.
Nothing is ever rewritten: a batch is appended, and dropped by deleting its manifest.

A start looks for a run whose identity agrees key by key, where a missing key is null and null agrees with null. Without one it begins a new run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.operators.corpus import numbered_batches


def agrees(a: dict, b: dict) -> bool:
    """Equal under every key of either; a missing key is null, and values of different types differ."""
    return all(json.dumps(a.get(k), sort_keys=True) == json.dumps(b.get(k), sort_keys=True) for k in a.keys() | b.keys())


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """Of a set of rows, whatever their order and partitions; repeated rows count."""
    h = F.xxhash64(*columns)
    other = F.xxhash64(F.lit(17), *columns)
    r = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.sum(other.cast("decimal(38,0)")).alias("b")).first()
    return f"{r.n}-{int(r.a or 0) & (2**64 - 1):016x}{int(r.b or 0) & (2**64 - 1):016x}"


class Folder:
    """Small JSON files beside the tables, in whatever store Spark's paths name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def put(self, name: str, value: dict) -> None:
        """The file appears whole or not at all; one of that name is replaced."""
        hidden = self._path(f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}.tmp")
        out = self.fs.create(hidden, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
        finally:
            out.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(hidden, self._path(name)):
            raise RuntimeError(f"could not commit {name}")

    def get(self, name: str) -> dict | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class ScoringJob:
    """Batches of work scored by a function from a DataFrame of work to one of results with a column `score`, null where there is none."""

    def __init__(self, spark: SparkSession, root: str, identity: dict):
        self.spark, self.identity = spark, identity
        home = Folder(spark, root)
        runs = [n for n in home.names("") if n.startswith("run-")]
        same = [n for n in runs if agrees(home.get(f"{n}/identity.json") or {}, identity)]
        self.resumed = bool(same)
        self.run = same[-1] if same else f"run-{1 + max((int(n[4:]) for n in runs), default=0):04d}"
        if not same:
            home.put(f"{self.run}/identity.json", identity)
        self.folder = Folder(spark, f"{root.rstrip('/')}/{self.run}")

    def commits(self) -> dict[int, dict]:
        """Manifests by batch; as many as there are batches."""
        return {m["batch"]: m for n in self.folder.names("commits") if n.startswith("batch-") for m in [self.folder.get(f"commits/{n}")]}

    def next_batch(self, batches: int, floor: int = 0) -> int | None:
        """The first batch at or after floor that isn't there."""
        done = self.commits()
        return next((b for b in range(floor, batches) if b not in done), None)

    def drop(self, batch: int) -> None:
        """The batch is scored again by the next start."""
        self.folder.delete(f"commits/{self._name(batch)}")
        self.folder.delete("complete.json")

    @staticmethod
    def _name(batch: int) -> str:
        return f"batch-{batch:08d}.json"

    def _commit(self, manifest: dict) -> None:
        self.folder.put(f"commits/{self._name(manifest['batch'])}", manifest)

    def score(self, work: DataFrame, score: Callable[[DataFrame], DataFrame], floor: int = 0, most: int | None = None, together: int = 1) -> int:
        """Score what is missing, from the first gap at or after floor on, `most` batches at most; returns how many were committed.

        work has a column batch, from 0 without gaps (numbered_batches makes it). `together` batches are scored by one Spark job, and committed one by one.
        """
        batches = 1 + (work.agg(F.max("batch")).first()[0] if not work.isEmpty() else -1)
        done, made = self.commits(), 0
        todo = [b for b in range(floor, batches) if b not in done][:most]
        for at in range(0, len(todo), together):
            some, attempt = todo[at : at + together], uuid.uuid4().hex
            where = f"{self.folder.path}/data/attempt={attempt}"
            score(work.where(F.col("batch").isin(some))).write.partitionBy("batch").parquet(where)
            counts = self.spark.read.parquet(where).groupBy("batch").agg(F.count("*").alias("rows"), F.count_if(F.col("score").isNull()).alias("failed")).collect()  # one row a batch
            for r in sorted(counts, key=lambda r: r["batch"]):
                self._commit({"batch": int(r["batch"]), "attempt": attempt, "rows": r["rows"], "failed": r["failed"]})
                made += 1
        done = self.commits()
        if batches and all(b in done for b in range(batches)) and not self.folder.get("complete.json"):
            self.folder.put("complete.json", {"identity": self.identity, "batches": batches, "rows": sum(m["rows"] for m in done.values()), "failed": sum(m["failed"] for m in done.values())})
        return made

    def complete(self) -> dict | None:
        return self.folder.get("complete.json")

    def rows(self) -> DataFrame:
        """The committed rows; folders of attempts that no manifest names are pruned."""
        done = list(self.commits().values())
        if not done:
            raise ValueError("no batch is committed")
        named = self.spark.createDataFrame([(m["attempt"], m["batch"]) for m in done], "attempt string, batch long")
        found = self.spark.read.option("basePath", f"{self.folder.path}/data").parquet(*sorted({f"{self.folder.path}/data/attempt={m['attempt']}" for m in done}))
        return found.withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(named), ["attempt", "batch"], "left_semi").drop("attempt")  # one row a batch


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with batch, by their order; read again it must give the same rows."""
    return numbered_batches(rows, order, size).drop("row_index")


def carried(work: DataFrame, prior: DataFrame, key: list[str], score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A scorer that takes the rows whose key prior has a score for from there, and scores the rest.

    prior: key columns and score, one row a key. Null keys never match.
    """
    known = prior.where("score is not null").select(*key, F.col("score").alias("_prior"))

    def run(rows: DataFrame) -> DataFrame:
        fresh = score(rows.join(known, key, "left_anti"))
        return fresh.unionByName(rows.join(known, key).withColumn("score", F.col("_prior")).drop("_prior"), allowMissingColumns=True)

    return run
