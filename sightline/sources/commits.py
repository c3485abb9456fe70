"""Keyed tables with versions on shared storage: atomic commits, snapshot reads, optimistic conflicts.

A table's rows lie in hash buckets of the key, a folder each. A commit is one file, named by its version
and created only if it doesn't exist yet; it lists the folder of every bucket, so a snapshot is one small
file. A writer rewrites the buckets that it touches from the snapshot it has read, and commits the next
version. If that exists, another writer was faster: where that one touched other buckets the commit goes on
top of it, else the writer is told by ``Conflict``, and what it wrote is in no snapshot.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed rows of the same buckets since the snapshot was read."""


class CommitTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        """``schema`` as DDL; keys are not null. Tables of one path must be opened with the same key and number of buckets."""
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("log"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The latest version; 0 is the empty table."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("log"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _entry(self, version: int) -> dict:
        if version == 0:
            return {"buckets": {}, "touched": []}
        stream = self._fs.open(self._path(f"log/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the latest by default), all or those of some buckets."""
        folders = self._entry(self.version() if version is None else version)["buckets"]
        paths = [f for b, f in sorted(folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, version: int | None = None, delete: bool = False) -> int:
        """Commit rows in place of those of the same keys (``delete``: only take these away), on top of ``version``; returns the new version.

        One row a key. Raises ``Conflict`` if a later version touched the same buckets.
        """
        base = self.version() if version is None else version
        entry = self._entry(base)
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # ``buckets`` at most
        if not touched:
            return base
        held = [b for b in touched if str(b) in entry["buckets"]]
        kept = self.read(base, held).join(rows.select(*self.key), self.key, "left_anti") if held else self.spark.createDataFrame([], self.schema)
        new = kept if delete else kept.unionByName(rows.select(kept.columns))
        folder = f"data/{uuid.uuid4().hex}"
        new.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        written = {b for b in touched if self._fs.exists(self._path(f"{folder}/_bucket={b}"))}
        while True:
            buckets = {b: f for b, f in entry["buckets"].items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in written}
            if self._create(base + 1, {"buckets": buckets, "touched": touched}):
                return base + 1
            base, entry = base + 1, self._entry(base + 1)
            if set(entry["touched"]) & set(touched):
                self._fs.delete(self._path(folder), True)
                raise Conflict(f"version {base} of {self.path} has rows of the same buckets")

    def _create(self, version: int, entry: dict) -> bool:
        """Create a commit as a whole, or not at all if it exists."""
        name, draft = f"log/{version:012d}.json", f"log/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft))
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # renaming local files would replace
                local = urlparse(self.path).path if "://" in self.path or self.path.startswith("file:") else self.path
                os.link(f"{local}/{draft}", f"{local}/{name}")
                return True
            return bool(self._fs.rename(self._path(draft), self._path(name)))
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._path(draft), False)

    def transact(self, decide: Callable[[DataFrame], DataFrame], retries: int = 10, version: int | None = None) -> DataFrame:
        """Upsert what ``decide`` makes of a snapshot, deciding anew on a new snapshot after each conflict; returns the rows committed.

        ``decide`` must be deterministic. ``version``: the snapshot of the first attempt, the latest by default.
        """
        for attempt in range(retries + 1):
            base = self.version() if attempt or version is None else version
            rows = decide(self.read(base))
            try:
                self.upsert(rows, base)
                return rows
            except Conflict:
                continue
        raise Conflict(f"{self.path}: still in conflict after {retries} retries")


def claim(table: CommitTable, claims: DataFrame, done: str = "completed", status: str = "status", stale: F.Column | None = None, version: int | None = None) -> DataFrame:
    """Claim keys for a run: every claim with ``action`` start (no run yet), resume (failed, or left incomplete) or skip (done, or running).

    Claimed keys are stored with the status ``running`` and the other columns of the claim in one commit, so of
    two writers that claim a key at once one has it and the other skips it. ``stale`` is a condition on stored
    rows under which a running one counts as left incomplete. One claim a key.
    """
    key = table.key
    answers: list[DataFrame] = []

    def decide(stored: DataFrame) -> DataFrame:
        left = F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(False)
        held = (F.col(status) == done) | ((F.col(status) == "running") & ~left)
        known = stored.select(*key, F.coalesce(held, F.lit(False)).alias("_held"))
        action = F.when(F.col("_held").isNull(), "start").when(F.col("_held"), "skip").otherwise("resume")
        answers[:] = [claims.join(known, key, "left").withColumn("action", action).drop("_held")]
        names = [c for c in stored.columns if c != status]
        return answers[0].where("action <> 'skip'").select(*names, F.lit("running").alias(status))

    table.transact(decide, version=version)
    return answers[0]


def versioned_updates(table: CommitTable, changes: DataFrame, version: int | None = None) -> DataFrame:
    """Replace rows whose stored ``version`` is the expected one and raise it; every change with ``applied``.

    ``changes`` have the table's columns but ``version``, and ``expected``; one row a key.
    """
    key = table.key
    answers: list[DataFrame] = []

    def decide(stored: DataFrame) -> DataFrame:
        known = stored.select(*key, F.col("version").alias("_now"))
        hit = F.coalesce(F.col("_now") == F.col("expected"), F.lit(False))
        answers[:] = [changes.join(known, key, "left").withColumn("applied", hit).drop("_now")]
        return answers[0].where("applied").withColumn("version", F.col("expected") + 1).select(stored.columns)

    table.transact(decide, version=version)
    return answers[0]
