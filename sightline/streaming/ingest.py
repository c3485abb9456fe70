"""Streams: idempotent ingest by key, keyed fingerprints, and daily runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []


class KeyedIngest:
    """A ``foreachBatch`` function that stores each key once, however often and in how many batches its rows come.

    The table lies in buckets, a folder each, and in them a folder for each batch. A bucket follows from the key or
    from what never changes for it, such as the day of an event's own time, so a batch reads the keys of the
    buckets that it holds and of no others: with days, what is read a batch doesn't grow with the table. A
    batch that comes again, after a failure or not, replaces its own folders and ignores them when it looks
    for known keys, so it stores the same rows. Of a batch's rows of one key that with the least ``order`` is stored.
    """

    def __init__(self, path: str, key: list[str], bucket: Column | None = None, order: Column | None = None, buckets: int = 64):
        self.path, self.key, self.order = path.rstrip("/"), key, order
        self.bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)) if bucket is None else bucket

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        rows = batch.withColumn("bucket", self.bucket.cast("string")).persist()
        try:
            found = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # folders, not keys
            first = rows.groupBy(*self.key).agg(F.min_by(F.struct(*rows.columns), F.struct(*([self.order] if self.order is not None else []), *self.key)).alias("r")).select("r.*")
            known = self.known(spark, T.StructType([schema[k] for k in self.key]), found, batch_id)
            fresh = first if known is None else first.join(known, self.key, "left_anti")
            for k in found:  # left over from an attempt that failed
                self._drop(spark, f"{self.path}/bucket={k}/batch={batch_id}")
            fresh.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.partitionBy("bucket", "batch").mode("append").parquet(self.path)
        finally:
            rows.unpersist()

    def known(self, spark: SparkSession, keys: T.StructType, buckets: list[str], batch_id: int) -> DataFrame | None:
        """The keys in some buckets that other batches have stored."""
        paths = [f"{self.path}/bucket={b}/{x}" for b in buckets for x in _children(spark, f"{self.path}/bucket={b}") if x.startswith("batch=") and x != f"batch={batch_id}"]
        return spark.read.schema(keys).parquet(*paths) if paths else None

    def _drop(self, spark: SparkSession, path: str) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The stored rows, with bucket and batch."""
        if not _children(spark, self.path):
            return spark.createDataFrame([], T.StructType([*schema, T.StructField("bucket", T.StringType()), T.StructField("batch", T.LongType())]))
        return spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.StringType()), T.StructField("batch", T.LongType())])).parquet(self.path)


def ingest(stream: DataFrame, path: str, key: list[str], checkpoint: str, bucket: Column | None = None, order: Column | None = None):
    """Start an idempotent ingest of a stream into Parquet; takes what is there and stops."""
    return stream.writeStream.foreachBatch(KeyedIngest(path, key, bucket, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows of a stream, each key once within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


class PageState(StatefulProcessor):
    """The last fingerprint of a page and when it was seen, kept for ``ttl`` after the page was last seen."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fingerprint string, seen long", **({"ttlDurationMs": self.ttl} if self.ttl else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One row a run and page, so what comes at once is as long as the runs that were waiting.
        waiting = sorted((int(r.seen), int(r.id), r.fingerprint) for frame in rows for r in frame.itertuples(index=False))
        last, seen = self.last.get() if self.last.exists() else (None, None)
        out = []
        for at, number, fingerprint in waiting:
            if seen is not None and at <= seen:
                out.append((key[0], number, at, "late"))
                continue
            out.append((key[0], number, at, "baseline" if seen is None else "changed" if fingerprint != last else "same"))
            last, seen = fingerprint, at
        self.last.update((last, seen))
        yield pd.DataFrame(out, columns=["page", "id", "seen", "state"])

    def close(self) -> None:
        pass


CHANGES = "page long, id long, seen long, state string"


def run_pages(rows: DataFrame) -> DataFrame:
    """(page, id, seen, fingerprint): what a run has seen last of each page, one row a page, combined before the shuffle."""
    last = rows.groupBy("page").agg(F.max(F.struct("seen", "id", "fingerprint")).alias("r"))
    return last.select("page", F.col("r.id").alias("id"), F.col("r.seen").alias("seen"), F.col("r.fingerprint").alias("fingerprint"))


def page_changes(stream: DataFrame, ttl: int | None = None) -> DataFrame:
    """baseline, changed, same or late for each (page, id, seen, fingerprint) of a stream of runs, against the page's state.

    ``stream`` has a page once a run (see ``run_pages``). What is older than the page's state is late and
    changes nothing. After ``ttl`` milliseconds without a row a page is forgotten (a query that stops when all
    is read then has to switch off ``spark.sql.streaming.noDataMicroBatches.enabled``). Needs the RocksDB state store.
    """
    if stream.sparkSession.conf.get(STATE_STORE, None) != ROCKS:
        raise RuntimeError(f"set {STATE_STORE} to {ROCKS}")
    return stream.groupBy("page").transformWithStateInPandas(PageState(ttl), CHANGES, "append", "none" if ttl is None else "processingTime")


class Runs:
    """Runs of a stream that are stored one after the other and taken by a query that starts anew from its checkpoint for each."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.transform, self.runs = spark, path.rstrip("/"), schema, transform, 0

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/in")
        source = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        query = self.transform(source).writeStream.format("parquet").option("checkpointLocation", f"{self.path}/checkpoint").option("path", f"{self.path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        self.runs += 1

    def result(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/out")


def run_action(runs: DataFrame, day: str) -> str:
    """What to do about a day's run: start (none yet), resume (failed or not complete), or skip."""
    row = runs.where(F.col("day") == F.lit(day).cast("date")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "complete").alias("done")).first()
    return "start" if not row["n"] else "skip" if row["done"] else "resume"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
