"""Streams over files: windows, idempotent ingest, keyed state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sightline.streaming import ingest, windows

SCHEMA = "id long, ts timestamp, user_id long, event_type string, value double"


def rows(spark, ids):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + dt.timedelta(minutes=7 * i), i % 2, "view", 1.0) for i in ids], SCHEMA)


def collect(stream, name, spark, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_windows_of_batch_and_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, range(20)).coalesce(1).write.parquet(source)
    batch = {tuple(r) for r in windows.tumbling(rows(spark, range(20)), "1 hour").collect()}
    stream = windows.tumbling(ingest.read_stream(spark, source, SCHEMA), "1 hour")
    assert {tuple(r) for r in collect(stream, "tumbling", spark, "complete")} == batch
    assert windows.tumbling(rows(spark, range(20)), "1 hour", slide="30 minutes").count() > len(batch)
    assert windows.sessions(rows(spark, [0, 2, 20, 22]), "20 minutes").count() == 2


def test_ingest_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    bucket = F.to_date("ts")
    start = lambda: ingest.ingest(ingest.read_stream(spark, source, SCHEMA), target, ["id"], str(tmp_path / "c"), bucket).awaitTermination()
    rows(spark, [1, 2, 2, 3]).coalesce(1).write.mode("append").parquet(source)
    start()
    rows(spark, [3, 4]).coalesce(1).write.mode("append").parquet(source)
    start()
    store, schema = ingest.KeyedIngest(target, ["id"], bucket), rows(spark, []).schema
    stored = lambda: sorted((r["id"], r["batch"]) for r in store.read(spark, schema).collect())
    assert stored() == [(1, 0), (2, 0), (3, 0), (4, 1)]
    store(rows(spark, [3, 4]), 1)  # a batch that comes again
    assert stored() == [(1, 0), (2, 0), (3, 0), (4, 1)]
    store(rows(spark, [4, 5]), 2)
    # Left over from a batch that failed: it doesn't count as known when that batch comes again.
    rows(spark, [7, 8]).write.parquet(f"{target}/bucket=2024-01-01/batch=3")
    store(rows(spark, [8, 9]), 3)
    assert stored() == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (8, 3), (9, 3)]


def test_ingest_reads_only_its_buckets(spark, tmp_path):
    store, schema = ingest.KeyedIngest(str(tmp_path / "t"), ["id"], F.to_date("ts")), rows(spark, []).schema
    for k in range(4):  # 200 rows of 7 minutes are about a day
        store(rows(spark, range(200 * k, 200 * k + 200)), k)
    keys = spark.createDataFrame([], "id long").schema
    read = store.known(spark, keys, ["2024-01-03"], 9)
    days = {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}
    assert days == {"2024-01-03"} and store.known(spark, keys, ["2030-01-01"], 9) is None and store.read(spark, schema).count() == 800


def test_page_changes_keep_state_from_run_to_run(spark, tmp_path):
    kind = "page long, id long, seen long, fingerprint string"
    run = lambda *r: ingest.run_pages(spark.createDataFrame(list(r), kind))
    with pytest.raises(RuntimeError):
        ingest.page_changes(ingest.read_stream(spark, str(tmp_path), kind))
    spark.conf.set(ingest.STATE_STORE, ingest.ROCKS)
    try:
        stream = ingest.Runs(spark, str(tmp_path), run((0, 0, 0, "")).schema, ingest.page_changes)
        stream.add(run((1, 10, 1, "a"), (1, 11, 2, "b"), (2, 20, 1, "z")))
        stream.add(run((1, 12, 3, "b"), (2, 21, 0, "y"), (3, 30, 5, None)))
        stream.add(run((1, 13, 4, "c"), (2, 22, 9, "z")))
    finally:
        spark.conf.unset(ingest.STATE_STORE)
    got = {(r["id"], r["state"]) for r in stream.result(ingest.CHANGES).collect()}
    assert got == {(11, "baseline"), (20, "baseline"), (12, "same"), (21, "late"), (30, "baseline"), (13, "changed"), (22, "same")}


def test_run_action(spark):
    runs = spark.createDataFrame([(dt.date(2024, 1, 1), "failed"), (dt.date(2024, 1, 2), "complete")], "day date, status string")
    assert [ingest.run_action(runs, f"2024-01-0{d}") for d in (1, 2, 3)] == ["resume", "skip", "start"]


def test_distinct_within(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, [1, 1, 2]).coalesce(1).write.parquet(source)
    stream = ingest.distinct_within(ingest.read_stream(spark, source, SCHEMA), ["id"]).select(F.col("id"))
    assert sorted(r["id"] for r in collect(stream, "distinct_rows", spark)) == [1, 2]
