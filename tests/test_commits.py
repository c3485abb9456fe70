"""Versioned tables: commits, snapshots and conflicts of writers."""

import threading

import pytest
from pyspark.sql import functions as F

from sightline.sources.commits import CommitTable, Conflict, claim, versioned_updates

SCHEMA = "id long, status string, version long"


@pytest.fixture()
def table(spark, tmp_path):
    return CommitTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], buckets=4)


def rows(spark, ids, status="new", version=1):
    return spark.createDataFrame([(i, status, version) for i in ids], SCHEMA)


def content(df):
    return {r["id"]: (r["status"], r["version"]) for r in df.collect()}


def test_snapshots_and_deletes(spark, table):
    assert table.read().count() == 0 and table.version() == 0
    assert table.upsert(rows(spark, range(20))) == 1
    assert table.upsert(rows(spark, [3, 30], "changed", 2)) == 2
    assert table.upsert(rows(spark, [4]), delete=True) == 3
    assert table.upsert(rows(spark, [])) == 3
    assert content(table.read(1)) == {i: ("new", 1) for i in range(20)}
    now = content(table.read())
    assert now[3] == now[30] == ("changed", 2) and 4 not in now and len(now) == 20


def test_writers_of_one_bucket_conflict_and_others_do_not(spark, table):
    table.upsert(rows(spark, range(40)))
    bucket = {r["id"]: r["b"] for r in spark.range(40).select("id", table._bucket().alias("b")).collect()}
    same, other = [i for i in bucket if bucket[i] == bucket[0]][:2], next(i for i in bucket if bucket[i] != bucket[0])
    table.upsert(rows(spark, same[:1], "first"), 1)
    assert table.upsert(rows(spark, [other], "second"), 1) == 3
    with pytest.raises(Conflict):
        table.upsert(rows(spark, same[1:], "late"), 1)
    now = content(table.read())
    assert now[same[0]][0] == "first" and now[other][0] == "second" and now[same[1]][0] == "new"


def test_one_of_two_concurrent_claims_wins(spark, table):
    answers = {}

    def run(worker):
        got = claim(table, spark.createDataFrame([(i, worker) for i in range(6)], "id long, version long"))
        answers[worker] = {r["id"]: r["action"] for r in got.collect()}

    threads = [threading.Thread(target=run, args=(w,)) for w in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    owner = {i: v for i, (_, v) in content(table.read()).items()}
    assert len(answers) == 3 and len(owner) == 6
    for i, w in owner.items():
        assert [answers[x][i] for x in (1, 2, 3)].count("start") == 1 and answers[w][i] == "start"


def test_claims_resume_and_skip(spark, table):
    table.upsert(rows(spark, [1], "completed").unionByName(rows(spark, [2], "failed")).unionByName(rows(spark, [3, 4], "running")))
    table.upsert(rows(spark, [4], "running", 0))
    got = claim(table, spark.createDataFrame([(i, 9) for i in range(1, 6)], "id long, version long"), stale=F.col("version") == 0)
    assert {r["id"]: r["action"] for r in got.collect()} == {1: "skip", 2: "resume", 3: "skip", 4: "resume", 5: "start"}
    assert content(table.read()) == {1: ("completed", 1), 2: ("running", 9), 3: ("running", 1), 4: ("running", 9), 5: ("running", 9)}


def test_versions_are_raised_once(spark, table):
    table.upsert(rows(spark, range(5)))
    change = lambda status, seen=None: versioned_updates(table, spark.createDataFrame([(1, status, 1), (7, status, 1)], "id long, status string, expected long"), seen)
    seen = table.version()
    first, second = change("x", seen), change("y", seen)
    assert {r["id"]: r["applied"] for r in first.collect()} == {1: True, 7: False} and not any(r["applied"] for r in second.collect())
    assert content(table.read())[1] == ("x", 2)
