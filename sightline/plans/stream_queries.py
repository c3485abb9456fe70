"""Registered queries that stream a table in several runs."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from sightline.operators.temporal import quantiles
from sightline.plans.registry import register
from sightline.sources.staging import shared_folder
from sightline.streaming import ingest, windows

THIRDS = "cut AS (SELECT quantile_disc(ts, [0.33, 0.66]) AS q FROM events), e AS (SELECT events.*, CASE WHEN ts <= q[1] THEN 0 WHEN ts <= q[2] THEN 1 ELSE 2 END AS run FROM events, cut)"


@contextlib.contextmanager
def _session(spark, **settings):
    """Settings of the session while a stream runs, given back afterwards."""
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rocks(spark):
    return _session(spark, **{ingest.STATE_STORE: ingest.ROCKS})


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _runs(v):
    """The events with the run that brings them: thirds of their time."""
    events = v.events.withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    cuts = quantiles(events, micros, ["0.33", "0.66"])
    if not cuts:
        return events.withColumn("run", F.lit(0))
    return events.withColumn("run", F.when(micros <= cuts[0], 0).when(micros <= cuts[1], 1).otherwise(2))


# Each run says what it has seen last of every user, who keeps a state from run to run.
@register("t3_keyed_state", f"""WITH {THIRDS}, s AS (SELECT user_id AS page, run, max(event_id) FILTER (WHERE ts = last) AS id, epoch_us(any_value(last)) AS seen FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, run) AS last FROM e) GROUP BY user_id, run),
f AS (SELECT s.*, event_type, lag(event_type) OVER (PARTITION BY page ORDER BY run) AS before FROM s JOIN events ON event_id = id)
SELECT page, id, seen, CASE WHEN before IS NULL THEN 'baseline' WHEN before <> event_type THEN 'changed' ELSE 'same' END AS state FROM f""")
def t3_state(v):
    rows = _runs(v).select("run", F.col("user_id").alias("page"), F.unix_micros("ts").alias("seen"), F.col("event_id").alias("id"), F.col("event_type").alias("fingerprint"))
    spark = rows.sparkSession
    stream = ingest.Runs(spark, _folder(spark, "page-state"), ingest.run_pages(rows).schema, ingest.page_changes)
    with _rocks(spark):
        for k in range(3):
            stream.add(ingest.run_pages(rows.where(F.col("run") == k)))
    return stream.result(ingest.CHANGES)


# Batches that overlap, one of which comes twice; days are buckets, so a batch reads the keys of its own days.
@register("t2_idempotent_ingest", "SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 IN (0, 1) THEN 0 WHEN event_id % 4 = 2 THEN 1 ELSE 2 END AS batch FROM events")
def t2_ingest(v):
    rows = v.events.select("event_id", "user_id", "ts", "event_type")
    spark = rows.sparkSession
    store = ingest.KeyedIngest(_folder(spark, "ingest"), ["event_id"], bucket=F.to_date("ts"))
    for batch, rests in ((0, (0, 1)), (1, (1, 2)), (1, (1, 2)), (2, (3, 2, 0))):
        part = rows.where((F.col("event_id") % 4).isin(*rests))
        store(part.unionByName(part), batch)
    return store.read(spark, rows.schema).select("event_id", "user_id", "event_type", "batch")


# A tenth of the rows comes a run too late; what is later than the delay, counted from the runs before, is dropped.
GAP, DELAY = "6 hours", "2 days"
LATE = f"{THIRDS}, r AS (SELECT user_id, ts AS s, ts + INTERVAL {GAP} AS e, 1 AS n, least(run + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 2) AS run FROM e), wm AS (SELECT " + ", ".join(f"max(s) FILTER (WHERE run < {k}) - INTERVAL {DELAY} AS w{k}" for k in (1, 2, 3)) + " FROM r)"


def _merged(k: int) -> str:
    """DuckDB SQL of run k: open sessions and rows that are not late become sessions; those that the watermark has passed are closed."""
    late = "true" if k == 0 else f"e > w{k}"
    before = "" if k == 0 else f" UNION ALL SELECT user_id, s, e, n FROM m{k - 1}, wm WHERE e > w{k}"
    return f"""i{k} AS (SELECT user_id, s, e, n FROM r, wm WHERE run = {k} AND {late}{before}),
j{k} AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM i{k}),
g{k} AS (SELECT *, sum(CASE WHEN last IS NULL OR s > last THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM j{k}),
m{k} AS (SELECT user_id, min(s) AS s, max(e) AS e, sum(n)::BIGINT AS n FROM g{k} GROUP BY user_id, g)"""


CLOSED = " UNION ALL ".join(f"SELECT user_id, s, e, n FROM m{k}, wm WHERE e <= w{k + 1}" for k in range(3))


@register("t1_late_sessions", f"WITH {LATE}, {', '.join(_merged(k) for k in range(3))} SELECT user_id, epoch_us(s) AS session_start, epoch_us(e) AS session_end, n FROM ({CLOSED}) t")
def t1_sessions(v):
    rows = _runs(v).withColumn("run", F.least(F.col("run") + (F.col("event_id") % 10 == 0).cast("int"), F.lit(2)))
    # Spark's watermarks are whole milliseconds, and rows less than one from them would be dropped or closed otherwise
    # than by the SQL: a microsecond since the first event is streamed as a millisecond.
    first = rows.agg(F.min(F.unix_micros("ts"))).first()[0] or 0
    rows = rows.withColumn("ts", F.timestamp_millis(F.unix_micros("ts") - F.lit(first)))
    spark, columns = rows.sparkSession, ["ts", "user_id"]
    stream = ingest.Runs(spark, _folder(spark, "sessions"), rows.select(columns).schema, lambda s: windows.sessions(s, *(t.replace(" ", "000 ") for t in (GAP, DELAY))))
    for k in range(3):
        stream.add(rows.where(F.col("run") == k).select(columns))
    out = stream.result("user_id long, session_start timestamp, session_end timestamp, n long")
    micros = lambda c: (F.unix_millis(c) + F.lit(first)).alias(c)
    return out.select("user_id", micros("session_start"), micros("session_end"), "n")


# Purchases with the views of the user in the six hours before, both streamed in the order of time.
@register("t1_stream_join", "SELECT p.event_id, w.event_id AS view_id FROM events p JOIN events w ON p.user_id = w.user_id AND w.ts <= p.ts AND w.ts >= p.ts - INTERVAL 6 HOUR WHERE p.event_type = 'purchase' AND w.event_type = 'view'")
def t1_join(v):
    rows = _runs(v)
    spark, columns = rows.sparkSession, ["ts", "user_id", "event_id", "event_type"]

    def within(s):
        kind = lambda k: s.where(F.col("event_type") == k).drop("event_type")
        return windows.joined_within(kind("purchase"), kind("view"), "user_id", "6 hours").select("event_id", F.col("right_event_id").alias("view_id"))

    stream = ingest.Runs(spark, _folder(spark, "stream-join"), rows.select(columns).schema, within)
    for k in range(3):
        stream.add(rows.where(F.col("run") == k).select(columns))
    return stream.result("event_id long, view_id long")
