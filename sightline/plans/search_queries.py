"""Registered search-performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import expr
from sightline.operators import search, sketches, temporal
from sightline.plans.registry import register

SUMS = "coalesce(sum(clicks), 0)::BIGINT AS clicks, coalesce(sum(impressions), 0)::BIGINT AS impressions, CASE WHEN sum(impressions) > 0 THEN sum(clicks)::DOUBLE / sum(impressions) ELSE 0.0 END AS ctr, CASE WHEN sum(impressions) > 0 THEN sum(position * impressions) / sum(impressions) ELSE 0.0 END AS position"


@register("a6_search_totals", f"SELECT {SUMS} FROM search_rows", rounded=("ctr", "position",))
def a6(v):
    return search.totals(v.search_rows)


@register("a6_empty_totals", f"SELECT {SUMS} FROM search_rows WHERE query = 'none'")
def a6_empty(v):
    return search.totals(v.search_rows.where("query = 'none'"))


@register("f20_dimension_report", f"SELECT query, page, {SUMS} FROM search_rows WHERE contains(query, '3') AND page <> '/p4' AND NOT contains(page, '9') GROUP BY query, page ORDER BY clicks DESC, impressions DESC, query, page LIMIT 50 OFFSET 10", rounded=("ctr", "position",))
def f20(v):
    return search.by_dimensions(v.search_rows, ["query", "page"], [("query", "contains", "3"), ("page", "notEquals", "/p4"), ("page", "notContains", "9")], 50, 10)


@register("k10_striking_distance", f"""WITH p AS (SELECT query, page, {SUMS} FROM search_rows GROUP BY query, page), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY position, impressions DESC, page) = 1)
SELECT query, page, clicks, impressions, position FROM b WHERE position BETWEEN 1.9 AND 20 ORDER BY impressions DESC, query LIMIT 100""", rounded=("position",))
def k10(v):
    return search.striking_distance(search.page_totals(v.search_rows), low=1.9)


@register("w7_period_comparison", f"""SELECT CASE WHEN day BETWEEN DATE '2024-01-16' AND DATE '2024-01-22' THEN 'current' ELSE 'previous' END AS period, {SUMS} FROM search_rows WHERE day BETWEEN DATE '2024-01-09' AND DATE '2024-01-22' GROUP BY 1""", rounded=("ctr", "position",))
def w7(v):
    return search.period_comparison(v.search_rows, "2024-01-16", "2024-01-22")


@register("w8_report_ranges", """SELECT o_orderkey, CAST(greatest(d - INTERVAL 3 DAY - INTERVAL 3 MONTH, d - INTERVAL 16 MONTH) AS DATE) AS quarter_start, CAST(d - INTERVAL 31 DAY AS DATE) AS month_start, CAST(d - INTERVAL 3 DAY AS DATE) AS range_end,
 CAST(d - INTERVAL 16 MONTH AS DATE) AS floor_start FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def w8(v):
    today = F.to_date("o_orderdate")
    rows = v.orders
    q, end = expr.report_range(today, "last_3_months")
    return rows.select("o_orderkey", q.alias("quarter_start"), expr.report_range(today, "last_28_days")[0].alias("month_start"), end.alias("range_end"), expr.report_range(today, "last_16_months")[0].alias("floor_start"))


@register("a27_daily_usage", "SELECT CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1", rounded=("total",))
def a27(v):
    return search.daily_series(v.events, F.col("value"))


@register("a26_usage_by_feature", "SELECT coalesce(json_extract_string(props, '$.feature'), event_type) AS label, sum(value) AS used FROM events GROUP BY 1 HAVING sum(value) > 0", rounded=("used",))
def a26(v):
    return search.usage_by_feature(v.events)


DAILY = "daily AS (SELECT page, CAST(day - DATE '2024-01-01' AS BIGINT) AS day_no, sum(impressions) AS n FROM search_rows GROUP BY page, day)"


def _daily(v):
    return v.search_rows.groupBy("page", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("day_no")).agg(F.sum("impressions").alias("n"))


@register("d1_d2_demand_regimes", f"""WITH {DAILY}, w AS (SELECT page, day_no, n, sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS spike, sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS pulse,
 sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 89 PRECEDING AND CURRENT ROW)::BIGINT AS persistence, sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 364 PRECEDING AND CURRENT ROW)::BIGINT AS baseline FROM daily)
SELECT page, day_no, spike, pulse, persistence, baseline, CASE WHEN baseline = pulse THEN 'emerging' WHEN spike / 7.0 > 2 * pulse / 30.0 THEN 'spiking' WHEN pulse / 30.0 < 0.5 * persistence / 90.0 THEN 'decaying' ELSE 'steady' END AS regime FROM w""")
def d1(v):
    return search.regimes(_daily(v), ["page"], "day_no", "n").select("page", "day_no", "spike", "pulse", "persistence", "baseline", "regime")


@register("d3_engagement_norms", """WITH r AS (SELECT event_id, event_type, value / greatest(event_id % 9, 1) AS velocity FROM events), m AS (SELECT event_type, median(velocity) AS md FROM r GROUP BY 1), d AS (SELECT event_type, median(abs(velocity - md)) AS mad FROM r JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, velocity, percent_rank() OVER (PARTITION BY event_type ORDER BY velocity) AS percentile, CASE WHEN mad > 0 THEN (velocity - md) / mad ELSE 0 END AS deviations FROM r JOIN m USING (event_type) JOIN d USING (event_type)""", rounded=("velocity", "percentile", "deviations",))
def d3(v):
    rows = v.events.select("event_id", "event_type", "value", (F.col("event_id") % 9).alias("age"))
    return search.engagement_norms(rows, ["event_type"], "value", "age").select("event_id", "velocity", "percentile", "deviations")


@register("d5_trend_acceleration", f"WITH {DAILY} SELECT page, day_no, (n - lag(n) OVER (PARTITION BY page ORDER BY day_no))::BIGINT AS acceleration FROM daily")
def d5(v):
    return search.acceleration(_daily(v), ["page"], "day_no", "n").select("page", "day_no", "acceleration")


@register("w18_addition_frames", "SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS quarter, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3 FROM events", rounded=("last3",))
def w18(v):
    return v.events.selectExpr("event_id", "ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter", "lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type", "sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3")


@register("a21_addition_rollup_cube", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, grouping(o_orderstatus)::INT AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a21(v):
    return v.orders.selectExpr("o_orderstatus AS status", "o_orderpriority AS priority").cube("status", "priority").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").cast("int").alias("g"))


# Sketches by day and type, merged over a rollup; beside exact counts, whether the estimates keep to their error bounds.
@register("a21_merged_sketches", """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, event_id * 7919 % 3001 AS item FROM events)
SELECT CAST(event_type AS VARCHAR) AS event_type, CAST(day AS VARCHAR) AS day, count(*) AS n, count(DISTINCT item) AS items, true AS distinct_within, true AS median_within FROM e GROUP BY ROLLUP (event_type, day)""")
def a21_sketches(v):
    rows = v.events.select("event_type", F.to_date("ts").alias("day"), (F.col("event_id") * 7919 % 3001).alias("item"), "value")
    groups = ["event_type", "day"]
    found = sketches.rolled_up(sketches.sketch(rows, groups, "item", "value"), groups, (0.5,))
    exact = rows.rollup(*groups).agg(F.grouping_id().alias("l"), F.count_distinct("item").alias("items"), F.percentile("value", [0.45, 0.55]).alias("near"))
    exact = exact.withColumnsRenamed({c: f"x_{c}" for c in groups})
    same = (F.col("level") == F.col("l")) & F.col("event_type").eqNullSafe(F.col("x_event_type")) & F.col("day").eqNullSafe(F.col("x_day"))
    # Four standard errors of the distinct sketch, and one value more; five hundredths of rank of the other.
    distinct = F.abs(F.col("distinct_estimate") - F.col("items")) <= 0.065 * F.col("items") + 1
    few = F.col("n") < 40
    median = few | F.col("q50").between(F.col("near")[0], F.col("near")[1])
    return found.join(exact, same).select("event_type", F.col("day").cast("string").alias("day"), "n", "items", distinct.alias("distinct_within"), median.alias("median_within"))


# Demand by segment over all years, weeks apart: the year-over-year regime among the others.
@register("d2_year_regimes", """WITH daily AS (SELECT c_mktsegment || c_nationkey AS page, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::BIGINT AS day_no, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT page, day_no, sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS spike, sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)::BIGINT AS pulse, sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 89 PRECEDING AND CURRENT ROW)::BIGINT AS persistence,
 sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 364 PRECEDING AND CURRENT ROW)::BIGINT AS baseline, coalesce(sum(n) OVER (PARTITION BY page ORDER BY day_no RANGE BETWEEN 371 PRECEDING AND 365 PRECEDING), 0)::BIGINT AS year_ago FROM daily)
SELECT page, day_no, spike, year_ago, CASE WHEN baseline = pulse THEN 'emerging' WHEN spike / 7.0 > 2 * pulse / 30.0 THEN 'spiking' WHEN pulse / 30.0 < 0.5 * persistence / 90.0 THEN 'decaying' WHEN year_ago > 0 THEN 'recurring' ELSE 'steady' END AS regime FROM w""")
def d2_years(v):
    rows = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
    daily = rows.groupBy(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("page"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("day_no")).agg(F.count(F.lit(1)).alias("n"))
    return search.regimes(daily, ["page"], "day_no", "n").select("page", "day_no", "spike", "year_ago", "regime")


@register("j24_addition_full_outer", "SELECT c.c_custkey, n.n_nationkey FROM (SELECT * FROM customer WHERE c_nationkey < 20) c FULL OUTER JOIN nation n ON c.c_nationkey = n.n_nationkey")
def j24(v):
    return v.customer.where("c_nationkey < 20").join(v.nation, F.col("c_nationkey") == F.col("n_nationkey"), "full").select("c_custkey", "n_nationkey")


def _of(v, kind, *columns):
    return v.events.where(F.col("event_type") == kind).select("user_id", *columns)


# The last view of the user at or before each purchase; of several at one time the greatest id.
@register("j24_asof", """WITH w AS (SELECT user_id, ts, max(event_id) AS view_id, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, w.view_id, w.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts >= w.ts""")
def j24_asof(v):
    views = _of(v, "view", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return temporal.asof_join(_of(v, "purchase", "ts", "event_id"), views, ["user_id"], "ts", "ts", ["view_id", "view_value"], bucket_rows=500).select("event_id", "view_id", "view_value")


# The last event of any kind strictly before each error, if it is six hours old at most.
@register("j24_asof_within", """WITH w AS (SELECT user_id, ts, max(event_id) AS last_id FROM events GROUP BY 1, 2)
SELECT p.event_id, CASE WHEN p.ts - w.ts <= INTERVAL 6 HOUR THEN w.last_id END AS last_id FROM (SELECT * FROM events WHERE event_type = 'error') p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts > w.ts""")
def j24_asof_within(v):
    events = v.events.select("user_id", "ts", F.col("event_id").alias("last_id"))
    return temporal.asof_join(_of(v, "error", "ts", "event_id"), events, ["user_id"], "ts", "ts", ["last_id"], strict=True, tolerance=6 * 3600).select("event_id", "last_id")


WINDOWS = "SELECT user_id, event_id AS {1}, ts AS {0}_s, ts + INTERVAL 1 MINUTE * (event_id * 37 % 2880) AS {0}_e FROM events WHERE event_type = '{2}'"


def _windows(v, side, name, kind):
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") * 37 % 2880).cast("int"))
    return _of(v, kind, F.col("event_id").alias(name), F.col("ts").alias(f"{side}_s"), (F.col("ts") + minutes).alias(f"{side}_e"))


# Events that fall into a window of up to two days after an error of the user.
@register("j24_interval", f"SELECT l.event_id, r.error_id FROM events l JOIN ({WINDOWS.format('r', 'error_id', 'error')}) r ON l.user_id = r.user_id AND l.ts >= r_s AND l.ts < r_e WHERE l.event_type <> 'error'")
def j24_interval(v):
    others = v.events.where("event_type <> 'error'").select("user_id", "event_id", "ts")
    return temporal.interval_join(others, _windows(v, "r", "error_id", "error"), ["user_id"], ("ts", None), ("r_s", "r_e")).select("event_id", "error_id")


# Windows after errors that overlap windows after signups of the user.
@register("j24_interval_overlaps", f"SELECT error_id, signup_id FROM ({WINDOWS.format('l', 'error_id', 'error')}) l JOIN ({WINDOWS.format('r', 'signup_id', 'signup')}) r ON l.user_id = r.user_id AND l_s < r_e AND r_s < l_e AND l_s < l_e AND r_s < r_e")
def j24_overlaps(v):
    return temporal.interval_join(_windows(v, "l", "error_id", "error"), _windows(v, "r", "signup_id", "signup"), ["user_id"], ("l_s", "l_e"), ("r_s", "r_e")).select("error_id", "signup_id")


@register("k19_addition_set_operations", "(SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40) EXCEPT SELECT p_brand FROM part WHERE p_partkey = 1")
def k19(v):
    brands = lambda c: v.part.where(c).select("p_brand")
    return brands("p_size < 10").intersect(brands("p_size > 40")).subtract(brands("p_partkey = 1"))


@register("t1_event_time_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", rounded=("total",))
def t1(v):
    from sightline.streaming.windows import tumbling

    return tumbling(v.events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
