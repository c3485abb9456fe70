"""Registered rank-tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import expr
from sightline.operators import rank
from sightline.plans.registry import register

CUTOFF = "TIMESTAMP '1996-01-01'"
CTR = "(CASE WHEN {0} IS NULL OR {0} < 1 THEN 0.0 WHEN {0} > 20 THEN 0.005 ELSE list_extract([0.28, 0.15, 0.1, 0.07, 0.05, 0.04, 0.033, 0.028, 0.024, 0.021, 0.018, 0.016, 0.014, 0.012, 0.011, 0.01, 0.009, 0.008, 0.007, 0.006], {0})::DOUBLE END)"
DONE = "done AS (SELECT s.* FROM rank_snapshots s WHERE s.run_id IN (SELECT run_id FROM rank_runs WHERE status = 'completed'))"
COMPARED = f"""{DONE},
latest AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY config_id, keyword_id, device ORDER BY checked_at DESC, snapshot_id DESC) = 1),
older AS (SELECT * FROM done WHERE checked_at <= {CUTOFF} QUALIFY row_number() OVER (PARTITION BY config_id, keyword_id, device ORDER BY checked_at DESC, snapshot_id DESC) = 1),
firsts AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY config_id, keyword_id, device ORDER BY checked_at, snapshot_id) = 1),
compared AS (SELECT l.config_id, l.keyword_id, l.device, l.position, CASE WHEN o.snapshot_id IS NOT NULL THEN o.position ELSE f.position END AS previous_position
 FROM latest l LEFT JOIN older o USING (config_id, keyword_id, device) LEFT JOIN firsts f USING (config_id, keyword_id, device))"""
WIDE = f"""{COMPARED},
wide AS (SELECT c.config_id, c.keyword_id, any_value(k.keyword) AS keyword, any_value(k.search_volume) AS search_volume, any_value(k.difficulty) AS difficulty, any_value(k.cpc) AS cpc,
 max(CASE WHEN device = 'desktop' THEN position END) AS dp, max(CASE WHEN device = 'desktop' THEN previous_position END) AS dq,
 max(CASE WHEN device = 'mobile' THEN position END) AS mp, max(CASE WHEN device = 'mobile' THEN previous_position END) AS mq
 FROM compared c LEFT JOIN rank_keywords k USING (keyword_id) GROUP BY c.config_id, c.keyword_id)"""


def _compared(v):
    return rank.compared_results(rank.completed_snapshots(v.rank_snapshots, v.rank_runs), F.expr(CUTOFF))


def _wide(v):
    return rank.by_device(_compared(v)).join(v.rank_keywords, "keyword_id", "left")


def _card_sql(device: str) -> str:
    p, q = ("dp", "dq") if device == "desktop" else ("mp", "mq")
    vol = "CASE WHEN search_volume > 0 THEN search_volume END"
    share = lambda x: f"CASE WHEN sum({vol}) > 0 THEN sum({vol} * {CTR.format(x)}) / (sum({vol}) * 0.28) * 100 END"
    return f"""SELECT config_id, '{device}' AS device, {share(p)} AS visibility, {share(p)} - {share(q)} AS visibility_delta, count({p}) AS ranking, count({p}) - count({q}) AS ranking_delta,
 count(*) FILTER (WHERE {p} <= 3) AS top3, count(*) FILTER (WHERE {p} <= 10) AS top10,
 count(*) FILTER (WHERE {p} < {q} OR ({p} IS NOT NULL AND {q} IS NULL)) AS improved, count(*) FILTER (WHERE {p} > {q} OR ({p} IS NULL AND {q} IS NOT NULL)) AS declined FROM wide GROUP BY config_id"""


@register("rank_scorecards", f"WITH {WIDE} {_card_sql('desktop')} UNION ALL {_card_sql('mobile')}", rounded=("visibility", "visibility_delta",))
def rank_scorecards(v):
    return rank.scorecards(_wide(v), "desktop", "mobile")


@register("w3_compared_results", f"WITH {COMPARED} SELECT * FROM compared")
def w3(v):
    return _compared(v)


@register("w1_latest_ties", f"WITH {DONE} SELECT snapshot_id, keyword_id, device, position FROM done QUALIFY rank() OVER (PARTITION BY config_id, keyword_id, device ORDER BY checked_at DESC) = 1")
def w1(v):
    return rank.latest_snapshots(rank.completed_snapshots(v.rank_snapshots, v.rank_runs), ties=True).select("snapshot_id", "keyword_id", "device", "position")


@register("j11_group_max_self_join", "SELECT s.config_id, s.keyword_id, s.device, s.snapshot_id FROM rank_snapshots s JOIN (SELECT config_id, keyword_id, device, min(checked_at) AS m FROM rank_snapshots GROUP BY ALL) t ON s.config_id = t.config_id AND s.keyword_id = t.keyword_id AND s.device = t.device AND s.checked_at = t.m")
def j11(v):
    return rank.latest_snapshots(v.rank_snapshots, earliest=True, ties=True).select("config_id", "keyword_id", "device", "snapshot_id")


@register("w2_latest_before", f"SELECT snapshot_id, position FROM (SELECT * FROM rank_snapshots WHERE checked_at <= {CUTOFF}) QUALIFY row_number() OVER (PARTITION BY config_id, keyword_id, device ORDER BY checked_at DESC, snapshot_id DESC) = 1")
def w2(v):
    return rank.latest_snapshots(v.rank_snapshots, F.expr(CUTOFF)).select("snapshot_id", "position")


@register("w4_device_pivot", f"WITH {WIDE} SELECT config_id, keyword_id, dp AS desktop_position, dq AS desktop_previous, mp AS mobile_position, mq AS mobile_previous FROM wide")
def w4(v):
    rows = rank.by_device(_compared(v))
    return rows.select("config_id", "keyword_id", *(F.col(f"{d}.{c}").alias(f"{d}_{a}") for d in rank.DEVICES for c, a in (("position", "position"), ("previous_position", "previous"))))


@register("a1_position_buckets", """SELECT r.run_id, r.started_at, count(*) AS total, sum(CASE WHEN position BETWEEN 1 AND 3 THEN 1 ELSE 0 END)::BIGINT AS top3, sum(CASE WHEN position BETWEEN 4 AND 10 THEN 1 ELSE 0 END)::BIGINT AS top10, sum(CASE WHEN position BETWEEN 11 AND 20 THEN 1 ELSE 0 END)::BIGINT AS top20,
 greatest(0, count(*) - sum(CASE WHEN position BETWEEN 1 AND 20 THEN 1 ELSE 0 END))::BIGINT AS not_ranking FROM rank_snapshots s JOIN rank_runs r USING (run_id) WHERE s.device = 'desktop' AND status = 'completed' AND NOT is_subset AND started_at >= TIMESTAMP '1994-01-01' GROUP BY r.run_id, r.started_at""")
def a1(v):
    return rank.position_buckets(v.rank_snapshots, v.rank_runs, "desktop", F.expr("TIMESTAMP '1994-01-01'"))


@register("a2_a3_a19_run_counts", "SELECT run_id, count(*) AS checks, count(DISTINCT keyword_id) AS keywords, min(checked_at) AS first_check, max(checked_at) AS last_check FROM rank_snapshots GROUP BY run_id")
def a2(v):
    return v.rank_snapshots.groupBy("run_id").agg(F.count(F.lit(1)).alias("checks"), F.countDistinct("keyword_id").alias("keywords"), F.min("checked_at").alias("first_check"), F.max("checked_at").alias("last_check"))


@register("j1_snapshots_runs", "SELECT s.snapshot_id, r.started_at, r.status FROM rank_snapshots s JOIN rank_runs r ON s.run_id = r.run_id WHERE s.keyword_id = 7")
def j1(v):
    return v.rank_snapshots.where("keyword_id = 7").join(v.rank_runs, "run_id").select("snapshot_id", "started_at", "status")


@register("j8_completed_semi_join", "SELECT snapshot_id FROM rank_snapshots WHERE run_id IN (SELECT run_id FROM rank_runs WHERE status = 'completed')")
def j8(v):
    return rank.completed_snapshots(v.rank_snapshots, v.rank_runs).select("snapshot_id")


@register("a8_dashboard_rollup", f"WITH {WIDE}, flat AS (SELECT config_id, dp AS p, dq AS q FROM wide UNION ALL SELECT config_id, mp, mq FROM wide) SELECT count(p) AS ranking, count(*) FILTER (WHERE p <= 10) AS top10, count(*) FILTER (WHERE p < q) AS improved, count(*) FILTER (WHERE p > q) AS declined FROM flat WHERE config_id IN (SELECT DISTINCT config_id FROM wide ORDER BY 1 LIMIT 3)")
def a8(v):
    return rank.dashboard_rollup(rank.by_device(_compared(v)), 3)


@register("f6_rank_filter", f"WITH {WIDE} SELECT config_id, keyword_id FROM wide WHERE (contains(keyword, 'anvil') OR contains(keyword, 'blue')) AND NOT contains(keyword, 'gizmo') AND dp BETWEEN 2 AND 30 AND search_volume >= 10 AND difficulty IS NOT NULL AND difficulty <= 80")
def f6(v):
    return rank.filter_rows(_wide(v), include="anvil, BLUE ,", exclude="gizmo", desktop=(2, 30), volume=(10, None), difficulty=(None, 80)).select("config_id", "keyword_id")


@register("f7_unranked_filter", f"WITH {WIDE} SELECT config_id, keyword_id FROM wide WHERE mp IS NULL")
def f7(v):
    return rank.filter_rows(_wide(v), mobile=(None, 0)).select("config_id", "keyword_id")


@register("f8_metric_range", f"WITH {WIDE} SELECT config_id, keyword_id FROM wide WHERE search_volume IS NOT NULL AND search_volume BETWEEN 20 AND 1000 AND cpc IS NOT NULL AND cpc >= 9.005")
def f8(v):
    return rank.filter_rows(_wide(v), volume=(20, 1000), cpc=(9.005, None)).select("config_id", "keyword_id")


@register("f9_config_filter", "SELECT config_id FROM rank_configs WHERE contains(domain, '00') AND devices = 'both' AND location_code = 7")
def f9(v):
    return rank.filter_configs(v.rank_configs, " 00 ", "both", 7).select("config_id")


@register("f9_config_options", """WITH o AS (SELECT DISTINCT 'device' AS kind, devices AS value, CASE devices WHEN 'both' THEN '0' WHEN 'desktop' THEN '1' ELSE '2' END AS sort FROM rank_configs UNION ALL SELECT DISTINCT 'location', CAST(location_code AS VARCHAR), CAST(location_code AS VARCHAR) FROM rank_configs)
SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY sort) AS place FROM o""")
def f9_options(v):
    return rank.config_options(v.rank_configs)


@register("j14_config_summary", """SELECT c.config_id, c.domain, coalesce(k.n, 0) AS keywords, r.run_id AS last_run, r.started_at AS last_started FROM rank_configs c
LEFT JOIN (SELECT config_id, count(DISTINCT keyword_id) AS n FROM rank_snapshots GROUP BY config_id) k USING (config_id)
LEFT JOIN (SELECT config_id, run_id, started_at FROM rank_runs QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY started_at DESC, run_id DESC) = 1) r USING (config_id)""")
def j14(v):
    return rank.config_summary(v.rank_configs, v.rank_snapshots, v.rank_runs)


@register("j7_k20_due_configs", "SELECT c.config_id FROM rank_configs c JOIN projects p USING (project_id) WHERE is_active AND NOT archived AND c.config_id % 11 < 4 ORDER BY c.config_id LIMIT 50")
def k20(v):
    return rank.due_configs(v.rank_configs, v.projects, F.col("config_id") % 11 < 4).select("config_id")


@register("f3_null_aware_match", "SELECT config_id FROM rank_configs WHERE location_code = 8 AND location_name IS NOT DISTINCT FROM NULL")
def f3(v):
    return rank.same_market(v.rank_configs, 8, None).select("config_id")


MATRIX = """recent AS (SELECT run_id, started_at FROM rank_runs WHERE config_id = 1 AND status = 'completed' ORDER BY started_at DESC, run_id DESC LIMIT 6),
cells AS (SELECT run_id, keyword_id, position FROM rank_snapshots WHERE device = 'desktop' AND run_id IN (SELECT run_id FROM recent)),
grid AS (SELECT k.keyword_id, r.run_id, r.started_at, c.position FROM (SELECT DISTINCT keyword_id FROM cells) k CROSS JOIN recent r LEFT JOIN cells c ON c.keyword_id = k.keyword_id AND c.run_id = r.run_id)"""


@register("w5_k6_history_matrix", f"WITH {MATRIX} SELECT run_id, keyword_id, position, lag(position) OVER (PARTITION BY keyword_id ORDER BY started_at, run_id) - position AS change FROM grid")
def w5(v):
    return rank.history_matrix(v.rank_snapshots, v.rank_runs, 1, "desktop", 6)


@register("w6_w16_keyword_history", "SELECT snapshot_id, device, position, lag(position) OVER (PARTITION BY config_id, device ORDER BY checked_at, snapshot_id) AS previous FROM rank_snapshots WHERE keyword_id = 3 AND checked_at >= TIMESTAMP '1995-06-01'")
def w6(v):
    return rank.keyword_history(v.rank_snapshots, 3, F.expr("TIMESTAMP '1995-06-01'")).select("snapshot_id", "device", "position", "previous")


@register("w17_chart_series", "SELECT checked_at, min(CASE WHEN device = 'desktop' THEN coalesce(position, 50) END) AS desktop, min(CASE WHEN device = 'mobile' THEN coalesce(position, 50) END) AS mobile FROM rank_snapshots WHERE keyword_id = 3 GROUP BY checked_at")
def w17(v):
    return rank.chart_series(v.rank_snapshots.where("keyword_id = 3"), 50)


@register("w9_next_check", """SELECT o_orderkey, o_orderdate + INTERVAL (7 * (CAST(floor(greatest(0, epoch(TIMESTAMP '1997-03-05 06:00:00') - epoch(o_orderdate)) / 604800) AS BIGINT) + 1)) DAY AS weekly,
 (SELECT min(x) FROM (SELECT CAST(last_day(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL (k) MONTH) AS TIMESTAMP) + (o_orderdate - date_trunc('day', o_orderdate)) AS x FROM range(1, 80) t(k)) WHERE x > TIMESTAMP '1997-03-05 06:00:00') AS monthly FROM orders""")
def w9(v):
    now = F.expr("TIMESTAMP '1997-03-05 06:00:00'")
    rows = v.orders
    return rows.select("o_orderkey", expr.next_check("o_orderdate", now, "weekly").cast("timestamp_ntz").alias("weekly"), expr.next_check("o_orderdate", now, "monthly").cast("timestamp_ntz").alias("monthly"))


@register("e19_check_estimate", """WITH c AS (SELECT config_id, floor((config_id % 90) * (CASE WHEN devices = 'both' THEN 2 ELSE 1 END) * (0.002::DOUBLE + (depth / 10 - 1) * 0.0015::DOUBLE) * 1.25::DOUBLE * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS cost_usd FROM rank_configs)
SELECT config_id, cost_usd, CAST(ceil(cost_usd * 1000) AS BIGINT) AS cost_credits FROM c""")
def e19(v):
    return rank.check_estimate(v.rank_configs.withColumn("keywords", F.col("config_id") % 90)).select("config_id", "cost_usd", "cost_credits")


@register("k23_bounded_add", """WITH w AS (SELECT lower(trim(p_name)) AS keyword, min(p_partkey) AS ordinal FROM part GROUP BY 1) SELECT keyword, ordinal FROM w WHERE keyword NOT IN (SELECT keyword FROM rank_keywords WHERE keyword_id < 10) ORDER BY ordinal, keyword LIMIT 10""")
def k23(v):
    return rank.add_keywords(v.rank_keywords.where("keyword_id < 10"), v.part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("keyword"), F.col("p_partkey").alias("ordinal")), 20)


@register("addition_competitor_visibility", f"WITH {DONE}, latest AS (SELECT * FROM done WHERE device = 'desktop' QUALIFY row_number() OVER (PARTITION BY config_id, keyword_id, device ORDER BY checked_at DESC, snapshot_id DESC) = 1) SELECT config_id, sum(coalesce(search_volume, 0) * {CTR.format('position')}) AS captured FROM latest JOIN rank_keywords USING (keyword_id) GROUP BY config_id", rounded=("captured",))
def visibility(v):
    done = rank.completed_snapshots(v.rank_snapshots, v.rank_runs).where("device = 'desktop'")
    return rank.competitor_visibility(rank.latest_snapshots(done), v.rank_keywords.select("keyword_id", "search_volume"))
