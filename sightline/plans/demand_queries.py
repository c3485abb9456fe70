"""Registered demand-evidence queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.functions import expr, text
from sightline.operators import definitions, demand
from sightline.operators.incremental import EventStore
from sightline.operators.temporal import quantiles
from sightline.plans.registry import register
from sightline.sources import tables
from sightline.sources.commits import CommitTable, claim, versioned_updates
from sightline.sources.staging import shared_folder

HOUR = "TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * {0}"


def _obs(v):
    """Observations with typed times, url keys and title tokens."""
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    rows = v.observations.withColumns({"published": at("published_hour"), "collected": at("collected_hour"), "url_key": F.nullif("canonical_url", F.lit(""))})
    return rows.withColumn("tokens", text.title_tokens(text.normal_text(F.col("title"), compatible=False)))


TOKENS = "o AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 1)) AS tk FROM observations)"
PAIRS = f"""{TOKENS}, pr AS (SELECT x.obs_id AS a, y.obs_id AS b, x.platform = y.platform AS same, abs(x.published_hour - y.published_hour) AS h,
 (x.connection_id = y.connection_id AND x.external_id = y.external_id) AS rec, coalesce(x.canonical_url <> '' AND x.canonical_url = y.canonical_url, false) AS can,
 CASE WHEN len(x.tk) = 0 AND len(y.tk) = 0 THEN 1.0 WHEN len(x.tk) = 0 OR len(y.tk) = 0 THEN 0.0 ELSE len(list_intersect(x.tk, y.tk))::DOUBLE / (len(x.tk) + len(y.tk) - len(list_intersect(x.tk, y.tk))) END AS s
 FROM o x JOIN o y ON x.family_id = y.family_id AND x.obs_id < y.obs_id),
edges AS (SELECT a, b, s, rec OR can AS certain, CASE WHEN rec THEN 'exact' WHEN can THEN 'canonical' WHEN NOT same AND s >= 0.78 AND h <= 336 THEN 'syndicated' WHEN same AND s >= 0.86 AND h <= 72 THEN 'exact' WHEN same AND s >= 0.7 AND s < 0.86 AND h <= 72 THEN 'semantic' END AS relation FROM pr)"""
EVENTS = f"""{PAIRS}, both_ways AS (SELECT a, b FROM edges WHERE relation IS NOT NULL UNION SELECT b, a FROM edges WHERE relation IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
roots AS (SELECT o.obs_id, least(o.obs_id, coalesce(min(r.b), o.obs_id)) AS root FROM o LEFT JOIN reach r ON r.a = o.obs_id GROUP BY o.obs_id),
ev AS (SELECT o.family_id, root, arg_min(o.obs_id, (o.collected_hour, o.obs_id)) AS event_anchor, count(*) AS raw_count, list_sort(list(DISTINCT source_class)) AS source_classes, list_sort(list(DISTINCT geography) FILTER (WHERE trim(geography) <> '')) AS geographies,
 min(published_hour) AS first_hour, max(published_hour) AS last_hour, bool_and(baseline) AS baseline_only, bool_or(source_class <> 'generated_candidate' AND NOT baseline) AS promotable FROM o JOIN roots USING (obs_id) GROUP BY o.family_id, root)"""
FAMILY = f"""{EVENTS}, fam AS (SELECT family_id, count(*) AS events, sum(raw_count)::BIGINT AS raw_count, bool_or(list_contains(source_classes, 'first_party_observed')) AS has_first_party, bool_or(list_contains(source_classes, 'primary_authoritative')) AS has_primary, bool_or(list_contains(source_classes, 'search_observed')) AS has_search,
 bool_and(len(list_filter(source_classes, lambda c: c <> 'generated_candidate')) = 0) AS generated_only, bool_and(baseline_only) AS baseline_only, bool_or(promotable) AS promotable, min(first_hour) AS first_hour, max(last_hour) AS last_hour, len(list_distinct(flatten(list(coalesce(geographies, []))))) AS geography_count FROM ev GROUP BY family_id)"""


def _events(v):
    obs = _obs(v)
    return demand.evidence_events(obs, demand.duplicate_edges(obs))


# Equal records, urls and titles of one platform and time: each row with the first of its group, and the group's size. The first rows
# of the title groups are paired with each other, whether of one title or of similar ones.
STARS = """oo AS (SELECT *, array_to_string(list_sort(tk), ' ') AS key FROM o),
gr AS (SELECT min(obs_id) OVER w AS a, obs_id AS b, count(*) OVER w AS rec_size, NULL::BIGINT AS can_size, NULL::BIGINT AS title_size FROM oo WINDOW w AS (PARTITION BY family_id, connection_id, external_id)
 UNION ALL SELECT min(obs_id) OVER w, obs_id, NULL, count(*) OVER w, NULL FROM oo WHERE canonical_url <> '' WINDOW w AS (PARTITION BY family_id, canonical_url)
 UNION ALL SELECT min(obs_id) OVER w, obs_id, NULL, NULL, count(*) OVER w FROM oo WHERE published_hour IS NOT NULL WINDOW w AS (PARTITION BY family_id, key, platform, published_hour)),
cells AS (SELECT family_id, key, platform, published_hour, min(obs_id) AS id, any_value(tk) AS tk FROM oo WHERE published_hour IS NOT NULL GROUP BY 1, 2, 3, 4),
cand AS (SELECT a, b, rec_size, can_size, title_size FROM gr WHERE a <> b UNION ALL SELECT x.id, y.id, NULL, NULL, NULL FROM cells x JOIN cells y ON x.family_id = y.family_id AND x.key = y.key AND x.id < y.id
 UNION ALL SELECT least(x.id, y.id), greatest(x.id, y.id), NULL, NULL, NULL FROM cells x JOIN cells y ON x.family_id = y.family_id AND x.key < y.key AND abs(x.published_hour - y.published_hour) <= 336 AND len(list_intersect(x.tk, y.tk)) >= 0.7 * (len(x.tk) + len(y.tk) - len(list_intersect(x.tk, y.tk))) WHERE len(x.tk) > 0 AND len(y.tk) > 0),
stars AS (SELECT a, b, coalesce(max(rec_size), max(can_size), max(title_size)) AS group_size FROM cand GROUP BY a, b)"""


@register("e9_j17_duplicate_edges", f"WITH {PAIRS}, {STARS} SELECT a, b, relation, CASE WHEN certain THEN 1.0 ELSE floor(s * 10000::DOUBLE + 0.5::DOUBLE) / 10000 END::DOUBLE AS similarity, group_size::BIGINT AS group_size FROM edges JOIN stars USING (a, b) WHERE relation IS NOT NULL AND (NOT certain OR group_size IS NOT NULL)")
def e9(v):
    return demand.duplicate_edges(_obs(v), every=True).select("a", "b", "relation", "similarity", "group_size")


@register("e12_a16_evidence_events", f"WITH RECURSIVE {EVENTS} SELECT family_id, event_anchor, raw_count, array_to_string(source_classes, ',') AS classes, coalesce(array_to_string(geographies, ','), '') AS geographies, first_hour, last_hour, baseline_only FROM ev")
def e12(v):
    hours = lambda c: F.floor(F.unix_seconds(c) / 3600).alias(c.replace("observed", "hour"))
    return _events(v).select("family_id", "event_anchor", "raw_count", F.array_join("source_classes", ",").alias("classes"), F.array_join("geographies", ",").alias("geographies"), hours("first_observed"), hours("last_observed"), "baseline_only")


def _stored_events(v, batch):
    """Events of a store that takes the observations batch by batch."""
    obs = _obs(v).withColumn("batch", batch)
    store = EventStore(obs.sparkSession, f"{shared_folder(obs.sparkSession)}/events-{uuid.uuid4().hex}")
    for k in range(3):
        store.apply(k, obs.where(F.col("batch") == k))
    hours = lambda c: F.floor(F.unix_seconds(c) / 3600).alias(c.replace("observed", "hour"))
    return store.events().select("family_id", "event_anchor", "raw_count", F.array_join("source_classes", ",").alias("classes"), F.array_join("geographies", ",").alias("geographies"), hours("first_observed"), hours("last_observed"), "baseline_only")


STORED = "SELECT family_id, event_anchor, raw_count, array_to_string(source_classes, ',') AS classes, coalesce(array_to_string(geographies, ','), '') AS geographies, first_hour, last_hour, baseline_only FROM ev"


# Batches in no order of time: each brings rows that are earlier than stored ones and join their events.
@register("e12_incremental_events", f"WITH RECURSIVE {EVENTS} {STORED}")
def e12_incremental(v):
    return _stored_events(v, F.expr("CAST(substr(obs_id, 2) AS INT) % 3"))


# Batches in the order of collection, published at any time: what comes later joins events without renaming them.
@register("t5_late_evidence", f"WITH RECURSIVE {EVENTS}, cut AS (SELECT quantile_disc(collected_hour, [0.33, 0.66]) AS q FROM observations), b AS (SELECT o.obs_id, CASE WHEN o.collected_hour <= q[1] THEN 0 WHEN o.collected_hour <= q[2] THEN 1 ELSE 2 END AS born FROM o, cut) SELECT s.*, b.born FROM ({STORED}) s JOIN b ON b.obs_id = s.event_anchor")
def t5_late(v):
    obs = _obs(v)
    hour = F.floor(F.unix_seconds("collected") / 3600)
    cuts = quantiles(obs, hour, ["0.33", "0.66"])
    batch = F.when(hour <= cuts[0], 0).when(hour <= cuts[1], 1).otherwise(2)
    named = obs.select("obs_id", batch.alias("born")).withColumnRenamed("obs_id", "event_anchor")
    return _stored_events(v, batch).join(named, "event_anchor")


@register("a15_a20_family_evidence", f"WITH RECURSIVE {FAMILY} SELECT family_id, events, raw_count, has_first_party, has_primary, has_search, generated_only, baseline_only, promotable, geography_count, CASE WHEN geography_count >= 2 THEN 1.0 WHEN geography_count = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS geography FROM fam")
def a15(v):
    rows = demand.family_evidence(_events(v)).withColumn("geography", demand.geography_signal())
    return rows.select("family_id", "events", "raw_count", "has_first_party", "has_primary", "has_search", "generated_only", "baseline_only", "promotable", "geography_count", "geography")


SIGNALS = [*demand.POSITIVE, *demand.PENALTY]


def _signals(v):
    return v.orders.select("o_orderkey", *(((F.col("o_orderkey") * (7 + 2 * i) % 101) / 100.0 + (0.4 if i < 13 else -0.2)).alias(c) for i, c in enumerate(SIGNALS)))


def _sum(weights: dict[str, float]) -> str:
    return " + ".join(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {c})) * {w}::DOUBLE" for c, w in weights.items())


_SIG = ", ".join(f"(o_orderkey * {7 + 2 * i} % 101) / 100.0::DOUBLE + {0.4 if i < 13 else -0.2}::DOUBLE AS {c}" for i, c in enumerate(SIGNALS))
_CONF = " + ".join(f"{c} * {w}::DOUBLE" for c, w in demand.CONFIDENCE.items())
SCORED = f"""sig AS (SELECT o_orderkey, {_SIG} FROM orders), sc AS (SELECT o_orderkey, ({_sum(demand.POSITIVE)}) * 100 AS pos, ({_sum(demand.PENALTY)}) * 35 AS pen,
 least(1.0, greatest(0.0, (1 - least(1.0, greatest(0.0, uncertainty))) * 0.06::DOUBLE + {_CONF})) AS sure FROM sig), pr AS (SELECT *, least(100.0, greatest(0.0, pos - pen)) AS pri FROM sc)"""


@register("e1_e2_e3_signal_score", f"WITH {SCORED} SELECT o_orderkey, floor(floor(pri * 100 + 0.5) / 100 * 10 + 0.5) / 10 AS priority, floor(floor(sure * 10000 + 0.5) / 10000 * 1000 + 0.5) / 1000 AS confidence, CASE WHEN pri >= 75 AND sure >= 0.65 THEN 'ship_now' WHEN pri >= 55 AND sure >= 0.45 THEN 'validate_next' WHEN pri >= 35 THEN 'monitor' ELSE 'reject' END AS band FROM pr")
def e1(v):
    rows = demand.signal_score(_signals(v))
    return rows.select("o_orderkey", expr.half_up("priority", 1).alias("priority"), expr.half_up("confidence", 3).alias("confidence"), "band")


VECTOR = {c: f"(o_orderkey * {3 + 2 * i} % 11) / 10.0" for i, c in enumerate(demand.POINTS)}
FLAGS = {c: f"o_orderkey % {13 + 4 * i} = 0" for i, c in enumerate(demand.DEDUCTIONS)}
_PTS = " + ".join(f"floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {VECTOR[c]}::DOUBLE)) * {m} * 100 + 0.5) / 100" for c, m in demand.POINTS.items())
_DED = " + ".join(f"CASE WHEN {FLAGS[c]} THEN {m}.0 ELSE 0.0 END" for c, m in demand.DEDUCTIONS.items())
POINTS = f"""pt AS (SELECT o_orderkey, o_custkey % 9 AS project_id, least(100.0, {_PTS})::DOUBLE AS pos, ({_DED})::DOUBLE AS pen, {FLAGS['compliance_uncertainty']} AS blocked, {FLAGS['vanity']} AS generated_only, o_orderkey % 19 = 0 AS baseline_only, o_orderkey % 23 <> 0 AS promotable,
 floor((0.35 * ({VECTOR['corroboration']}) + 0.25 * ({VECTOR['citation']}) + 0.2 * ({VECTOR['geography']}) + CASE WHEN {FLAGS['compliance_uncertainty']} THEN 0.0 ELSE 0.2 END)::DOUBLE * 1000 + 0.5) / 1000 AS confidence FROM orders),
pp AS (SELECT *, least(100.0, greatest(0.0, pos - pen)) AS pri FROM pt), pb AS (SELECT *, CASE WHEN blocked THEN 'reject' WHEN pri >= 75 THEN 'ship_now' WHEN pri >= 60 THEN 'validate_next' WHEN pri >= 45 THEN 'monitor' ELSE 'reject' END AS band FROM pp)"""


def _points(v):
    rows = v.orders.select("o_orderkey", (F.col("o_custkey") % 9).alias("project_id"), *(F.expr(x).cast("double").alias(c) for c, x in VECTOR.items()), *(F.expr(x).alias(c) for c, x in FLAGS.items()), F.expr("o_orderkey % 19 = 0").alias("baseline_only"), F.expr("o_orderkey % 23 <> 0").alias("promotable"))
    return demand.points_score(rows)


@register("e4_e5_points_score", f"WITH {POINTS} SELECT o_orderkey, pos AS positive_score, pen AS penalty_score, pri AS priority, confidence, band FROM pb")
def e4(v):
    return _points(v).select("o_orderkey", "positive_score", "penalty_score", "priority", expr.half_up("confidence", 3).alias("confidence"), "band")


@register("k8_feed_selection", f"""WITH {POINTS}, g AS (SELECT *, CASE WHEN generated_only THEN 'generated_only_evidence' WHEN baseline_only THEN 'baseline_fingerprint_only' WHEN NOT promotable THEN 'no_promotable_observed_evidence' WHEN blocked THEN 'compliance_blocked' WHEN pri < 45 THEN 'below_score_threshold' END AS gate FROM pb),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, gate IS NULL ORDER BY pri DESC, confidence DESC, o_orderkey) AS n FROM g)
SELECT o_orderkey AS family_id, CASE WHEN gate IS NULL AND n > 5 THEN 'feed_limit' ELSE gate END AS reason, CASE WHEN gate IS NULL AND n <= 5 THEN n END AS rank, CASE WHEN gate IS NULL AND n <= 5 THEN CASE WHEN band = 'monitor' THEN 'monitor_only' ELSE 'add_faq' END END AS action FROM k""")
def k8(v):
    rows = _points(v).withColumns({"family_id": F.col("o_orderkey"), "generated_only": F.col("vanity"), "events": F.lit(1), "action": F.lit("add_faq"), "confidence": expr.half_up("confidence", 3)})
    return demand.select_feed(rows).select("family_id", "reason", "rank", "action")


NORM = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"
MATCH = f"""f AS (SELECT obs_id AS family_id, project_id, {NORM} AS needle FROM observations WHERE CAST(substr(obs_id, 2) AS INT) % 3 = 2),
a AS (SELECT project_id, concat('https://a.test/', obs_id) AS url, CASE CAST(substr(obs_id, 2) AS INT) % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'faq' ELSE 'tool' END AS kind, {NORM} AS intent, CAST(substr(obs_id, 2) AS INT) % 120 AS age FROM observations WHERE CAST(substr(obs_id, 2) AS INT) % 3 <> 2),
t AS (SELECT family_id, url, kind, age, needle = intent AS exact, list_distinct(list_filter(string_split(needle, ' '), lambda t: length(t) > 1)) AS x, list_distinct(list_filter(string_split(intent, ' '), lambda t: length(t) > 1)) AS y FROM f JOIN a USING (project_id) WHERE needle <> '' AND intent <> ''),
s AS (SELECT *, CASE WHEN exact THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS strength FROM t),
best AS (SELECT * FROM s WHERE exact OR strength >= 0.34 QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY strength DESC, exact DESC, CASE kind WHEN 'page' THEN 0 WHEN 'faq' THEN 3 ELSE 5 END, url) = 1)"""


def _assets(v):
    n = F.expr("CAST(substr(obs_id, 2) AS INT)")
    normal = text.normal_text(F.col("title"), compatible=False)
    kind = F.when(n % 3 == 0, "page").when(n % 3 == 1, "faq").otherwise("tool")
    return v.observations.where(n % 3 != 2).select("project_id", F.concat(F.lit("https://a.test/"), "obs_id").alias("url"), kind.alias("kind"), normal.alias("intent"), F.expr("TIMESTAMP '2024-06-01'").alias("now"), n.alias("n")).withColumn("updated", F.col("now") - F.make_dt_interval(F.col("n") % 120)).drop("now", "n")


def _families(v):
    """Observations that are no assets."""
    n = F.expr("CAST(substr(obs_id, 2) AS INT)")
    return v.observations.where(n % 3 == 2).select(F.col("obs_id").alias("family_id"), "project_id", F.array(text.normal_text(F.col("title"), compatible=False)).alias("needles"))


@register("j19_best_match", f"WITH {MATCH} SELECT family_id, url, exact, floor(strength * 10000::DOUBLE + 0.5) / 10000 AS strength FROM best")
def j19(v):
    return demand.best_matches(_families(v), _assets(v)).select("family_id", "url", "exact", expr.half_up("strength", 4).alias("strength"))


@register("e14_e15_coverage", f"""WITH {MATCH}, c AS (SELECT f.family_id, CASE WHEN url IS NULL THEN 'gap' WHEN exact AND (age <= 7 OR (age < 90 AND floor((90 - age) / 83.0::DOUBLE * 10000 + 0.5) / 10000 >= 0.5)) THEN 'covered' ELSE 'partial' END AS status, kind, strength FROM f LEFT JOIN best USING (family_id))
SELECT family_id, status, CASE status WHEN 'gap' THEN 'create_supporting_page' ELSE CASE kind WHEN 'page' THEN 'update_existing_page' WHEN 'faq' THEN 'add_faq' ELSE 'create_tool' END END AS action, CASE status WHEN 'gap' THEN 1.0 WHEN 'covered' THEN 0.1 ELSE 0.5 END::DOUBLE AS coverage_gap, CASE WHEN status = 'covered' THEN strength ELSE 0.0 END::DOUBLE AS risk FROM c""")
def e14(v):
    rows = demand.coverage(_families(v), demand.best_matches(_families(v), _assets(v)), F.expr("TIMESTAMP '2024-06-01'"))
    return rows.select("family_id", "status", "action", "coverage_gap", F.col("cannibalization_risk").alias("risk"))


@register("e16_e17_evidence_to_feed")
def e17(v):
    """Observations to feed: edges, events, evidence, coverage, vector, score, feed."""
    evidence = demand.family_evidence(_events(v)).withColumns({"project_id": F.lit(1), "needles": F.array(F.col("family_id"))})
    now = F.expr("TIMESTAMP '2024-02-01'")
    covered = demand.coverage(evidence, demand.best_matches(evidence, _assets(v)), now).withColumn("freshness", expr.freshness("last_observed", now, baseline="baseline_only"))
    scored = demand.points_score(demand.with_vector(covered))
    return demand.select_feed(scored).select("family_id", "priority", "confidence", "band", "status", "reason", "rank", "action")


# A whole run: titles as needles, inventories of three projects (one of them unknown), and families that each gate stops.
RUN_OBS = """numbered AS (SELECT *, CAST(substr(obs_id, 2) AS INT) AS n FROM observations),
run_obs AS (SELECT * REPLACE (concat('p', CAST(n % 3 AS VARCHAR), '-f', CAST(n % 36 AS VARCHAR)) AS family_id) FROM numbered WHERE CASE n % 36 WHEN 5 THEN n % 5 = 4 WHEN 7 THEN n % 8 = 7 WHEN 11 THEN n % 5 = 4 OR n % 8 = 7 ELSE true END)"""
DEMAND_RUN = f"""WITH RECURSIVE {RUN_OBS}, {FAMILY.replace('FROM observations', 'FROM run_obs')},
f AS (SELECT family_id, min(n % 3) AS project_id, min(n % 36) AS number, arg_min({NORM}, n) AS needle FROM run_obs GROUP BY family_id),
a AS (SELECT n % 3 AS project_id, concat('https://a.test/', obs_id) AS url, CASE n % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'faq' ELSE 'tool' END AS kind, {NORM} AS intent, n % 120 AS age FROM numbered WHERE n % 4 = 0),
t AS (SELECT family_id, url, kind, age, needle = intent AS exact, list_distinct(list_filter(string_split(needle, ' '), lambda t: length(t) > 1)) AS x, list_distinct(list_filter(string_split(intent, ' '), lambda t: length(t) > 1)) AS y FROM f JOIN a USING (project_id) WHERE needle <> '' AND intent <> ''),
s AS (SELECT *, CASE WHEN exact THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS strength FROM t),
best AS (SELECT * FROM s WHERE exact OR strength >= 0.34 QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY strength DESC, exact DESC, CASE kind WHEN 'page' THEN 0 WHEN 'faq' THEN 3 ELSE 5 END, url) = 1),
c AS (SELECT fam.*, f.project_id, f.number, kind, strength, CASE WHEN f.project_id = 2 THEN 'unknown' WHEN url IS NULL THEN 'gap' WHEN exact AND age <= 48 THEN 'covered' ELSE 'partial' END AS status,
 CASE WHEN last_hour IS NULL OR baseline_only THEN 0.0 WHEN 744 - last_hour <= 168 THEN 1.0 WHEN 744 - last_hour >= 2160 THEN 0.0 ELSE floor((90 - (744 - last_hour) / 24.0::DOUBLE) / 83 * 10000 + 0.5) / 10000 END::DOUBLE AS fresh FROM fam JOIN f USING (family_id) LEFT JOIN best USING (family_id)),
v AS (SELECT *, CASE WHEN geography_count >= 2 THEN 1.0 WHEN geography_count = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS geo, least(1.0, events / 3.0::DOUBLE) AS corr, CASE WHEN has_first_party OR has_search THEN 0.6 ELSE 0.3 END::DOUBLE AS useful, CASE WHEN has_primary THEN 0.8 WHEN has_search THEN 0.4 ELSE 0.0 END::DOUBLE AS cit, CASE WHEN number % 4 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS com,
 CASE status WHEN 'unknown' THEN 0.0 WHEN 'gap' THEN 1.0 WHEN 'covered' THEN 0.1 ELSE 0.5 END::DOUBLE AS gap, number % 36 = 13 AS blocked, status = 'covered' AND strength >= 0.5 AS cannibal FROM c),
p AS (SELECT *, least(100.0, {' + '.join(f'floor({c} * {m} * 100 + 0.5) / 100' for c, m in (('geo', 20), ('corr', 20), ('fresh', 15), ('useful', 15), ('gap', 10), ('cit', 10), ('com', 10)))})::DOUBLE - CASE WHEN blocked THEN 30 ELSE 0 END - CASE WHEN generated_only THEN 20 ELSE 0 END - CASE WHEN cannibal THEN 20 ELSE 0 END AS raw,
 floor((0.35::DOUBLE * corr + 0.25::DOUBLE * cit + 0.2::DOUBLE * geo + CASE WHEN blocked THEN 0.0 ELSE 0.2 END::DOUBLE) * 1000 + 0.5) / 1000 AS sure FROM v),
q AS (SELECT *, greatest(0.0, raw) AS priority, CASE WHEN generated_only THEN 'generated_only_evidence' WHEN baseline_only THEN 'baseline_fingerprint_only' WHEN NOT promotable THEN 'no_promotable_observed_evidence' WHEN blocked THEN 'compliance_blocked' WHEN greatest(0.0, raw) < 45 THEN 'below_score_threshold' END AS gate FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, gate IS NULL ORDER BY priority DESC, sure DESC, family_id) AS place FROM q)
SELECT family_id, project_id::BIGINT AS project_id, status, priority, sure AS confidence, CASE WHEN gate IS NULL AND place > 5 THEN 'feed_limit' ELSE gate END AS reason, CASE WHEN gate IS NULL AND place <= 5 THEN place END AS rank,
 CASE WHEN gate IS NULL AND place <= 5 THEN CASE WHEN priority < 60 OR status = 'unknown' THEN 'monitor_only' WHEN status = 'gap' THEN 'create_supporting_page' WHEN kind = 'page' THEN 'update_existing_page' WHEN kind = 'faq' THEN 'add_faq' ELSE 'create_tool' END END AS action FROM k"""


@register("e16_e17_demand_run", DEMAND_RUN, rounded=("priority", "confidence"))
def e17_run(v):
    number = F.expr("CAST(substr(obs_id, 2) AS INT)")
    every = _obs(v).withColumn("n", number)
    family = F.concat(F.lit("p"), (F.col("n") % 3).cast("string"), F.lit("-f"), (F.col("n") % 36).cast("string"))
    kept = F.expr("CASE n % 36 WHEN 5 THEN n % 5 = 4 WHEN 7 THEN n % 8 = 7 WHEN 11 THEN n % 5 = 4 OR n % 8 = 7 ELSE true END")
    obs = every.where(kept).withColumn("family_id", family)
    normal = text.normal_text(F.col("title"), compatible=False)
    named = obs.groupBy("family_id").agg(F.min(F.col("n") % 3).cast("long").alias("project_id"), F.min(F.col("n") % 36).alias("number"), F.array(F.min_by(normal, "n")).alias("needles"))
    evidence = demand.family_evidence(demand.evidence_events(obs, demand.duplicate_edges(obs))).join(named, "family_id")
    kind = F.when(F.col("n") % 3 == 0, "page").when(F.col("n") % 3 == 1, "faq").otherwise("tool")
    asked = F.expr("TIMESTAMP '2024-06-01'")
    assets = every.where("n % 4 = 0").select((F.col("n") % 3).cast("long").alias("project_id"), F.concat(F.lit("https://a.test/"), "obs_id").alias("url"), kind.alias("kind"), normal.alias("intent"), (asked - F.make_dt_interval(F.col("n") % 120)).alias("updated"))
    covered = demand.coverage(evidence, demand.best_matches(evidence, assets), asked, F.col("project_id") != 2)
    run = covered.withColumns({"freshness": expr.freshness("last_observed", F.timestamp_seconds(F.lit(744 * 3600)), baseline="baseline_only"), "commercial": F.when(F.col("number") % 4 == 0, 0.5), "compliance_uncertainty": F.col("number") == 13})
    scored = demand.points_score(demand.with_vector(run)).withColumn("confidence", expr.half_up("confidence", 3))
    return demand.select_feed(scored).select("family_id", "project_id", "status", "priority", "confidence", "reason", "rank", "action")


@register("w10_freshness", "WITH a AS (SELECT o_orderkey, greatest(0.0, (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400.0::DOUBLE) AS age FROM orders) SELECT o_orderkey, CASE WHEN age <= 7 THEN 1.0 WHEN age >= 90 THEN 0.0 ELSE floor((90 - age) / 83 * 10000 + 0.5) / 10000 END::DOUBLE AS freshness FROM a")
def w10(v):
    return v.orders.select("o_orderkey", expr.freshness("o_orderdate", F.expr("TIMESTAMP '1998-01-01'")).alias("freshness"))


@register("w11_w12_dates_anchor", "SELECT family_id, min(published_hour) AS first_hour, max(published_hour) AS last_hour, arg_min(obs_id, (collected_hour, obs_id)) AS anchor FROM observations GROUP BY 1")
def w11(v):
    return v.observations.groupBy("family_id").agg(F.min("published_hour").alias("first_hour"), F.max("published_hour").alias("last_hour"), F.min_by("obs_id", F.struct("collected_hour", "obs_id")).alias("anchor"))


@register("w15_retention", "SELECT obs_id, (collected_hour + 24 * CASE source_class WHEN 'primary_authoritative' THEN 365 WHEN 'first_party_observed' THEN 365 WHEN 'search_observed' THEN 90 ELSE 30 END)::BIGINT AS raw_hour, (collected_hour + 24 * CASE source_class WHEN 'primary_authoritative' THEN 730 WHEN 'first_party_observed' THEN 730 WHEN 'search_observed' THEN 180 ELSE 90 END)::BIGINT AS excerpt_hour, (collected_hour + 720)::BIGINT AS fixed_hour FROM observations")
def w15(v):
    rows = demand.fixed_expiry(demand.retention(_obs(v)))
    hours = lambda c, n: F.floor(F.unix_seconds(c) / 3600).cast("long").alias(n)
    return rows.select("obs_id", hours("raw_expiry", "raw_hour"), hours("excerpt_expiry", "excerpt_hour"), hours("expiry", "fixed_hour"))


@register("e10_digest_ids", "SELECT obs_id, 'obs_' || sha256('3:obs|11:evidence-v1|' || length(platform) || ':' || platform || '|' || length(connection_id) || ':' || connection_id || '|' || length(external_id) || ':' || external_id || '|' || length(canonical_url) || ':' || canonical_url) AS id FROM observations")
def e10(v):
    return v.observations.select("obs_id", demand.observation_id().alias("id"))


@register("e8_jaccard", f"WITH {TOKENS} SELECT x.obs_id, floor(len(list_intersect(x.tk, y.tk))::DOUBLE / (len(x.tk) + len(y.tk) - len(list_intersect(x.tk, y.tk))) * 10000 + 0.5) / 10000 AS similarity FROM o x, (SELECT * FROM o WHERE obs_id = 'o2') y WHERE len(x.tk) > 0")
def e8(v):
    obs = _obs(v)
    one = obs.where("obs_id = 'o2'").select(F.col("tokens").alias("other"))
    return obs.where(F.size("tokens") > 0).join(F.broadcast(one)).select("obs_id", expr.half_up(text.jaccard(F.col("tokens"), F.col("other")), 4).alias("similarity"))


@register("e6_text_normal_form", "SELECT obs_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS normal FROM observations")
def e6(v):
    return v.observations.select("obs_id", text.normal_text(F.col("title")).alias("normal"))


E7_SQL = r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> '' AND NOT regexp_matches(lower(s), '^(fbclid|gclid|mc_cid|mc_eid|ref|ref_src|source|utm_campaign|utm_content|utm_medium|utm_source|utm_term)(=|$)'))) AS params FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM u"""
E11_SQL = r"""WITH n AS (SELECT obs_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), 'https?://\S+', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM observations),
p AS (SELECT obs_id, list_transform(list_filter(string_split(normal, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT)) AS points FROM n),
u AS (SELECT obs_id, flatten(list_transform(points, lambda x: CASE WHEN x > 65535 THEN [55296 + (x - 65536) // 1024, 56320 + (x - 65536) % 1024] ELSE [x] END)) AS units FROM p)
SELECT obs_id, lpad(lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), units), lambda h, x: xor(h, x) * 16777619 % 4294967296))), 8, '0') AS fingerprint FROM u"""


@register("e7_canonical_url", E7_SQL)
def e7(v):
    from sightline.functions.urls import canonical_url

    return v.pages.select("page_id", canonical_url("url").alias("url"))


@register("e11_fnv_fingerprint", E11_SQL)
def e11(v):
    return v.observations.select("obs_id", text.fnv1a(text.normal_text(F.col("title"), compatible=False)).alias("fingerprint"))


@register("e13_j18_family_keys", "SELECT obs_id, CASE WHEN contains(title, 'the') AND contains(title, 'and') THEN 'both' WHEN contains(title, 'the') THEN 'the' ELSE 'auto:' || substr(title, 1, 120) END AS family_key FROM observations")
def e13(v):
    return demand.first_family(v.observations, [("both", ["the", "and"]), ("the", ["the"])]).select("obs_id", "family_key")


# Each title against the first one of its family and platform.
@register("e8_family_jaccard", f"""WITH {TOKENS}, h AS (SELECT family_id, platform, arg_min(tk, CAST(substr(obs_id, 2) AS BIGINT)) AS tp FROM o GROUP BY 1, 2), p AS (SELECT obs_id, tk, tp FROM o JOIN h ON o.family_id = h.family_id AND o.platform = h.platform)
SELECT obs_id, CASE WHEN len(tk) = 0 AND len(tp) = 0 THEN 1.0 WHEN len(tk) = 0 OR len(tp) = 0 THEN 0.0 ELSE len(list_intersect(tk, tp))::DOUBLE / (len(tk) + len(tp) - len(list_intersect(tk, tp))) END::DOUBLE AS similarity FROM p""", rounded=("similarity",))
def e8_family(v):
    obs, key = _obs(v), ["family_id", "platform"]
    first = obs.groupBy(*key).agg(F.min_by("tokens", F.expr("CAST(substr(obs_id, 2) AS BIGINT)")).alias("first"))
    return obs.join(first, key).select("obs_id", text.jaccard(F.col("tokens"), F.col("first")).alias("similarity"))


# Definitions as a table: the two first words of every fifth title; the first one whose words a title contains.
@register("j18_many_definitions", f"""WITH {TOKENS}, d AS (SELECT CAST(substr(obs_id, 2) AS BIGINT) AS rank, obs_id AS name, list_filter(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 1)[1:2] AS words FROM o WHERE CAST(substr(obs_id, 2) AS BIGINT) % 5 = 1 AND len(tk) > 0)
SELECT obs_id, name AS family FROM (SELECT o.obs_id, arg_min(d.name, d.rank) FILTER (WHERE len(list_filter(d.words, lambda w: NOT contains(o.title, w))) = 0) AS name FROM o LEFT JOIN d ON contains(o.title, d.words[1]) GROUP BY o.obs_id)""")
def j18_many(v):
    rank = F.expr("CAST(substr(obs_id, 2) AS BIGINT)")
    listed = _obs(v).where((rank % 5 == 1) & (F.size("tokens") > 0)).select(rank.alias("rank"), F.col("obs_id").alias("name"), F.slice(F.filter(F.split(text.normal_text(F.col("title"), compatible=False), " "), lambda t: F.length(t) > 1), 1, 2).alias("words"))
    return definitions.first_match(v.observations.select("obs_id", "title"), listed, found="family").select("obs_id", "family")


@register("e18_page_changes", "SELECT event_id, CASE WHEN p IS NULL THEN 'baseline' WHEN p <> event_type THEN 'changed' ELSE 'same' END AS state FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def e18(v):
    rows = v.events.selectExpr("event_id AS id", "user_id AS page", "ts AS seen", "event_type AS fingerprint")
    return demand.page_changes(rows).select(F.col("id").alias("event_id"), "state")


@register("f23_source_gate", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'unapproved' WHEN c_acctbal < 0 THEN 'disabled' WHEN c_mktsegment = 'BUILDING' THEN 'policy_blocked' END AS rule FROM customer")
def f23(v):
    rows = v.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'approved' END AS approval", "c_acctbal >= 0 AS enabled", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'denied' ELSE 'allowed' END AS policy")
    return demand.source_gate(rows).select("c_custkey", "rule")


HEALTH = "CASE c_custkey % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'blocked' ELSE 'healthy' END"


@register("a17_source_health", f"SELECT count(*) AS runs, count(*) FILTER (WHERE h = 'healthy') AS healthy, count(*) FILTER (WHERE h = 'failed') AS failed, count(*) FILTER (WHERE h = 'blocked') AS blocked, 0::BIGINT AS unknown, 0::BIGINT AS skipped, count(*) FILTER (WHERE h = 'healthy') >= ceil(count(*) * 2 / 3.0) AS floor_met FROM (SELECT {HEALTH} AS h FROM customer)")
def a17(v):
    return demand.source_health(v.customer.select(F.expr(HEALTH).alias("health")))


@register("k7_latest_feed", "SELECT o_orderkey AS item, o_custkey AS rank FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def k7(v):
    items = v.orders.selectExpr("o_orderdate AS run_id", "o_orderkey AS item", "o_custkey AS rank")
    runs = v.orders.selectExpr("o_orderdate AS run_id", "o_orderdate AS run_date", "o_orderdate AS started_at").distinct()
    return demand.latest_feed(items, runs).select("item", "rank")


@register("j5_j6_scoped_joins", "SELECT s.snapshot_id, c.domain, p.name FROM rank_snapshots s JOIN rank_runs r USING (run_id) JOIN rank_configs c ON c.config_id = r.config_id JOIN projects p USING (project_id) WHERE p.organization_id = 1")
def j5(v):
    runs = v.rank_runs.select("run_id", F.col("config_id").alias("c"))
    configs = v.rank_configs.select(F.col("config_id").alias("c"), "domain", "project_id")
    return v.rank_snapshots.join(runs, "run_id").join(configs, "c").join(v.projects.where("organization_id = 1"), "project_id").select("snapshot_id", "domain", "name")


@register("j15_resolved_evidence", "SELECT l_orderkey, l_linenumber, l_partkey, (o.o_orderkey IS NULL OR p.p_partkey IS NULL) AS missing FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 9 <> 0) o ON l.l_orderkey = o.o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 11 <> 0) p ON l.l_partkey = p.p_partkey")
def j15(v):
    links = v.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey AS event_id", "l_partkey AS obs_id")
    out = demand.resolved_evidence(links, v.orders.where("o_orderkey % 9 <> 0").selectExpr("o_orderkey AS event_id"), v.part.where("p_partkey % 11 <> 0").selectExpr("p_partkey AS obs_id"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "missing")


@register("j16_feed_details", "SELECT o_orderkey, o_custkey, count(l_partkey) AS parts, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') AS part_list FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def j16(v):
    children = v.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    rows = v.orders.join(children, "o_orderkey", "left")
    return rows.select("o_orderkey", "o_custkey", F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("parts"), F.coalesce(F.array_join(F.col("parts").cast("array<string>"), ","), F.lit("")).alias("part_list"))


@register("s7_claim_once", "SELECT min(o_orderkey) AS claim_id, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE (o_custkey, CAST(o_orderdate AS DATE)) NOT IN (SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 4 = 0) AND o_orderkey % 4 <> 0 GROUP BY 2, 3")
def s7(v):
    rows = v.orders.select(F.col("o_orderkey").alias("claim_id"), "o_custkey", F.to_date("o_orderdate").alias("day"))
    return tables.claim_once(rows.where("claim_id % 4 = 0"), rows.where("claim_id % 4 <> 0"), ["o_custkey", "day"])


@register("s8_versioned_update", "SELECT o_orderkey, CASE WHEN o_custkey = 7 AND o_orderkey % 3 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 3 + CASE WHEN o_custkey = 7 AND o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS version FROM orders")
def s8(v):
    rows = v.orders.withColumn("version", F.col("o_orderkey") % 3)
    return tables.versioned_update(rows, F.col("o_custkey") == 7, 1, {"o_orderstatus": F.lit("X")}).select("o_orderkey", "o_orderstatus", "version")


def _stored(v, schema, key, buckets=8):
    spark = v.orders.sparkSession
    return CommitTable(spark, f"{shared_folder(spark)}/commits-{uuid.uuid4().hex}", schema, key, buckets)


# Orders stored in batches of which the second overlaps the first and the third is the second again: known keys are left out, each commit adds the rest.
@register("s4_stored_append", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 2 END AS batch FROM orders")
def s4_stored(v):
    table = _stored(v, "o_orderkey long, o_orderstatus string, batch long", ["o_orderkey"])
    for batch, rests in ((1, (0, 1)), (2, (1, 2)), (3, (1, 2))):
        rows = v.orders.where((F.col("o_orderkey") % 3).isin(*rests)).select("o_orderkey", "o_orderstatus", F.lit(batch).cast("long").alias("batch"))
        table.transact(lambda stored, rows=rows: rows.join(stored.select("o_orderkey"), "o_orderkey", "left_anti"))
    return table.read()


# Two workers claim runs on one snapshot: the second is told, decides on the new snapshot and gets what is left.
@register("s7_stored_claims", """WITH stored AS (SELECT run_id, status FROM rank_runs WHERE month_no % 4 <> 1),
a AS (SELECT r.run_id, CASE WHEN s.run_id IS NULL THEN 'start' WHEN s.status = 'completed' THEN 'skip' ELSE 'resume' END AS action FROM rank_runs r LEFT JOIN stored s ON r.run_id = s.run_id WHERE month_no % 2 = 0 OR month_no % 5 = 0),
b AS (SELECT r.run_id, CASE WHEN a.action <> 'skip' THEN 'skip' WHEN s.run_id IS NULL THEN 'start' WHEN s.status = 'completed' THEN 'skip' ELSE 'resume' END AS action FROM rank_runs r LEFT JOIN stored s ON r.run_id = s.run_id LEFT JOIN a ON a.run_id = r.run_id WHERE month_no % 3 = 0 OR month_no % 7 = 0)
SELECT run_id, 'a' AS worker, action FROM a UNION ALL SELECT run_id, 'b', action FROM b""")
def s7_stored(v):
    runs = v.rank_runs.select(F.col("run_id").cast("long").alias("run_id"), "month_no", "status")
    table = _stored(v, "run_id long, status string, worker string", ["run_id"])
    table.upsert(runs.where("month_no % 4 <> 1").select("run_id", "status", F.lit("old").alias("worker")))
    seen = table.version()
    by = lambda worker, where: claim(table, runs.where(where).select("run_id", F.lit(worker).alias("worker")), version=seen)
    first, second = by("a", "month_no % 2 = 0 OR month_no % 5 = 0"), by("b", "month_no % 3 = 0 OR month_no % 7 = 0")
    return first.unionByName(second).select("run_id", "worker", "action")


# Two writers change rows of one snapshot if their version is 1: the second finds versions raised by the first.
@register("s8_stored_versions", """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderkey % 3 AS version, o_custkey % 5 = 0 AS x, o_custkey % 2 = 0 AS y FROM orders), d AS (SELECT *, x AND version = 1 AS a, y AND version = 1 AND NOT x AS b FROM o)
SELECT o_orderkey, CASE WHEN a THEN 'X' WHEN b THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, version + CASE WHEN a OR b THEN 1 ELSE 0 END AS version, CASE WHEN x THEN a END AS first_applied, CASE WHEN y THEN b END AS second_applied FROM d""")
def s8_stored(v):
    table = _stored(v, "o_orderkey long, o_orderstatus string, version long", ["o_orderkey"])
    table.upsert(v.orders.select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 3).alias("version")))
    seen = table.version()
    change = lambda where, status: versioned_updates(table, v.orders.where(where).select("o_orderkey", F.lit(status).alias("o_orderstatus"), F.lit(1).cast("long").alias("expected")), seen)
    told = [change(where, status).select("o_orderkey", F.col("applied").alias(name)) for where, status, name in (("o_custkey % 5 = 0", "X", "first_applied"), ("o_custkey % 2 = 0", "Y", "second_applied"))]
    return table.read().join(told[0], "o_orderkey", "left").join(told[1], "o_orderkey", "left")


# Daily runs claimed twice: completed ones are skipped, failed ones and those left running too long are resumed.
@register("t4_daily_runs", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS n FROM events)
SELECT day, CASE WHEN n % 4 = 3 THEN 'start' WHEN n % 4 = 0 OR (n % 4 = 2 AND n % 3 <> 0) THEN 'skip' ELSE 'resume' END AS action, CASE WHEN n % 4 = 0 THEN 'completed' ELSE 'running' END AS status FROM d""")
def t4_daily(v):
    days = v.events.select(F.to_date("ts").alias("day")).distinct().withColumn("n", F.datediff("day", F.lit("2024-01-01").cast("date")))
    table = _stored(v, "day date, status string, claimed_hour long", ["day"])
    hour = F.when(F.col("n") % 3 == 0, 0).otherwise(20).cast("long").alias("claimed_hour")
    claim(table, days.where("n % 4 <> 3").select("day", hour))
    ends = days.where("n % 4 < 2").select("day", F.when(F.col("n") % 4 == 0, "completed").otherwise("failed").alias("status"), hour)
    table.upsert(ends)
    again = claim(table, days.select("day", F.lit(24).cast("long").alias("claimed_hour")), stale=F.col("claimed_hour") < 24 - 12)
    return again.select("day", "action").join(table.read().select("day", "status"), "day")


@register("s13_k18_observation_union", "SELECT 'search' AS source, concat(query, page) AS external_id, sum(impressions)::DOUBLE AS weight FROM search_rows GROUP BY query, page UNION ALL SELECT 'community', CAST(conv_id AS VARCHAR), count(*)::DOUBLE FROM conversations GROUP BY conv_id")
def s13(v):
    found = v.search_rows.groupBy("query", "page").agg(F.sum("impressions").alias("n")).select(F.lit("search").alias("source"), F.concat("query", "page").alias("external_id"), F.col("n").cast("double").alias("weight"))
    talk = v.conversations.groupBy("conv_id").count().select(F.lit("community").alias("source"), F.col("conv_id").cast("string").alias("external_id"), F.col("count").cast("double").alias("weight"))
    return found.unionByName(talk)


@register("d4_promotion_gate", f"WITH RECURSIVE {FAMILY} SELECT family_id, promotable AND events >= 2 AND (has_first_party::INT + has_primary::INT + has_search::INT) >= 2 AS promoted FROM fam")
def d4(v):
    rows = demand.family_evidence(_events(v))
    classes = sum((F.col(c).cast("int") for c in ("has_first_party", "has_primary", "has_search")), F.lit(0))
    return rows.select("family_id", (F.col("promotable") & (F.col("events") >= 2) & (classes >= 2)).alias("promoted"))
