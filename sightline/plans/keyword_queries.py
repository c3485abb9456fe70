"""Registered keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import expr
from sightline.operators import keywords as kw
from sightline.plans.registry import register
from sightline.sources import tables

JOINED = "joined AS (SELECT s.*, m.search_volume, m.cpc, m.difficulty, m.intent FROM saved_keywords s LEFT JOIN keyword_metrics m USING (project_id, keyword, location_code))"
FIELDS = {"keyword": "keyword", "volume": "search_volume", "cpc": "cpc", "difficulty": "difficulty"}


def _joined(v):
    return kw.with_metrics(v.saved_keywords, v.keyword_metrics)


@register("j2_saved_with_metrics", f"WITH {JOINED} SELECT id, keyword, search_volume, cpc, difficulty, intent FROM joined")
def j2(v):
    return _joined(v).select("id", "keyword", "search_volume", "cpc", "difficulty", "intent")


@register("f4_saved_filter", f"WITH {JOINED} SELECT id FROM joined WHERE contains(keyword, 'small') AND contains(keyword, '1') AND NOT contains(keyword, '9') AND search_volume >= 100 AND difficulty <= 40 AND EXISTS (SELECT 1 FROM tag_assignments a WHERE a.keyword_id = id AND a.tag_id IN ('Brand#11', 'Brand#23', 'Brand#31'))")
def f4(v):
    rows = _joined(v).where(kw.saved_predicate(include="small+1", exclude="9", volume=(100, None), difficulty=(None, 40)))
    return kw.having_tags(rows, v.tag_assignments, ["Brand#11", "Brand#23", "Brand#31"]).select("id")


@register("j9_tag_exists", "SELECT id FROM saved_keywords k WHERE EXISTS (SELECT 1 FROM tag_assignments a WHERE a.keyword_id = k.id AND a.tag_id = 'Brand#22')")
def j9(v):
    return kw.having_tags(v.saved_keywords, v.tag_assignments, ["Brand#22"]).select("id")


@register("f5_research_filter_sort", f"WITH {JOINED} SELECT id, coalesce(search_volume, -1) AS sort_volume FROM joined WHERE contains(lower(keyword), 'a') AND intent IN ('transactional', 'commercial') AND coalesce(search_volume, 0) BETWEEN 0 AND 700 AND coalesce(difficulty, 0) >= 5")
def f5(v):
    rows = kw.research_filter(_joined(v), include="a", intents=["transactional", "commercial"], volume=(0, 700), difficulty=(5, None))
    return kw.sorted_by(rows, FIELDS, "volume", True, "id", null_value=-1).select("id", F.coalesce("search_volume", F.lit(-1)).alias("sort_volume"))


@register("k1_k2_sorted_page", f"WITH {JOINED} SELECT id, search_volume FROM joined ORDER BY search_volume DESC NULLS LAST, id LIMIT 25 OFFSET 50")
def k1(v):
    return kw.page_of(kw.sorted_by(_joined(v), FIELDS, "volume", True, "id"), 3, 25).select("id", "search_volume")


@register("k1_ascending_nulls_first", f"WITH {JOINED} SELECT id, cpc FROM joined ORDER BY cpc ASC NULLS FIRST, id")
def k1b(v):
    return kw.sorted_by(_joined(v), FIELDS, "cpc", False, "id").select("id", "cpc")


@register("k3_has_more", "SELECT n AS total, 3 * 25 < n AS has_more FROM (SELECT count(*) AS n FROM saved_keywords)")
def k3(v):
    return v.saved_keywords.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.lit(3 * 25) < F.col("total"))


@register("k4_probe_page", "SELECT id, row_number() OVER (ORDER BY id) > 10 AS is_probe FROM (SELECT id FROM saved_keywords ORDER BY id LIMIT 11 OFFSET 20)")
def k4(v):
    return kw.probe_page(v.saved_keywords.select("id").orderBy("id"), 3, 10)


@register("j3_tag_usage", "SELECT t.tag_id, t.name, count(a.keyword_id) AS uses FROM tags t LEFT JOIN tag_assignments a USING (tag_id) GROUP BY t.tag_id, t.name")
def j3(v):
    return kw.tag_usage(v.tags, v.tag_assignments)


@register("j4_tag_lists", "SELECT keyword_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM tag_assignments JOIN tags USING (tag_id) GROUP BY keyword_id")
def j4(v):
    return kw.tag_lists(v.tags, v.tag_assignments).select("keyword_id", F.array_join("names", ",").alias("names"))


@register("k17_tags_to_remove", "SELECT keyword_id, tag_id FROM tag_assignments WHERE keyword_id IN (1, 11, 21, 31, 41) AND tag_id NOT IN ('Brand#11')")
def k17(v):
    return kw.tags_to_remove(v.tag_assignments, [1, 11, 21, 31, 41], ["Brand#11"])


@register("s9_removable_tags", "SELECT tag_id FROM tags WHERE tag_id IN ('unused', 'Brand#12') AND NOT EXISTS (SELECT 1 FROM tag_assignments a WHERE a.tag_id = tags.tag_id)")
def s9(v):
    return kw.removable_tags(v.tags, v.tag_assignments, ["unused", "Brand#12"]).select("tag_id")


@register("s9_delete_by_keys", "SELECT id FROM saved_keywords WHERE id % 50 <> 7")
def s9_delete(v):
    return tables.delete_keys(v.saved_keywords, v.saved_keywords.where("id % 50 = 7").select("id"), ["id"]).select("id")


@register("k16_first_occurrence", "SELECT name, id FROM (SELECT lower(p_name) AS name, p_partkey AS id FROM part) QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1")
def k16(v):
    return kw.first_of(v.part.select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("id")), "name", "id")


SOURCES = "SELECT p_size % 3 AS source_no, p_partkey AS ordinal, lower(p_name) AS keyword FROM part WHERE (p_size % 3 = 0 AND p_partkey < 12) OR (p_size % 3 = 1 AND p_partkey < 400) OR p_size % 3 = 2"


@register("k15_accumulate_sources", f"""WITH f AS (SELECT * FROM ({SOURCES}) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY source_no, ordinal) = 1),
c AS (SELECT source_no, count(*) FILTER (WHERE keyword <> 'small brass') AS n FROM f GROUP BY source_no),
u AS (SELECT source_no FROM (SELECT source_no, coalesce(sum(n) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) WHERE b < 12)
SELECT source_no, ordinal, keyword FROM f WHERE source_no IN (SELECT source_no FROM u) ORDER BY source_no, ordinal LIMIT 40""")
def k15(v):
    rows = v.part.where("(p_size % 3 = 0 AND p_partkey < 12) OR (p_size % 3 = 1 AND p_partkey < 400) OR p_size % 3 = 2")
    rows = rows.select((F.col("p_size") % 3).alias("source_no"), F.col("p_partkey").alias("ordinal"), F.lower("p_name").alias("keyword"))
    return kw.accumulate_sources(rows, "small brass", 12, 40).select("source_no", "ordinal", "keyword")


@register("s11_payload_mapper", """WITH x AS (SELECT p_partkey AS ordinal, lower(trim(p_name)) AS keyword, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size * 2 END AS search_volume, p_size / 100.0::DOUBLE AS competition,
 CASE WHEN p_type LIKE '%BRASS%' THEN 'informational' WHEN p_type LIKE '%STEEL%' THEN 'navigational' ELSE 'unknown' END AS intent FROM part)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY ordinal) = 1""")
def s11(v):
    volume = lambda x: F.struct(x.alias("search_volume"), F.lit(None).cast("double").alias("cpc"))
    label = F.when(F.col("p_type").contains("BRASS"), "Informational").when(F.col("p_type").contains("STEEL"), "NAVIGATION")
    info = F.struct((F.col("p_size") * 2).alias("search_volume"), F.col("p_retailprice").alias("cpc"), F.col("p_size").alias("competition_index"), label.alias("intent"))
    items = v.part.select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit(" "), F.upper("p_name")).alias("keyword"), F.when(F.col("p_partkey") % 3 == 0, volume(F.col("p_size"))).alias("clickstream"), info.alias("info"))
    return kw.payload_rows(items).select("ordinal", "keyword", "search_volume", "competition", "intent")


LOCAL = "(SELECT upper(keyword) AS keyword, search_volume * 2 AS search_volume, cpc FROM keyword_metrics WHERE search_volume % 2 = 0 UNION ALL SELECT 'ONLY LOCAL', 1, 2.0)"


@register("s12_local_national_merge", f"""WITH n AS (SELECT * FROM keyword_metrics WHERE difficulty > 5), l AS (SELECT * FROM {LOCAL})
SELECT n.keyword, l.search_volume, l.cpc, n.difficulty, n.intent FROM n LEFT JOIN l ON lower(n.keyword) = lower(l.keyword)
UNION ALL SELECT l.keyword, l.search_volume, l.cpc, NULL, NULL FROM l WHERE lower(l.keyword) NOT IN (SELECT lower(keyword) FROM n)""")
def s12(v):
    local = v.keyword_metrics.where("search_volume % 2 = 0").select(F.upper("keyword").alias("keyword"), (F.col("search_volume") * 2).alias("search_volume"), "cpc")
    local = local.unionByName(local.sparkSession.createDataFrame([("ONLY LOCAL", 1, 2.0)], "keyword string, search_volume long, cpc double"))
    return kw.merge_local(v.keyword_metrics.where("difficulty > 5"), local)


@register("j26_metrics_refresh", "SELECT s.id, s.keyword, s.location_code, m.search_volume, m.cpc, m.difficulty FROM saved_keywords s JOIN keyword_metrics m ON s.location_code = m.location_code AND lower(s.keyword) = lower(m.keyword)")
def j26(v):
    return kw.refreshed(v.saved_keywords, v.keyword_metrics.withColumn("keyword", F.upper("keyword")))


@register("s5_upsert", "SELECT id, CASE WHEN id % 10 = 0 THEN 'new' ELSE tag END AS tag FROM saved_keywords UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey BETWEEN 1 AND 5")
def s5(v):
    old = v.saved_keywords.select("id", "tag")
    new = old.where("id % 10 = 0").select("id", F.lit("new").alias("tag")).unionByName(v.part.where("p_partkey BETWEEN 1 AND 5").select((-F.col("p_partkey")).alias("id"), F.lit("new").alias("tag")))
    return tables.upsert(old, new, ["id"])


@register("s6_insert_or_ignore", "SELECT id, tag FROM saved_keywords UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey BETWEEN 1 AND 5")
def s6(v):
    old = v.saved_keywords.select("id", "tag")
    new = old.where("id % 10 = 0").select("id", F.lit("new").alias("tag")).unionByName(v.part.where("p_partkey BETWEEN 1 AND 5").select((-F.col("p_partkey")).alias("id"), F.lit("new").alias("tag")))
    return tables.insert_or_ignore(old, new, ["id"])


@register("s1_scan_projection", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand <> 'Brand#13'")
def s1(v):
    return v.part.where("p_size BETWEEN 10 AND 20 AND p_brand <> 'Brand#13'").select("p_partkey", "p_name")


@register("s2_point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 42 LIMIT 1")
def s2(v):
    return v.part.where("p_partkey = 42").select("p_partkey", "p_name").limit(1)


@register("s3_key_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def s3(v):
    return tables.rows_with_keys(v.lineitem, v.part.where("p_size = 7").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]).select("l_orderkey", "l_linenumber")


@register("f1_f2_optional_predicates", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 30 AND p_brand IN ('Brand#12', 'Brand#34') AND p_type NOT IN ('x') AND p_name IS NOT NULL")
def f1(v):
    maximum = None
    tests = [F.col("p_size") >= 10, F.col("p_size") < 30, None if maximum is None else F.col("p_size") <= maximum, F.col("p_brand").isin("Brand#12", "Brand#34"), ~F.col("p_type").isin("x"), F.col("p_name").isNotNull()]
    return v.part.where(expr.all_of(*tests)).select("p_partkey")


@register("f15_domain_keyword_filter", f"WITH {JOINED} SELECT id FROM joined WHERE contains(keyword, 'a') AND contains(keyword, 'e') AND NOT contains(keyword, 'x') AND search_volume >= 50 AND cpc <= 15 AND (contains(keyword, '12') OR contains(lower(tag), '12'))")
def f15(v):
    return _joined(v).where(kw.api_conditions("a, e", "x", {"search_volume": (50, None), "cpc": (None, 15)}, "12", url="tag")).select("id")


@register("f16_domain_page_filter", "SELECT id FROM audit_pages WHERE (contains(lower(url), 'p1') OR contains(lower(url), 'p2')) AND word_count BETWEEN 100 AND 300")
def f16(v):
    return v.audit_pages.where(kw.api_conditions("p1, p2", "", {"word_count": (100, 300)}, field="url", mode="any")).select("id")


@register("f19_ranked_keyword_filter", f"WITH {JOINED} SELECT id FROM joined WHERE search_volume >= 200 AND difficulty <= 30 AND keyword NOT ILIKE '%br_ss%'")
def f19(v):
    return _joined(v).where(expr.all_of(expr.range_filter("search_volume", 200), expr.range_filter("difficulty", None, 30), ~F.col("keyword").ilike("%br_ss%"))).select("id")


@register("k5_k14_metric_sort", f"WITH {JOINED} SELECT id, coalesce(difficulty, 0) AS d FROM joined ORDER BY coalesce(difficulty, 0), id")
def k14(v):
    return kw.sorted_by(_joined(v), FIELDS, "difficulty", False, "id", null_value=0).select("id", F.coalesce("difficulty", F.lit(0)).alias("d"))


@register("k22_trend_points", "SELECT p_partkey, sum(m)::BIGINT AS months, max(ym)::BIGINT AS last_at FROM (SELECT p_partkey, 1 AS m, (2020 + i // 12) * 100 + i % 12 + 1 AS ym, row_number() OVER (PARTITION BY p_partkey ORDER BY (2020 + i // 12) * 100 + i % 12 + 1 DESC) AS k FROM part CROSS JOIN range(0, 20) t(i) WHERE i < 1 + p_partkey % 20) WHERE k <= 12 GROUP BY p_partkey")
def k22(v):
    points = F.transform(F.expr("sequence(CAST(p_partkey % 20 AS INT), 0, -1)"), lambda i: F.struct((F.lit(2020) + F.floor(i / 12).cast("int")).alias("year"), (i % 12 + 1).alias("month"), i.alias("volume")))
    rows = kw.trend_points(v.part.select("p_partkey", points.alias("trend")))
    return rows.select("p_partkey", F.size("trend").cast("long").alias("months"), F.element_at("trend", -1)["at"].cast("long").alias("last_at"))


@register("h1_keyword_text", "SELECT p_partkey, lower(trim(p_name)) AS normal, substr(p_name, 1, 5) AS short FROM part")
def h1(v):
    return v.part.select("p_partkey", expr.normal_keyword("p_name").alias("normal"), expr.truncated("p_name", 5).alias("short"))


@register("h2_intent", "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'informational' WHEN p_type LIKE '%TIN%' THEN 'transactional' ELSE 'unknown' END AS intent FROM part")
def h2(v):
    label = F.when(F.col("p_type").contains("BRASS"), "INFORMational x").when(F.col("p_type").contains("TIN"), "transaction")
    return v.part.select("p_partkey", expr.intent(label).alias("intent"))


@register("h3_short_ids", "SELECT p_partkey, substr(sha256(concat_ws('|', p_name, CAST(p_size AS VARCHAR))), 1, 36) AS id FROM part")
def h3(v):
    return v.part.select("p_partkey", expr.short_id("p_name", "p_size").alias("id"))


@register("h6_math", "SELECT p_partkey, floor(p_retailprice * 10::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE AS rounded, CASE WHEN p_size < 20 THEN 0 WHEN p_size < 35 THEN 1 WHEN p_size < 50 THEN 2 WHEN p_size < 65 THEN 3 WHEN p_size < 80 THEN 4 ELSE 5 END AS tier, least(1.0, greatest(0.0, (p_size - 20) / 20.0::DOUBLE)) AS clamped FROM part")
def h6(v):
    return v.part.select("p_partkey", expr.half_up("p_retailprice", 1).alias("rounded"), expr.difficulty_tier("p_size").alias("tier"), expr.clamp01((F.col("p_size") - 20) / F.lit(20.0)).alias("clamped"))


@register("h12_market_lookup", "SELECT c.config_id, coalesce(n.n_name, 'unknown') AS location, CASE WHEN n.n_regionkey = 3 THEN 'en' ELSE 'local' END AS language FROM rank_configs c LEFT JOIN nation n ON c.location_code = n.n_nationkey AND n.n_nationkey < 20")
def h12(v):
    places = v.nation.where("n_nationkey < 20")
    joined = v.rank_configs.join(F.broadcast(places), F.col("location_code") == F.col("n_nationkey"), "left")
    return joined.select("config_id", F.coalesce("n_name", F.lit("unknown")).alias("location"), F.when(F.col("n_regionkey") == 3, "en").otherwise("local").alias("language"))
