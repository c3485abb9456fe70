"""Registered maintenance, export and validation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import maintenance as m
from sightline.plans.registry import register
from sightline.sources import adapters, sinks
from sightline.sources.staging import shared_folder


@register("m1_duplicate_map", "SELECT o_orderkey, row_number() OVER w AS keep_rank, first_value(o_orderkey) OVER w AS canonical_id, count(*) OVER (PARTITION BY o_custkey) AS copies FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)")
def m1(v):
    rows = m.duplicate_map(v.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderkey")
    return rows.select("o_orderkey", "keep_rank", "canonical_id", "copies")


U = "u AS (SELECT c_custkey AS id, c_nationkey AS g, 0 AS canonical FROM customer UNION ALL SELECT s_suppkey + 1000000, s_nationkey, 1 FROM supplier)"


@register("m2_union_duplicate_map", f"WITH {U} SELECT id, row_number() OVER (PARTITION BY g ORDER BY canonical DESC, id) AS keep_rank FROM u")
def m2(v):
    rows = v.customer.selectExpr("c_custkey AS id", "c_nationkey AS g", "0 AS canonical").unionByName(v.supplier.selectExpr("s_suppkey + 1000000 AS id", "s_nationkey AS g", "1 AS canonical"))
    return m.duplicate_map(rows, ["g"], [F.desc("canonical"), F.asc("id")]).select("id", "keep_rank")


@register("m3_backfill", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'own' END, (SELECT o_orderpriority FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)) AS colour FROM customer")
def m3(v):
    donors = v.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("colour"), "o_orderdate", "o_orderkey")
    rows = v.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "own").alias("colour"))
    return m.backfilled_value(rows, donors, "c_custkey", "colour", F.struct("o_orderdate", "o_orderkey"))


MAPPING = "mp AS (SELECT c_custkey AS old, c_custkey - c_custkey % 10 AS new FROM customer WHERE c_custkey % 10 <> 0)"


def _mapping(v):
    return v.customer.where("c_custkey % 10 <> 0").selectExpr("c_custkey AS old", "c_custkey - c_custkey % 10 AS new")


@register("m5_repoint_keys", f"WITH {MAPPING} SELECT o_orderkey, coalesce(new, o_custkey) AS o_custkey FROM orders LEFT JOIN mp ON old = o_custkey")
def m5(v):
    return m.repointed(v.orders.select("o_orderkey", "o_custkey"), _mapping(v), "o_custkey")


@register("m4_collision_delete", f"WITH {MAPPING}, d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM mp JOIN d t ON t.o_custkey = mp.new AND t.o_orderpriority = d.o_orderpriority WHERE mp.old = d.o_custkey)")
def m4(v):
    return m.without_collisions(v.orders.select("o_custkey", "o_orderpriority").distinct(), _mapping(v), "o_custkey", ["o_orderpriority"])


@register("m6_keep_newest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def m6(v):
    return m.newest_by_key(v.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@register("m7_json_pick", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' WHEN 2 THEN NULL ELSE NULL END AS picked FROM orders")
def m7(v):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '[\"c\",\"b\"]' WHEN 1 THEN '[\"z\",\"a\",\"b\"]' WHEN 2 THEN '[]' ELSE 'not json' END")
    return m.json_pick(v.orders.select("o_orderkey", text.alias("j")), "j", ["a", "b", "c"]).select("o_orderkey", "picked")


@register("m9_incremental_extract", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000)")
def m9(v):
    _, children = m.incremental(v.orders, v.lineitem, "o_orderkey", "l_orderkey", F.expr("o_orderdate >= TIMESTAMP '1997-01-01'"), 500, 1000)
    return children.select("l_orderkey", "l_linenumber", "l_partkey")


@register("m10_row_conversion", "SELECT o_orderkey, o_orderkey % 2 = 1 AS flag, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * o_orderkey AS at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-02 03:04:05' END AS spaced FROM orders")
def m10(v):
    rows = v.orders.select("o_orderkey", (F.col("o_orderkey") % 2).alias("flag"), (F.col("o_orderkey") * 1000).alias("at"), F.when(F.col("o_orderkey") % 3 == 0, "bad date").otherwise("2024-01-02 03:04:05").alias("spaced"))
    out = m.converted(rows, ["flag"], ["at"], ["spaced"])
    return out.select("o_orderkey", "flag", F.col("at").cast("timestamp_ntz").alias("at"), F.col("spaced").cast("timestamp_ntz").alias("spaced"))


@register("m11_first_occurrence", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.t, b.t) AS t FROM (SELECT o_custkey AS k, min(o_orderdate) AS t FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, min(o_orderdate) AS t FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k")
def m11(v):
    from sightline.sources.tables import backfilled

    first = lambda r: v.orders.where(f"o_orderkey % 2 = {r}").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("t"))
    return backfilled(first(0), first(1), "k", "t")


@register("a28_repeated_keys", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def a28(v):
    return m.repeated_keys(v.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


@register("j25_orphan_rows", "SELECT count(*) AS n FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON l_partkey = p_partkey WHERE p_partkey IS NULL")
def j25(v):
    return m.orphan_rows(v.lineitem, v.part.where("p_size > 5"), "l_partkey", "p_partkey").agg(F.count(F.lit(1)).alias("n"))


@register("s4_idempotent_append", "SELECT o_orderkey, o_custkey FROM orders")
def s4(v):
    from sightline.sources.tables import insert_or_ignore

    rows = v.orders.select("o_orderkey", "o_custkey")
    return insert_or_ignore(rows, rows.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@register("quality_assertions", "SELECT 'one_snapshot_per_cell' AS rule, (SELECT count(*) FROM (SELECT 1 FROM rank_snapshots GROUP BY run_id, keyword_id, device HAVING count(*) > 1)) AS broken UNION ALL SELECT 'position_positive', (SELECT count(*) FROM rank_snapshots WHERE NOT position >= 1) UNION ALL SELECT 'known_device', (SELECT count(*) FROM rank_snapshots WHERE NOT device IN ('desktop', 'mobile'))")
def assertions(v):
    cells = v.rank_snapshots.groupBy("run_id", "keyword_id", "device").agg(F.count(F.lit(1)).alias("n"))
    unique = m.violations(cells, {"one_snapshot_per_cell": F.col("n") <= 1})
    return unique.unionByName(m.violations(v.rank_snapshots, {"position_positive": F.col("position") >= 1, "known_device": F.col("device").isin("desktop", "mobile")}))


@register("s15_csv_cells", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name ELSE c_name END AS c_name FROM customer")
def s15(v):
    rows = v.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("c_name"))
    return sinks.csv_cells(rows)


@register("s17_text_table", "SELECT concat_ws(' | ', CAST(p_partkey AS VARCHAR), coalesce(CASE WHEN p_size > 10 THEN p_name END, '—')) AS line FROM part")
def s17(v):
    return sinks.text_rows(v.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("p_name")))


@register("s10_provider_records", "SELECT p_name AS keyword, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size END, 0) AS search_volume, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 3 END, 9) AS position, concat('https://a.test/', CAST(p_partkey AS VARCHAR)) AS url FROM part")
def s10(v):
    info = F.struct(F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("search_volume"))
    ranked = F.struct(F.when(F.col("p_partkey") % 2 == 0, 3).alias("rank_group"), F.lit(9).alias("rank_absolute"), F.concat(F.lit("https://a.test/"), F.col("p_partkey").cast("string")).alias("url"))
    items = v.part.select(F.col("p_name").alias("keyword"), F.struct(F.lit(None).cast("string").alias("keyword"), info.alias("keyword_info")).alias("keyword_data"), ranked.alias("ranked"))
    return sinks.keyword_items(items)


def _exported(v, df, write, name):
    """The lines of an export's files."""
    spark = v.orders.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


PAGE_COLUMNS = ("id", "url", "audit_id", "fetch_class", "status_code", "redirect_url", "is_indexable", "h1_count", "word_count", "crawl_depth", "response_ms")


# Pages as JSON lines: every field is there, null ones too.
@register("s16_pages_json", f"SELECT to_json({{{', '.join(f'{c}: {c}' for c in PAGE_COLUMNS)}}})::VARCHAR AS line FROM audit_pages")
def s16_pages(v):
    return _exported(v, v.audit_pages.select(*PAGE_COLUMNS), sinks.write_json, "pages-json")


# Links by page and target as JSON lines, with their anchors as a list.
@register("s16_links_json", "SELECT to_json({source_page_id: source_page_id, target_url: target_url, anchors: anchors})::VARCHAR AS line FROM (SELECT source_page_id, target_url, list_sort(list(DISTINCT anchor)) AS anchors FROM audit_links GROUP BY 1, 2)")
def s16_links(v):
    rows = v.audit_links.groupBy("source_page_id", "target_url").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))
    return _exported(v, rows, sinks.write_json, "links-json")


def _quoted(*columns):
    return " || ',' || ".join(f"'\"' || coalesce(CAST({c} AS VARCHAR), '') || '\"'" for c in columns)


# Keywords and backlinks as CSV files with a head line; the head's lines are as many as the files, so they are left out.
@register("s16_keywords_csv", f"SELECT {_quoted('keyword_id', 'keyword', 'search_volume', 'difficulty')} AS line FROM rank_keywords")
def s16_keywords(v):
    lines = _exported(v, v.rank_keywords.select("keyword_id", "keyword", "search_volume", "difficulty"), sinks.write_csv, "keywords-csv")
    return lines.where(~F.col("line").startswith('"keyword_id"'))


@register("s16_backlinks_csv", f"SELECT {_quoted('id', 'url_from', 'url_to', 'rank', 'domain_rank', 'first_seen')} AS line FROM backlinks")
def s16_backlinks(v):
    lines = _exported(v, v.backlinks.select("id", "url_from", "url_to", "rank", "domain_rank", F.col("first_seen").cast("string").alias("first_seen")), sinks.write_csv, "backlinks-csv")
    return lines.where(~F.col("line").startswith('"id"'))


# Search rows and community items as JSON texts, some cut off, some of no story, some twice, to one schema.
@register("s13_source_adapters", """WITH h AS (SELECT event_id, event_id AS record_no, event_type, ts, value FROM events UNION ALL SELECT event_id, event_id + 1000000000, event_type, ts, value FROM events WHERE event_id % 7 = 0),
i AS (SELECT record_no, event_id, event_id % 17 = 0 AS bad, event_type <> 'error' AND event_id % 13 <> 0 AND event_id % 11 <> 0 AND CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 50 END >= 3 AS fit, CASE WHEN event_id % 11 <> 0 THEN 'title ' || event_id END AS title, ts, CASE WHEN event_id % 3 = 0 THEN 'https://out.test/' || event_id END AS outbound, CASE WHEN event_id % 5 <> 0 THEN event_id % 50 END AS score FROM h),
g AS (SELECT query, page, sum(impressions)::BIGINT AS views, row_number() OVER (ORDER BY query, page) AS record_no FROM search_rows GROUP BY query, page)
SELECT 'hacker_news' AS source, record_no, CASE WHEN bad THEN 'malformed' WHEN NOT fit THEN 'skipped' WHEN record_no > 1000000000 THEN 'repeated' ELSE 'observed' END AS status, CASE WHEN NOT bad THEN 'hn:' || event_id END AS external_id, CASE WHEN NOT bad THEN title END AS title,
 CASE WHEN NOT bad THEN 'https://news.ycombinator.com/item?id=' || event_id END AS canonical_url, CASE WHEN NOT bad THEN outbound END AS outbound_url, CASE WHEN NOT bad THEN floor(epoch(ts))::BIGINT END AS published, NULL::BIGINT AS views, CASE WHEN NOT bad THEN score END AS score, CASE WHEN NOT bad THEN event_id % 4 END AS comments FROM i
UNION ALL SELECT 'gsc', record_no, CASE WHEN page = '/p3' THEN 'malformed' ELSE 'observed' END, CASE WHEN page <> '/p3' THEN 'gsc:' || query || ':https://site.test' || page END, query, CASE WHEN page <> '/p3' THEN 'https://site.test' || page END, NULL, 1704067200, views, NULL, NULL FROM g""")
def s13_adapters(v):
    key = F.col("event_id")
    twice = v.events.withColumn("record_no", key).unionByName(v.events.where("event_id % 7 = 0").withColumn("record_no", key + 1_000_000_000))
    item = F.to_json(F.struct(
        key.alias("id"), F.when(F.col("event_type") != "error", "story").otherwise("comment").alias("type"), F.when(key % 11 != 0, F.concat(F.lit("title "), key.cast("string"))).alias("title"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"),
        F.when(key % 5 != 0, key % 50).alias("score"), (key % 4).alias("descendants"), F.when(key % 3 == 0, F.concat(F.lit("https://out.test/"), key.cast("string"))).alias("url"), F.when(key % 13 == 0, True).alias("dead"),
    ))
    asked = F.expr("TIMESTAMP '2024-01-01'")
    items = twice.select(F.lit("hacker_news").alias("source"), "record_no", F.when(key % 17 == 0, F.substring(item, 1, 9)).otherwise(item).alias("payload"), asked.alias("collected"))
    pages = v.search_rows.groupBy("query", "page").agg(F.sum("impressions").alias("n"))
    # One sorted list of at most 1,000 groups (40 queries by 25 pages).
    numbered = pages.withColumn("record_no", F.row_number().over(Window.orderBy("query", "page")).cast("long"))
    page = F.when(F.col("page") == "/p3", " ").otherwise(F.concat(F.lit("https://Site.test"), F.col("page"), F.lit("/?utm_source=x#top")))
    found = numbered.select(F.lit("gsc").alias("source"), "record_no", F.to_json(F.struct(F.array(F.concat(F.lit(" "), "query"), page).alias("keys"), F.col("n").alias("impressions"))).alias("payload"), asked.alias("collected"))
    rows = adapters.observations(items.unionByName(found), minimum_score=3)
    return rows.select("source", "record_no", "status", "external_id", "title", "canonical_url", "outbound_url", F.unix_seconds("published").alias("published"), "views", "score", "comments")


# Backlink records with fields missing by turns.
@register("s10_backlink_records", """SELECT id, id % 19 = 0 AS malformed, CASE WHEN id % 19 <> 0 THEN domain_from END AS domain_from, CASE WHEN id % 19 <> 0 AND id % 6 <> 0 THEN dofollow END AS is_dofollow, CASE WHEN id % 19 <> 0 THEN rank END AS rank, CASE WHEN id % 19 <> 0 THEN spam_score END AS spam_score,
 CASE WHEN id % 19 <> 0 THEN CASE WHEN is_lost THEN '2024-02-02' ELSE '2024-03-03' END END AS last_seen, id % 19 <> 0 AND CASE WHEN id % 4 = 0 THEN false ELSE is_lost END AS is_lost, id % 19 <> 0 AND is_broken AND id % 2 = 0 AS is_broken, CASE WHEN id % 19 <> 0 AND id % 3 < 2 THEN 'nofollow' ELSE '' END AS attributes FROM backlinks""")
def s10_backlinks(v):
    key = F.col("id")
    payload = F.to_json(F.struct(
        "domain_from", F.when(key % 6 != 0, F.col("dofollow")).alias("dofollow"), "rank", F.when(key % 2 == 0, F.col("spam_score")).alias("backlink_spam_score"), F.col("spam_score").alias("backlinks_spam_score"),
        F.when(F.col("is_lost"), "2024-02-02").alias("lost_date"), F.lit("2024-03-03").alias("last_visited"), F.when(key % 4 == 0, False).alias("is_lost"), F.when(key % 2 == 0, F.col("is_broken")).alias("is_broken"),
        F.when(key % 3 == 0, F.array(F.lit("nofollow"))).alias("rel_attributes"), F.when(key % 3 == 1, F.array(F.lit("nofollow"))).alias("attributes"),
    ))
    records = v.backlinks.select("id", F.when(key % 19 == 0, F.substring(payload, 1, 20)).otherwise(payload).alias("payload"))
    rows = adapters.backlink_rows(records, ("id",))
    return rows.select("id", "malformed", "domain_from", "is_dofollow", "rank", "spam_score", "last_seen", "is_lost", "is_broken", F.array_join("rel_attributes", ",").alias("attributes"))


@register("h8_h9_h10_collections", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority))[1:3], ',') AS first3, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open_max FROM orders GROUP BY 1")
def h8(v):
    rows = v.orders.groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3).alias("p"), F.map_from_entries(F.collect_set(F.when(F.col("o_orderstatus") == "none", F.struct(F.lit("x"), F.lit("y"))))).alias("m"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("open_max"))
    return rows.select("o_custkey", F.array_join("p", ",").alias("first3"), "open_max")


@register("h10_json_strings", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS tags FROM orders")
def h10(v):
    text = F.when(F.col("o_orderkey") % 2 == 0, '["a", null, "b"]').otherwise("oops")
    return v.orders.select("o_orderkey", text.alias("t")).select("o_orderkey", F.array_join(sinks.string_array("t"), ",").alias("tags"))


@register("h7_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, abs(epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 3600.0::DOUBLE AS hours, hour(o_orderdate - INTERVAL 6 HOUR) AS chicago_hour FROM orders WHERE month(o_orderdate) IN (1, 12)")
def h7(v):
    from sightline.functions.expr import hours_between

    rows = v.orders.where("month(o_orderdate) IN (1, 12)")
    local = F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "America/Chicago")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"), hours_between("o_orderdate", F.expr("TIMESTAMP '1995-01-01'")).alias("hours"), F.hour(local).cast("long").alias("chicago_hour"))


@register("h11_number_format", "SELECT c_custkey, format('{:,}', c_custkey * 1000) AS grouped FROM customer")
def h11(v):
    return v.customer.select("c_custkey", F.format_number(F.col("c_custkey") * 1000, 0).alias("grouped"))
