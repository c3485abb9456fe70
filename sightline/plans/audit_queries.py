"""Registered site-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import html, robots, urls
from sightline.operators import audit
from sightline.plans.registry import register

CANON = "coalesce(canonical_url, header_canonical_url)"
SEVERITY_CASE = "CASE " + " ".join(f"WHEN issue_type IN ({', '.join(repr(t) for t in types)}) THEN '{s}'" for s, types in audit.SEVERITIES.items()) + " END"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"
OK = "fetch_class = 'ok' AND status_code < 300"
HTML = f"{OK} AND is_html"
CHECKS = {
    "blocked-page": "fetch_class = 'blocked'",
    "server-error": "fetch_class = 'ok' AND status_code >= 500",
    "broken-page": "fetch_class = 'ok' AND status_code >= 400 AND status_code < 500",
    "slow-response": f"{OK} AND response_ms > 1500",
    "missing-title": f"{HTML} AND coalesce(title, '') = ''",
    "title-too-long": f"{HTML} AND length(title) > 60",
    "title-too-short": f"{HTML} AND length(title) BETWEEN 1 AND 9",
    "missing-meta-description": f"{HTML} AND coalesce(meta_description, '') = ''",
    "meta-description-too-long": f"{HTML} AND length(meta_description) > 160",
    "meta-description-too-short": f"{HTML} AND length(meta_description) BETWEEN 1 AND 69",
    "missing-h1": f"{HTML} AND h1_count = 0",
    "multiple-h1": f"{HTML} AND h1_count > 1",
    "noindex-page": f"{HTML} AND NOT is_indexable",
    "canonical-conflict": f"{HTML} AND canonical_url <> header_canonical_url",
    "canonicalized-page": f"{HTML} AND {CANON} <> url",
    "thin-content": f"{HTML} AND is_indexable AND word_count < 150",
    "images-missing-alt": f"{HTML} AND images_missing_alt > 0",
    "no-outgoing-links": f"{HTML} AND is_indexable AND link_count = 0",
    "deep-page": f"{HTML} AND crawl_depth >= 5",
}
ISSUES = "issues AS (" + " UNION ALL ".join(f"SELECT id, url, audit_id, '{t}' AS issue_type FROM audit_pages WHERE {c}" for t, c in CHECKS.items()) + ")"
RATED = f"{ISSUES}, rated AS (SELECT *, {SEVERITY_CASE} AS severity FROM issues)"


def _rated(v):
    issues = audit.page_issues(v.audit_pages)
    return issues.join(F.broadcast(audit.registry(issues.sparkSession)), "issue_type")


@register("p5_page_issues", f"WITH {ISSUES} SELECT id, url, issue_type FROM issues")
def p5(v):
    return audit.page_issues(v.audit_pages)


@register("p22_rated_issues", f"WITH {RATED} SELECT id, issue_type, severity FROM rated")
def p22(v):
    return _rated(v).select("id", "issue_type", "severity")


@register("a4_issue_page_counts", f"WITH {RATED} SELECT issue_type, severity, count(DISTINCT id) AS pages FROM rated GROUP BY ALL")
def a4(v):
    return audit.issue_counts(_rated(v))


@register("a5_issue_summary", f"WITH {RATED} SELECT issue_type, severity, count(*) AS n FROM rated GROUP BY ALL")
def a5(v):
    return audit.issue_summary(_rated(v))


@register("a9_top_issue_types", f"WITH {RATED} SELECT issue_type, count(DISTINCT id) AS pages FROM rated GROUP BY issue_type ORDER BY pages DESC, issue_type LIMIT 3")
def a9(v):
    return audit.issue_counts(_rated(v)).orderBy(F.desc("pages"), "issue_type").limit(3).select("issue_type", "pages")


@register("a22_issue_groups", f"WITH {RATED} SELECT issue_type, severity, count(*) AS n FROM rated GROUP BY ALL")
def a22(v):
    rows = audit.page_issues(v.audit_pages).withColumn("severity", F.lit("info"))
    return audit.issue_groups(rows, audit.registry(rows.sparkSession))


@register("k11_listed_issues", f"WITH {RATED} SELECT id, issue_type FROM rated ORDER BY {RANK}, issue_type, id LIMIT 200")
def k11(v):
    return audit.listed_issues(_rated(v)).select("id", "issue_type")


DUP = """cand AS (SELECT * FROM audit_crawls WHERE fetch_class = 'ok' AND status_code BETWEEN 200 AND 299 AND is_indexable AND (nullif(coalesce(canonical_url, header_canonical_url), '') IS NULL OR coalesce(canonical_url, header_canonical_url) = url)),
long AS (SELECT audit_id, id, url, 'duplicate-title' AS issue_type, nullif(title, '') AS k FROM cand UNION ALL SELECT audit_id, id, url, 'duplicate-meta-description', nullif(meta_description, '') FROM cand UNION ALL SELECT audit_id, id, url, 'duplicate-content', CASE WHEN word_count > 0 THEN content_hash END FROM cand),
grp AS (SELECT audit_id, issue_type, k, count(*) AS group_size, list(url ORDER BY id) AS urls FROM long WHERE k IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"""


@register("a14_p7_duplicates", f"WITH {DUP} SELECT audit_id, id, url, issue_type, group_size, array_to_string(list_filter(urls, lambda u: u <> url)[1:3], ' ') AS other_urls FROM long JOIN grp USING (audit_id, issue_type, k)")
def a14(v):
    return audit.duplicates(v.audit_crawls).withColumn("other_urls", F.array_join("other_urls", " "))


@register("j12_p9_broken_links", "SELECT l.audit_id, l.source_page_id, l.source_url, l.target_url, p.status_code AS target_status FROM audit_links l JOIN audit_pages p ON l.target_url = p.url AND l.audit_id = p.audit_id WHERE l.is_internal AND p.fetch_class = 'ok' AND p.status_code >= 400")
def j12(v):
    return audit.broken_links(v.audit_links, v.audit_pages)


@register("j10_p10_orphans", """SELECT audit_id, id, url FROM audit_crawls p WHERE fetch_class = 'ok' AND status_code BETWEEN 200 AND 299 AND url <> 'https://site.test/p3'
 AND NOT EXISTS (SELECT 1 FROM crawl_links l WHERE l.is_internal AND l.target_url = p.url AND l.audit_id = p.audit_id AND l.source_page_id <> p.id) AND NOT EXISTS (SELECT 1 FROM audit_crawls r WHERE r.redirect_url = p.url AND r.audit_id = p.audit_id)""")
def j10(v):
    starts = v.audit_crawls.where("url = 'https://site.test/p3'")
    return audit.orphans(v.audit_crawls, v.crawl_links, starts).select("audit_id", "id", "url")


REDIR = """r AS (SELECT audit_id, url, redirect_url AS target, id FROM audit_crawls WHERE status_code BETWEEN 300 AND 399 AND redirect_url IS NOT NULL),
walk AS (SELECT audit_id, url AS start, target AS cur, [url, target] AS path, url = target AS looped FROM r UNION ALL SELECT walk.audit_id, start, r.target, list_append(path, r.target), list_contains(path, r.target) FROM walk JOIN r ON walk.cur = r.url AND walk.audit_id = r.audit_id WHERE NOT looped),
ends AS (SELECT audit_id, start, arg_max(cur, len(path)) AS final_url, max(len(path)) - 1 AS hops, bool_or(looped) AS is_loop, arg_max(path, len(path)) AS path FROM walk GROUP BY audit_id, start),
heads AS (SELECT e.*, r.id FROM ends e JOIN r ON r.url = e.start AND r.audit_id = e.audit_id WHERE (e.audit_id, e.start) NOT IN (SELECT (audit_id, target) FROM r)),
walked AS (SELECT audit_id, unnest(path) AS url FROM heads WHERE is_loop),
lonely AS (SELECT DISTINCT audit_id, list_min(list_distinct(path)) AS url FROM ends WHERE is_loop AND path[1] = path[-1] AND (audit_id, start) NOT IN (SELECT (audit_id, url) FROM walked))"""


@register("p8_redirect_walks", f"WITH RECURSIVE {REDIR} SELECT audit_id, id, start AS url, 'redirect-chain' AS issue_type, hops::BIGINT AS hops, final_url FROM heads WHERE NOT is_loop AND hops >= 2 UNION ALL SELECT audit_id, id, start, 'redirect-loop', NULL, NULL FROM heads WHERE is_loop UNION ALL SELECT l.audit_id, r.id, l.url, 'redirect-loop', NULL, NULL FROM lonely l JOIN r ON r.url = l.url AND r.audit_id = l.audit_id")
def p8(v):
    return audit.redirect_walks(v.audit_crawls)


# UNION keeps a (url, depth) once, so the recursion ends only by a bound; no depth exceeds the number of urls linked to.
@register("p11_crawl_depths", """WITH RECURSIVE e AS (SELECT DISTINCT audit_id, source_url AS u, target_url AS t, 1 AS step FROM crawl_links WHERE is_internal UNION SELECT audit_id, url, redirect_url, 0 FROM audit_crawls WHERE status_code BETWEEN 300 AND 399 AND redirect_url IS NOT NULL),
most AS (SELECT count(DISTINCT t) AS n FROM e), d(audit_id, url, depth) AS (SELECT a, 'https://site.test/p3', 0 FROM range(3) s(a) UNION SELECT e.audit_id, e.t, d.depth + e.step FROM d JOIN e ON d.url = e.u AND d.audit_id = e.audit_id WHERE d.depth + e.step <= least(60, (SELECT n FROM most)))
SELECT audit_id, url, min(depth)::INT AS depth FROM d GROUP BY audit_id, url UNION ALL SELECT DISTINCT audit_id, url, NULL::INT FROM audit_crawls c WHERE url LIKE '%5' AND NOT EXISTS (SELECT 1 FROM d WHERE d.url = c.url AND d.audit_id = c.audit_id)""")
def p11(v):
    start = v.audit_crawls.sparkSession.range(3).selectExpr("cast(id as int) as audit_id", "'https://site.test/p3' as url")
    return audit.crawl_depths(start, v.crawl_links, audit.redirects(v.audit_crawls), v.audit_crawls.where("url like '%5'"))


@register("f10_page_filter", "SELECT id FROM audit_pages WHERE contains(lower(concat_ws(' ', url, nullif(title, ''), nullif(meta_description, ''))), 'p1') AND status_code BETWEEN 200 AND 299 AND word_count BETWEEN 50 AND 380 AND response_ms IS NOT NULL AND response_ms <= 1800 AND images_missing_alt <= 0")
def f10(v):
    return audit.filter_pages(v.audit_pages, " P1 ", "ok", (50, 380), (None, 1800), "no").select("id")


@register("f21_page_reader", "SELECT id FROM audit_pages WHERE fetch_class = 'ok' AND status_code = 200 AND contains(url, '5') ORDER BY id LIMIT 20")
def f21(v):
    return audit.read_pages(v.audit_pages, "ok", 200, "5", 20).select("id")


FAIL = "(error_message IS NOT NULL OR (performance_score IS NULL AND seo_score IS NULL))"


@register("f11_performance_filter", f"SELECT page_id FROM lighthouse WHERE NOT {FAIL} AND strategy = 'mobile' AND performance_score >= 20 AND lcp_ms / 1000.0 <= 4")
def f11(v):
    return audit.filter_performance(v.lighthouse, "ok", "mobile", (20, None), max_lcp_seconds=4).select("page_id")


@register("a23_result_stats", f"""SELECT p.audit_id, floor(avg(coalesce(response_ms, 0)) + 0.5)::BIGINT AS mean_ms, count(*) AS pages, any_value(t.performance) AS performance, any_value(t.failed) AS failed FROM audit_pages p
LEFT JOIN (SELECT audit_id, floor(avg(CASE WHEN NOT {FAIL} THEN performance_score END) + 0.5)::BIGINT AS performance, count(*) FILTER (WHERE {FAIL}) AS failed FROM lighthouse GROUP BY 1) t USING (audit_id) GROUP BY p.audit_id""")
def a23(v):
    return audit.result_stats(v.audit_pages, v.lighthouse)


@register("a18_capacity", "SELECT audit_id, n + coalesce(m, 0) AS used FROM (SELECT audit_id, count(*) AS n FROM audit_pages GROUP BY 1) LEFT JOIN (SELECT audit_id, count(*) AS m FROM lighthouse GROUP BY 1) USING (audit_id)")
def a18(v):
    return audit.capacity(v.audit_pages, v.lighthouse)


@register("a24_predominant_host", "SELECT h AS host FROM (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, h LIMIT 1")
def a24(v):
    rows = v.pages.select(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"), F.lit(200).alias("status_code"))
    return audit.predominant_host(rows, "start.test")


@register("j21_performance_pages", "SELECT l.page_id, p.url, l.performance_score FROM lighthouse l LEFT JOIN audit_pages p ON l.page_id = p.id AND p.status_code = 200")
def j21(v):
    pages = v.audit_pages.where("status_code = 200").select(F.col("id").alias("page_id"), "url")
    return v.lighthouse.join(pages, "page_id", "left").select("page_id", "url", "performance_score")


K12_SQL = r"""WITH p AS (SELECT page_id AS id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> '')) AS params FROM pages),
k AS (SELECT id, 'https://' || host || coalesce(nullif(path, ''), '/') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS key, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '\d+') THEN ':id' WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}') THEN ':date' WHEN len(string_split(s, '-')) > 2 THEN ':slug' ELSE s END) AS template FROM p),
s AS (SELECT id FROM k WHERE regexp_replace(key, '/+$', '') = 'https://thther.example.org/en/685' ORDER BY key <> 'https://thther.example.org/en/685/', id LIMIT 1)
SELECT id FROM (SELECT id, -1 AS place FROM s UNION ALL SELECT min(id), min(id) FROM k WHERE id NOT IN (SELECT id FROM s) GROUP BY template) ORDER BY place LIMIT 10"""


@register("k12_performance_sample", K12_SQL)
def k12(v):
    rows = v.pages.select(F.col("page_id").alias("id"), "url", F.lit(200).alias("status_code"), urls.canonical_key("url").alias("key"), urls.template(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)).alias("template"))
    return audit.performance_sample(rows, "https://thther.example.org/en/685/")


@register("k13_nulls_last", "SELECT id, response_ms FROM audit_pages ORDER BY response_ms ASC NULLS LAST, id")
def k13(v):
    return v.audit_pages.orderBy(F.asc_nulls_last("response_ms"), "id").select("id", "response_ms")


AUDITS = "SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'performance' ELSE 'seo' END AS category, concat('audit-', CAST(l_partkey % 30 AS VARCHAR)) AS audit_key, l_discount * 10 AS score, CASE WHEN l_tax > 0.06 THEN 'manual' ELSE 'metricSavings' END AS mode, l_quantity * 10 AS savings_ms, l_extendedprice * 2 AS savings_bytes FROM lineitem"


def _audits(v):
    return v.lineitem.selectExpr("l_orderkey * 10 + l_linenumber AS k", "CASE WHEN l_linenumber % 2 = 0 THEN 'performance' ELSE 'seo' END AS category", "concat('audit-', l_partkey % 30) AS audit_key", "l_discount * 10 AS score", "CASE WHEN l_tax > 0.06 THEN 'manual' ELSE 'metricSavings' END AS mode", "l_quantity * 10 AS savings_ms", "l_extendedprice * 2 AS savings_bytes")


PERF = f"a AS ({AUDITS}), perf AS (SELECT *, CASE WHEN savings_ms >= 300 OR savings_bytes >= 150000 OR p < 50 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT *, floor(score * 100 + 0.5)::INT AS p FROM a) WHERE p < 90 AND mode <> 'manual')"


@register("p23_performance_issues", f"WITH {PERF} SELECT k, audit_key, p AS score, severity FROM perf")
def p23(v):
    return audit.performance_issues(_audits(v)).select("k", "audit_key", "score", "severity")


@register("k21_performance_order", f"WITH {PERF} SELECT k, p AS score FROM perf ORDER BY savings_ms * 1000 + savings_bytes DESC, p, audit_key, k LIMIT 100")
def k21(v):
    return audit.performance_order(audit.performance_issues(_audits(v))).limit(100).select("k", "score")


@register("a25_category_counts", f"WITH {PERF}, c AS (SELECT unnest(['performance', 'accessibility', 'best-practices', 'seo']) AS category) SELECT c.category, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM c LEFT JOIN perf USING (category) GROUP BY c.category")
def a25(v):
    return audit.category_counts(audit.performance_issues(_audits(v)), ["performance", "accessibility", "best-practices", "seo"])


@register("p24_score_percent", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_discount * 100 + 0.5)::INT AS pct FROM lineitem")
def p24(v):
    from sightline.functions.expr import percent

    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", percent("l_discount").alias("pct"))


@register("p3_fetch_class", "SELECT page_id, CASE WHEN s = 0 THEN 'error' WHEN s IN (401, 403, 429) OR (s = 503 AND page_id % 2 = 0) THEN 'blocked' ELSE 'ok' END AS fetch_class FROM (SELECT page_id, list_extract([0, 200, 301, 401, 403, 404, 429, 503], (page_id % 8 + 1)::INT) AS s FROM pages)")
def p3(v):
    status = F.element_at(F.array(*(F.lit(x) for x in (0, 200, 301, 401, 403, 404, 429, 503))), (F.col("page_id") % 8 + 1).cast("int"))
    body = F.when(F.col("page_id") % 2 == 0, "<b>Just a moment...</b>").otherwise("hello")
    return v.pages.select("page_id", audit.fetch_class(status, F.lit(None), body).alias("fetch_class"))


@register("p4_header_canonical", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS canonical FROM pages")
def p4(v):
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<https://a/b>; rel="next", <'), F.col("url"), F.lit('>; rel="canonical"'))).otherwise(F.concat(F.lit("<"), F.col("url"), F.lit('>; rel="next"')))
    return v.pages.select("page_id", audit.header_canonical(link).alias("canonical"))


@register("p6_heading_skip", "SELECT page_id, page_id % 3 = 2 AS skips FROM pages")
def p6(v):
    return v.pages.select("page_id", audit.heading_skip(F.array(F.lit(1), F.lit(2), (F.col("page_id") % 3 + 2).cast("int"))).alias("skips"))


@register("p1_p2_html_analysis")
def p1(v):
    pages = html.analyse_pages(v.pages.select(F.col("page_id").alias("id"), "url", "html"))
    return html.derived_page(pages.withColumn("x_robots_tag", F.lit(None).cast("string"))).drop("heading_order")


@register("p1_p5_golden_audit")
def p1_p5(v):
    pages = html.analyse_pages(v.pages.select(F.col("page_id").alias("id"), "url", "html")).withColumn("x_robots_tag", F.lit(None).cast("string"))
    extra = {"fetch_class": F.lit("ok"), "status_code": F.lit(200), "header_canonical_url": F.lit(None).cast("string"), "is_html": F.lit(True), "response_ms": F.lit(100), "crawl_depth": F.lit(1)}
    return audit.page_issues(html.derived_page(pages).withColumns(extra))


def _robots(v):
    agent = F.element_at(F.array(*(F.lit(x) for x in ("*", "GPTBot", "OAI-SearchBot", "ClaudeBot"))), (F.col("page_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("User-agent: "), agent, F.lit("\nDisallow: "), F.when(F.col("page_id") % 3 == 0, "/").otherwise("/x"), F.lit("\nContent-Signal: search=yes, ai-train="), F.when(F.col("page_id") % 5 == 0, "no").when(F.col("page_id") % 5 == 1, "maybe").otherwise("yes"), F.lit("\nContent-Usage: train-ai=n, search=y\n"))
    return v.pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 7 != 0, text).alias("text"))


@register("p16_robots_status", """SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'no_robots_txt' WHEN page_id % 3 <> 0 THEN 'not_mentioned' WHEN page_id % 4 = 1 THEN 'blocked' WHEN page_id % 4 = 0 THEN 'blocked_by_wildcard' ELSE 'not_mentioned' END AS gptbot FROM pages""")
def p16(v):
    return robots.policies(_robots(v)).select("id", F.col("bots")["GPTBot"].alias("gptbot"))


@register("p17_content_signals", "SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'unavailable' WHEN page_id % 5 = 0 THEN 'blocked' WHEN page_id % 5 = 1 THEN 'invalid' ELSE 'allowed' END AS train, CASE WHEN page_id % 7 = 0 THEN 'unavailable' ELSE 'unspecified' END AS input FROM pages")
def p17(v):
    return robots.policies(_robots(v)).select("id", F.col("signals")["ai-train"].alias("train"), F.col("signals")["ai-input"].alias("input"))


@register("p18_usage_preferences", "SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'unavailable' WHEN page_id % 4 = 0 THEN 'measured' ELSE 'unspecified' END AS state, CASE WHEN page_id % 7 <> 0 AND page_id % 4 = 0 THEN 'disallowed' END AS train FROM pages")
def p18(v):
    return robots.policies(_robots(v)).select("id", "preference_state", F.col("preferences")["train-ai"].alias("train")).withColumnRenamed("preference_state", "state")


@register("p19_purposes")
def p19(v):
    return robots.policies(_robots(v)).select("id", "search", "training", "user", "ads", "degraded")


@register("p20_policy_findings")
def p20(v):
    return robots.findings(robots.policies(_robots(v)))


@register("p21_live_probes", """WITH p AS (SELECT page_id, page_id % 6 <> 0 AS ok, page_id % 9 = 4 AS blocked, 1000 AS base, page_id % 13 * 100 AS len FROM pages)
SELECT page_id AS id, CASE WHEN NOT ok THEN 'ai-crawler-live-probe-error' WHEN blocked THEN 'ai-crawler-live-search-blocked' ELSE 'ai-crawler-live-content-mismatch' END AS issue_type FROM p WHERE NOT ok OR blocked OR len < 500""")
def p21(v):
    rows = v.pages.selectExpr("page_id AS id", "page_id % 6 <> 0 AS baseline_ok", "1000 AS baseline_length", "'search' AS purpose", "page_id % 9 = 4 AS blocked", "CAST(NULL AS STRING) AS error", "page_id % 13 * 100 AS length", "false AS truncated")
    return robots.live_issues(rows).select("id", "issue_type")


@register("s14_sitemap_urls", "SELECT DISTINCT url FROM pages")
def s14(v):
    from sightline.sources.sitemaps import sitemap_urls

    name = lambda k: F.concat(F.lit("https://site.test/map"), k.cast("string"))
    escaped = F.regexp_replace("url", "&", "&amp;")
    maps = v.pages.groupBy((F.col("page_id") % 8).alias("k")).agg(F.concat(F.lit("<urlset><url><loc> "), F.array_join(F.collect_list(escaped), "</loc></url>\n<url><loc>"), F.lit(" </loc></url></urlset>")).alias("xml"))
    index = maps.agg(F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.array_join(F.collect_list(name(F.col("k"))), "</loc></sitemap><sitemap><loc>"), F.lit("</loc></sitemap></sitemapindex>")).alias("xml"))
    documents = maps.select(name(F.col("k")).alias("url"), "xml").unionByName(index.select(F.lit("https://site.test/index").alias("url"), "xml"))
    return sitemap_urls(documents, documents.select(F.lit("https://site.test/index").alias("url")).limit(1))
