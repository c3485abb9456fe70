"""Registered AI-visibility, backlink and domain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import addresses, expr, urls
from sightline.operators import domains
from sightline.operators import keywords as kw
from sightline.operators import visibility as vis
from sightline.plans.registry import register

KEYS = ["Brand0", "brand1", "brand2", "nobody"]


def _keys(v):
    return v.mentions.sparkSession.createDataFrame([(k,) for k in KEYS], "label string")


@register("a10_a11_share_of_voice", """WITH k AS (SELECT unnest(['Brand0', 'brand1', 'brand2', 'nobody']) AS label), m AS (SELECT lower(brand) AS b, sum(mentions) AS mentions FROM mentions GROUP BY 1),
r AS (SELECT label, lower(label) = 'brand0' AS is_target, m.mentions FROM k LEFT JOIN m ON lower(label) = b), t AS (SELECT coalesce(sum(mentions), 0) AS total FROM r)
SELECT label, is_target, mentions::BIGINT AS mentions, CASE WHEN total > 0 AND mentions IS NOT NULL THEN mentions::DOUBLE / total * 100 END AS share_pct FROM r, t""", rounded=("share_pct",))
def a10(v):
    return vis.share_of_voice(v.mentions.select(F.col("brand").alias("key"), "mentions"), _keys(v), "BRAND0")


@register("a13_platform_totals", "SELECT sum(mentions)::BIGINT AS mentions, sum(volume)::BIGINT AS volume FROM mentions WHERE platform <> 'chat_gpt'")
def a13(v):
    return vis.platform_totals(v.mentions, False)


@register("k9_top_queries", "SELECT id, platform, volume FROM mentions WHERE question <> '' QUALIFY row_number() OVER (PARTITION BY platform ORDER BY coalesce(volume, 0) DESC, id) <= 25")
def k9(v):
    return vis.top_queries(v.mentions).select("id", "platform", "volume")


SOURCES = """ex AS (SELECT platform, source_url, question, first(volume ORDER BY id) AS volume FROM mentions WHERE question <> '' GROUP BY ALL),
tq AS (SELECT *, row_number() OVER (PARTITION BY platform, source_url ORDER BY coalesce(volume, 0) DESC, question) AS k FROM ex QUALIFY k <= 5),
qs AS (SELECT platform, source_url, string_agg(question, '|' ORDER BY k) AS questions FROM tq GROUP BY ALL),
pg AS (SELECT platform, source_url, sum(mentions)::BIGINT AS mentions, sum(volume)::BIGINT AS volume FROM mentions GROUP BY ALL),
tp AS (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY platform ORDER BY coalesce(volume, 0) DESC, coalesce(mentions, 0) DESC, source_url) <= 10),
cited AS (SELECT platform, source_url, mentions, volume, questions FROM tp LEFT JOIN qs USING (platform, source_url))"""


def _mentions(v):
    return v.mentions


@register("j20_cited_sources", f"WITH {SOURCES} SELECT * FROM cited")
def j20(v):
    return vis.cited_sources(v.mentions).withColumn("questions", F.array_join("questions", "|"))


@register("f12_source_filter", f"WITH {SOURCES} SELECT platform, source_url FROM cited WHERE (contains(lower(source_url || ' ' || coalesce(replace(questions, '|', ' '), '')), 'src1') OR contains(lower(source_url || ' ' || coalesce(replace(questions, '|', ' '), '')), 'the')) AND platform = 'google' AND (mentions IS NULL OR mentions >= 2)")
def f12(v):
    return vis.filter_sources(vis.cited_sources(v.mentions), "src1, THE", "", "google", (2, None)).select("platform", "source_url")


@register("a12_monthly_volume", "SELECT year, month, sum(volume)::BIGINT AS volume FROM mentions WHERE volume IS NOT NULL GROUP BY year, month ORDER BY year DESC, month DESC LIMIT 12")
def a12(v):
    return vis.monthly_volume(v.mentions)


@register("h5_brand_mention", r"SELECT conv_id, turn, regexp_matches(text, '\bthe\b', 'i') AS mentioned FROM conversations")
def h5(v):
    return vis.brand_mentions(v.conversations, "text", "The").select("conv_id", "turn", "mentioned")


@register("f17_backlink_filter", "SELECT id FROM backlinks WHERE (contains(lower(url_from), '0001') OR contains(lower(url_from), '0002')) AND NOT contains(lower(url_from), '99') AND rank >= 10 AND spam_score <= 60 AND dofollow AND NOT is_lost AND NOT is_broken")
def f17(v):
    return vis.backlink_filter(v.backlinks, "0001, 0002", "99", rank=(10, None), spam=(None, 60), dofollow=True, hide_lost=True, hide_broken=True).select("id")


@register("f18_referring_domains", "SELECT domain_from, backlinks, rank, spam_score FROM (SELECT domain_from, count(*) AS backlinks, max(domain_rank) AS rank, avg(spam_score) AS spam_score FROM backlinks GROUP BY 1) WHERE contains(domain_from, '1') AND backlinks >= 100 AND rank >= 5", rounded=("spam_score",))
def f18(v):
    rows = vis.referring_domains(v.backlinks)
    return rows.where(kw.api_conditions("1", "", {"backlinks": (100, None), "rank": (5, None)}, field="domain_from", mode="any")).select("domain_from", "backlinks", "rank", "spam_score")


@register("f18_linked_pages", "SELECT url_to, count(*) AS backlinks, count(DISTINCT domain_from) AS referring_domains, max(rank) AS rank FROM backlinks GROUP BY 1 HAVING count(DISTINCT domain_from) >= 50 ORDER BY backlinks DESC, url_to LIMIT 20")
def f18_pages(v):
    return kw.sorted_by(vis.linked_pages(v.backlinks).where("referring_domains >= 50"), {"backlinks": "backlinks"}, "backlinks", True, "url_to").limit(20)


@register("w13_link_history", "SELECT CAST(date_trunc('month', first_seen) AS DATE) AS month, count(*) FILTER (WHERE NOT is_lost) AS new_links, count(*) FILTER (WHERE is_lost) AS lost_links FROM backlinks WHERE first_seen <= DATE '1996-06-30' AND first_seen > DATE '1996-06-30' - INTERVAL 365 DAY GROUP BY 1")
def w13(v):
    return vis.link_history(v.backlinks, F.lit("1996-06-30").cast("date"))


@register("j22_domain_ratings", "WITH d AS (SELECT DISTINCT domain_from FROM backlinks), r AS (SELECT concat('supplier', lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), '.test') AS host, s_suppkey % 100 AS rating FROM supplier WHERE s_suppkey % 2 = 0) SELECT domain_from, rating FROM d LEFT JOIN r ON regexp_replace(lower(domain_from), '^www\\.', '') = host")
def j22(v):
    ratings = v.supplier.where("s_suppkey % 2 = 0").select(F.format_string("supplier%09d.test", "s_suppkey").alias("host"), (F.col("s_suppkey") % 100).alias("rating"))
    return vis.with_ratings(v.backlinks.select("domain_from").distinct(), ratings)


@register("w14_snapshot_freshness", "SELECT o_custkey % 20 AS project_id, max(o_orderkey) AS id, epoch(TIMESTAMP '1998-01-01') - epoch(arg_max(o_orderdate, o_orderkey)) < 86400 * 300 AS fresh FROM orders GROUP BY 1")
def w14(v):
    snaps = v.orders.select((F.col("o_custkey") % 20).alias("project_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"))
    return vis.fresh_snapshots(snaps, F.expr("TIMESTAMP '1998-01-01'"), 24 * 300).select("project_id", "id", "fresh")


@register("f25_host_matches", "SELECT page_id, regexp_replace(h, '^www\\.', '') = 'example.com' OR ends_with(regexp_replace(h, '^www\\.', ''), '.example.com') AS matches FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)")
def f25(v):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return v.pages.select("page_id", expr.host_matches(host, F.lit("www.Example.com")).alias("matches"))


@register("h4_relative_path", "SELECT page_id, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM pages")
def h4(v):
    return v.pages.select("page_id", urls.relative_path("url").alias("path"))


#: A url's parts, for SQL: scheme, host, path, parameters in order, fragment with its sign.
PARTS = r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS path, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> '') AS params, regexp_extract(url, '(#.*)$', 1) AS fragment, url FROM pages"""
QUERY = "CASE WHEN len(params) > 0 THEN '?' || array_to_string({}, '&') ELSE '' END"
H4_SQL = f"""WITH u AS ({PARTS}), l AS (SELECT *, string_split(regexp_replace(host, '^www\\.', ''), '.') AS labels FROM u)
SELECT page_id, array_to_string(labels[-(CASE WHEN labels[-2] IN ('co', 'org', 'ac', 'gov') AND labels[-1] = 'uk' THEN 3 ELSE 2 END):], '.') AS domain, scheme || '://' || host || path || {QUERY.format("params")} || fragment AS safe_url, CASE WHEN regexp_full_match(lower(trim(url)), '(https?://)?([a-z0-9-]+\\.)+[a-z]{{2,}}(:[0-9]+)?([/?#]\\S*)?') THEN 'domain' ELSE 'keyword' END AS kind FROM l"""
P12_SQL = f"""WITH u AS ({PARTS}) SELECT page_id, scheme || '://' || host || path || {QUERY.format("list_sort(params)")} AS url, 'https://' || regexp_replace(host, '^www\\.', '') || path || {QUERY.format("list_sort(params)")} AS key, scheme = 'https' AND regexp_replace(host, '^www\\.', '') = 'example.com' AS same_origin FROM u"""
F24_SQL = f"""WITH u AS ({PARTS}) SELECT page_id, scheme IN ('http', 'https') AND contains(host, '.') AND NOT regexp_full_match(host, '[0-9.]+') AND NOT regexp_matches(host, '\\.(localhost|local|internal|intranet|lan|home|corp)$') AS crawlable FROM u"""


@register("h4_domain_normalise", H4_SQL)
def h4_domain(v):
    return v.pages.select("page_id", urls.registrable_domain(F.col("url")).alias("domain"), urls.safe_http_url(F.col("url")).alias("safe_url"), urls.target_kind(F.col("url")).alias("kind"))


@register("p12_normal_url", P12_SQL)
def p12(v):
    return v.pages.select("page_id", urls.normal_url("url").alias("url"), urls.canonical_key("url").alias("key"), urls.same_origin("url", F.lit("https://example.com/")).alias("same_origin"))


@register("p15_url_template", r"SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '\d+') THEN ':id' WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}') THEN ':date' WHEN len(string_split(s, '-')) > 2 THEN ':slug' ELSE s END), '/') AS template FROM pages")
def p15(v):
    return v.pages.select("page_id", urls.template(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)).alias("template"))


@register("f24_crawlable_url", F24_SQL)
def f24(v):
    return v.pages.select("page_id", urls.crawlable("url").alias("crawlable"))


#: Hosts that fall in and beside every address range, by id: dotted, as IPv6, and mapped into IPv6 in two spellings.
FIRST = (10, 127, 0, 169, 172, 192, 100, 198, 224, 255, 8, 173)
_A = f"element_at(array({', '.join(map(str, FIRST))}), CAST(o_orderkey % {len(FIRST)} AS INT) + 1)"
_B = "CASE o_orderkey % 5 WHEN 0 THEN 254 WHEN 1 THEN 16 + o_orderkey % 17 WHEN 2 THEN 168 WHEN 3 THEN 63 + o_orderkey % 67 ELSE 17 + o_orderkey % 4 END"


# IPv4 and IPv6 addresses against ranges: numbers in sorted intervals.
@register("f24_address_ranges", f"""WITH n AS (SELECT o_orderkey, o_orderkey % 7 AS form, ([{', '.join(map(str, FIRST))}])[o_orderkey % {len(FIRST)} + 1] AS a, {_B} AS b, 64512 + o_orderkey * 13 % 1024 AS g FROM orders)
SELECT o_orderkey, CASE WHEN form = 5 THEN g BETWEEN 64512 AND 65023 OR g BETWEEN 65152 AND 65215 WHEN form = 6 THEN o_orderkey % 4 < 2
 ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) END AS blocked FROM n""")
def f24_ranges(v):
    key = F.col("o_orderkey")
    a, b, c = F.expr(_A), F.expr(_B), key % 256
    low = lambda x: F.lower(F.hex(x.cast("long")))
    dotted = F.concat_ws(".", *(x.cast("string") for x in (a, b, c, F.lit(7))))
    hexed = F.concat(F.lit("[::ffff:"), low(a * 256 + b), F.lit(":"), low(c * 256 + 7), F.lit("]"))
    mapped = F.concat(F.lit("[0:0:0:0:0:FFFF:"), dotted, F.lit("]"))
    own = F.concat(F.lit("["), low(64512 + key * 13 % 1024), F.lit("::7:"), low(key % 65536), F.lit("]"))
    least = F.concat(F.lit("[::"), (key % 4).cast("string"), F.lit("]"))
    host = F.when(key % 7 == 3, hexed).when(key % 7 == 4, mapped).when(key % 7 == 5, own).when(key % 7 == 6, least).otherwise(dotted)
    return v.orders.select("o_orderkey", addresses.blocked_address(host).alias("blocked"))


#: Rules of a public-suffix table, and endings of hosts that they meet: plain, wildcard, exception, none.
RULES = ("com", "co.uk", "uk", "org", "*.ck", "!www.ck", "jp", "kobe.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "github.io", "io", "de")
ENDINGS = ("example.com", "co.uk", "shop.co.uk", "ck", "www.ck", "any.ck", "a.b.ck", "city.kawasaki.jp", "x.kawasaki.jp", "kobe.jp", "me.github.io", "unknown.zz", "DE")


# The domain of hosts made of an ending and up to two labels before it, by the table of rules.
@register("h4_suffix_rules", f"""WITH rules AS (SELECT r AS rule, starts_with(r, '!') AS exception, starts_with(r, '*.') AS wildcard, regexp_replace(r, '^(!|\\*\\.)', '') AS suffix FROM (SELECT unnest([{', '.join(repr(r) for r in RULES)}]) AS r)),
h AS (SELECT DISTINCT lower(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || page_id % 9 || '.' ELSE 'b.c' || page_id % 7 || '.' END || ([{', '.join(repr(e) for e in ENDINGS)}])[page_id % {len(ENDINGS)} + 1]) AS host FROM pages),
f AS (SELECT host, len(string_split(host, '.')) AS n, exception, len(string_split(suffix, '.')) + CASE WHEN wildcard THEN 1 WHEN exception THEN -1 ELSE 0 END AS size FROM h JOIN rules ON host = suffix OR ends_with(host, '.' || suffix)),
b AS (SELECT host, arg_max(size, (exception, size)) AS size FROM f WHERE size <= n GROUP BY host),
d AS (SELECT h.host, coalesce(size, 1) AS size, string_split(h.host, '.') AS labels FROM h LEFT JOIN b ON b.host = h.host)
SELECT page_id, CASE WHEN len(labels) > size THEN array_to_string(labels[-(size + 1):], '.') END AS domain FROM pages JOIN d ON d.host = lower(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || page_id % 9 || '.' ELSE 'b.c' || page_id % 7 || '.' END || ([{', '.join(repr(e) for e in ENDINGS)}])[page_id % {len(ENDINGS)} + 1])""")
def h4_rules(v):
    key = F.col("page_id")
    before = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.concat(F.lit("a"), (key % 9).cast("string"), F.lit("."))).otherwise(F.concat(F.lit("b.c"), (key % 7).cast("string"), F.lit(".")))
    ending = F.element_at(F.array(*(F.lit(e) for e in ENDINGS)), (key % len(ENDINGS)).cast("int") + 1)
    rules = v.pages.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    return domains.registrable(v.pages.select("page_id", F.concat(before, ending).alias("host")), rules).select("page_id", "domain")
