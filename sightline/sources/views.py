"""Domain views over the driver's tables, each defined once in SQL that Spark and DuckDB share.

In the texts ``{name}`` stands for a table or an earlier view. ``Views`` resolves them to DataFrames,
``with_views`` puts them before a query as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # A run checks a config's keywords in a month; status and subset flag follow the month.
    "rank_runs": """
SELECT config_id * 1000 + m AS run_id, config_id, m AS month_no, CASE WHEN m % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN m % 5 = 0 THEN true ELSE false END AS is_subset, min(o_orderdate) AS started_at, count(*) AS keywords_total
FROM (SELECT o_orderdate, o_custkey % 5 AS config_id, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS m FROM {orders}) t
GROUP BY config_id, m""",
    # One row per (run, keyword, device); a null position was checked and not found.
    "rank_snapshots": """
SELECT snapshot_id, run_id, config_id, keyword_id, device, position, checked_at FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id, keyword_id, device ORDER BY snapshot_id, checked_at, position) AS k FROM (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS snapshot_id, (o_custkey % 5) * 1000 + (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS run_id, o_custkey % 5 AS config_id,
   l_partkey % 50 AS keyword_id, CASE WHEN l_linestatus = 'O' THEN 'desktop' ELSE 'mobile' END AS device,
   CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_quantity AS INT) END AS position, l_shipdate AS checked_at
  FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey) a) b WHERE k = 1""",
    "rank_keywords": """
SELECT p_partkey % 50 AS keyword_id, min(lower(p_name)) AS keyword, CASE WHEN p_partkey % 50 % 9 = 0 THEN NULL ELSE sum(p_size) END AS search_volume,
 CAST(p_partkey % 50 * 2 AS INT) AS difficulty, min(p_retailprice) / 100 AS cpc FROM {part} GROUP BY p_partkey % 50""",
    "rank_configs": """
SELECT c_custkey AS config_id, c_custkey % 7 AS project_id, lower(c_name) AS domain, CASE WHEN c_acctbal < 0 THEN false ELSE true END AS is_active,
 CASE WHEN c_custkey % 3 = 0 THEN 'both' WHEN c_custkey % 3 = 1 THEN 'desktop' ELSE 'mobile' END AS devices, c_nationkey AS location_code,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS location_name, 10 * (1 + c_custkey % 10) AS depth FROM {customer}""",
    "projects": """
SELECT n_nationkey AS project_id, n_name AS name, n_regionkey AS organization_id, CASE WHEN n_nationkey % 6 = 5 THEN true ELSE false END AS archived FROM {nation}""",
    "saved_keywords": """
SELECT p_partkey AS id, p_partkey % 3 AS project_id, concat(lower(p_name), ' ', CAST(p_partkey AS STRING)) AS keyword, p_partkey % 4 AS location_code, p_type AS type, p_brand AS tag FROM {part}""",
    "keyword_metrics": """
SELECT s.project_id, s.keyword, s.location_code, CAST(coalesce(q.v, 0) AS BIGINT) AS search_volume, s.price / 100 AS cpc, s.size AS difficulty,
 CASE WHEN s.type LIKE '%BRASS%' THEN 'informational' WHEN s.type LIKE '%STEEL%' THEN 'commercial' ELSE 'transactional' END AS intent
FROM (SELECT p_partkey, p_partkey % 3 AS project_id, concat(lower(p_name), ' ', CAST(p_partkey AS STRING)) AS keyword, p_partkey % 4 AS location_code, p_retailprice AS price, p_size AS size, p_type AS type FROM {part} WHERE p_partkey % 7 <> 0) s
LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS v FROM {lineitem} GROUP BY l_partkey) q ON q.l_partkey = s.p_partkey""",
    "tags": "SELECT DISTINCT p_brand AS tag_id, lower(p_brand) AS name FROM {part} UNION ALL SELECT 'unused', 'unused'",
    "tag_assignments": "SELECT p_partkey AS keyword_id, p_brand AS tag_id FROM {part} WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'Brand#11' FROM {part} WHERE p_partkey % 10 = 1 AND p_brand <> 'Brand#11'",
    "search_rows": """
SELECT CAST(ts AS DATE) AS day, concat('q', CAST(event_id % 40 AS STRING)) AS query, concat('/p', CAST(user_id % 25 AS STRING)) AS page,
 sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, count(*) AS impressions, 1 + avg(value) / 10 AS position
FROM {events} GROUP BY CAST(ts AS DATE), event_id % 40, user_id % 25""",
    # Crawled pages with signals by page_id arithmetic, so that every check has hits and misses.
    "audit_pages": """
SELECT page_id AS id, concat('https://site.test/p', CAST(page_id AS STRING)) AS url, page_id % 3 AS audit_id,
 CASE WHEN page_id % 31 = 0 THEN 'blocked' WHEN page_id % 37 = 0 THEN 'error' ELSE 'ok' END AS fetch_class,
 CAST(CASE WHEN page_id % 31 = 0 THEN 403 WHEN page_id % 37 = 0 THEN 0 WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 41 = 0 THEN 503 WHEN page_id % 10 < 3 THEN 301 ELSE 200 END AS INT) AS status_code,
 CASE WHEN page_id % 10 < 3 THEN concat('https://site.test/p', CAST(CASE WHEN page_id % 10 = 2 AND page_id % 3 = 0 THEN page_id ELSE page_id + 1 END AS STRING)) END AS redirect_url,
 CASE WHEN page_id % 23 = 0 THEN '' WHEN page_id % 12 = 5 THEN regexp_extract(html, '<title>([^ <]*)', 1) WHEN page_id % 12 = 7 THEN concat(regexp_extract(html, '<title>([^<]*)', 1), ' ', regexp_extract(html, '<p>([^<]+)', 1)) ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title,
 CASE WHEN page_id % 4 = 0 THEN NULL ELSE regexp_extract(html, '<p>([^<]+)', 1) END AS meta_description,
 CASE WHEN page_id % 11 = 0 THEN concat('https://site.test/p', CAST(page_id % 50 AS STRING)) END AS canonical_url,
 CASE WHEN page_id % 22 = 0 THEN concat('https://site.test/p', CAST(page_id AS STRING)) END AS header_canonical_url,
 CASE WHEN page_id % 13 = 0 THEN false ELSE true END AS is_indexable, CASE WHEN page_id % 29 = 0 THEN false ELSE true END AS is_html,
 CAST(page_id % 19 % 3 AS INT) AS h1_count, CAST(length(html) % 400 AS INT) AS word_count, CASE WHEN page_id % 6 = 0 THEN concat('h', CAST(page_id % 12 AS STRING)) ELSE concat('u', CAST(page_id AS STRING)) END AS content_hash,
 CAST(page_id % 5 AS INT) AS images_total, CAST(CASE WHEN page_id % 8 = 0 THEN page_id % 5 ELSE 0 END AS INT) AS images_missing_alt,
 CAST(page_id % 15 % 4 AS INT) AS link_count, CASE WHEN page_id % 21 = 0 THEN NULL ELSE CAST(page_id % 7 AS INT) END AS crawl_depth,
 CASE WHEN page_id % 9 = 0 THEN NULL ELSE CAST(200 + page_id * 7 % 2000 AS INT) END AS response_ms FROM {pages}""",
    # The site crawled by three audits: most urls are in all of them, redirects differ, audit 2 links less.
    "audit_crawls": """
SELECT p.id * 3 + a AS id, p.url, a AS audit_id, p.fetch_class, CAST(CASE WHEN p.status_code = 200 AND (p.id + a) % 9 < 4 THEN 301 ELSE p.status_code END AS INT) AS status_code,
 CASE WHEN p.status_code BETWEEN 200 AND 399 AND (p.id + a) % 9 < 4 THEN concat('https://site.test/p', CAST(CASE WHEN (p.id + a) % 9 = 3 AND p.id % 5 = 0 THEN p.id - 2 WHEN p.id % 14 = 3 THEN p.id ELSE p.id + 1 END AS STRING)) END AS redirect_url,
 p.title, p.meta_description, p.canonical_url, p.header_canonical_url, p.is_indexable, p.word_count, p.content_hash
FROM {audit_pages} p CROSS JOIN (SELECT 0 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) audits WHERE (p.id + a) % 7 <> 0""",
    "audit_links": """
SELECT page_id AS source_page_id, page_id % 3 AS audit_id, concat('https://site.test/p', CAST(page_id AS STRING)) AS source_url,
 concat('https://site.test/p', CAST(page_id * k % 211 AS STRING)) AS target_url, concat('a', CAST(k AS STRING)) AS anchor, CASE WHEN k = 7 THEN false ELSE true END AS is_internal
FROM {pages} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 7) ks""",
    "crawl_links": """
SELECT l.source_page_id * 3 + a AS source_page_id, a AS audit_id, l.source_url, l.target_url, l.is_internal
FROM {audit_links} l CROSS JOIN (SELECT 0 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) audits WHERE (l.source_page_id + a) % 7 <> 0 AND NOT (a = 2 AND l.source_page_id % 3 = 0)""",
    "lighthouse": """
SELECT page_id, page_id % 3 AS audit_id, CASE WHEN page_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS strategy, CASE WHEN page_id % 14 = 0 THEN 'timed out' END AS error_message,
 CASE WHEN page_id % 14 = 0 OR page_id % 10 = 3 THEN NULL ELSE CAST(page_id * 37 % 101 AS INT) END AS performance_score,
 CASE WHEN page_id % 14 = 0 OR page_id % 10 = 3 THEN NULL ELSE CAST(page_id * 53 % 101 AS INT) END AS seo_score,
 CASE WHEN page_id % 14 = 0 THEN NULL ELSE page_id * 31 % 6000 END AS lcp_ms FROM {pages} WHERE page_id % 4 < 2""",
    # Observations: few title words, so that near and cross-platform duplicates occur.
    "observations": """
SELECT concat('o', CAST(doc_id AS STRING)) AS obs_id, CAST(doc_id % 5 AS INT) AS project_id, source AS connection_id, CASE WHEN doc_id % 40 = 3 THEN 'x1' ELSE concat('x', CAST(doc_id AS STRING)) END AS external_id,
 concat('web', CAST(doc_id % 3 AS STRING)) AS platform, CASE WHEN doc_id % 9 = 0 THEN concat('https://n.test/', CAST(doc_id % 20 AS STRING)) ELSE '' END AS canonical_url,
 regexp_replace(lower(regexp_extract(text, '^[^.\\n]*', 0)), '[^a-z ]', ' ', 'g') AS title, lang AS language,
 CASE doc_id % 5 WHEN 0 THEN 'first_party_observed' WHEN 1 THEN 'community_observed' WHEN 2 THEN 'search_observed' WHEN 3 THEN 'primary_authoritative' ELSE 'generated_candidate' END AS source_class,
 CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('geo', CAST(doc_id % 4 AS STRING)) END AS geography, CASE WHEN doc_id % 8 = 7 THEN true ELSE false END AS baseline,
 CASE WHEN doc_id % 16 = 5 THEN NULL ELSE CAST(doc_id % 700 AS BIGINT) END AS published_hour, CAST(doc_id AS BIGINT) AS collected_hour, concat('fam', CAST(doc_id % 12 AS STRING)) AS family_id FROM {documents}""",
    "backlinks": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, s_suppkey AS domain_id, concat('www.', lower(replace(s_name, '#', '')), '.test') AS domain_from, concat('https://www.', lower(replace(s_name, '#', '')), '.test/', CAST(l_partkey AS STRING)) AS url_from,
 concat('https://site.test/p', CAST(l_partkey % 60 AS STRING)) AS url_to, CAST(l_quantity AS INT) AS rank, CAST(floor(s_acctbal / 100) AS INT) AS domain_rank, CAST(floor(l_tax * 1000 + 0.5) AS INT) AS spam_score,
 CASE WHEN l_returnflag = 'R' THEN false ELSE true END AS dofollow, CASE WHEN l_returnflag = 'A' THEN true ELSE false END AS is_lost, CASE WHEN l_linenumber = 5 THEN true ELSE false END AS is_broken, CAST(l_shipdate AS DATE) AS first_seen
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "mentions": """
SELECT conv_id * 100 + turn AS id, CASE WHEN role = 'user' THEN 'chat_gpt' ELSE 'google' END AS platform, concat('brand', CAST(conv_id % 6 AS STRING)) AS brand, text AS question,
 CASE WHEN conv_id % 5 = 0 THEN NULL ELSE CAST(length(text) % 100 AS BIGINT) END AS volume, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE CAST(turn + 1 AS BIGINT) END AS mentions,
 concat('https://src', CAST(conv_id % 9 AS STRING), '.test/', CAST(turn AS STRING)) AS source_url, CAST(2023 + conv_id % 2 AS INT) AS year, CAST(1 + turn % 12 AS INT) AS month FROM {conversations}""",
}
_HOLE = re.compile(r"\{(\w+)\}")


class Views:
    """DataFrames of the driver's tables and of the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            sources = {hole: getattr(self, hole) for hole in set(_HOLE.findall(VIEWS[name]))}
            text = VIEWS[name].replace(", 'g')", ")")  # Spark's regexp_replace replaces all occurrences
            frame = self._spark.sql(text, **sources)
        else:
            frame = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        setattr(self, name, frame)
        return frame


def with_views(sql: str) -> str:
    """DuckDB SQL: the views before a query that names them like tables."""
    used, todo = {}, [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used[name] = body
                todo.append(" ".join(f"{h}" for h in _HOLE.findall(body)))
    order = [n for n in VIEWS if n in used]
    ctes = ", ".join(f"{n} AS ({_HOLE.sub(lambda m: m[1], VIEWS[n])})" for n in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if own:
        return f"WITH RECURSIVE {ctes}{', ' if ctes else ''}{sql[own.end():]}"
    return f"WITH {ctes} {sql}" if ctes else sql
