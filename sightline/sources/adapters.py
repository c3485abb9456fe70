"""Provider records to one schema: JSON texts as VARIANT, read by paths of each source.

A record's kind of trouble is told in ``status`` and no record is lost: malformed (no JSON, or without what
names it), skipped (by the source's own rules), repeated (a later record of the same name) or observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import urls

# Classes and names of the sources.
SEARCH, COMMUNITY = "gsc", "hacker_news"
ITEM_URL = "https://news.ycombinator.com/item?id="


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("_v", path, kind)


def _text(*paths: str) -> Column:
    """The first of several paths that holds a text that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(_get(p, "string")), F.lit("")) for p in paths))


def observations(records: DataFrame, minimum_score: int = 0) -> DataFrame:
    """(source, record_no, status, external_id, source_class, title, canonical_url, outbound_url, published, views, score, comments) of every record.

    ``records``: source, record_no (long, distinct in a source), payload (JSON text), collected (timestamp). Search rows have
    keys [query, page], impressions and clicks; they are named by query and canonical page and published when
    collected. Community items have id, type, title, time, score, descendants and url; only stories with title
    and time that are neither deleted nor dead and reach ``minimum_score`` are observed. Other sources are malformed.
    The first record of a name, by record_no, is observed.
    """
    parsed = records.select("source", "record_no", "collected", F.try_parse_json("payload").alias("_v"))
    search, item = F.col("source") == SEARCH, F.col("source") == COMMUNITY
    page = urls.canonical_url(F.when(search, _text("$.keys[1]")))
    rows = parsed.withColumns({"_query": F.when(search, _text("$.keys[0]")), "_page": page, "_id": F.when(item, _get("$.id", "long"))})
    score = _get("$.score", "long")
    rows = rows.select(
        "source", "record_no",
        F.when(search, F.concat(F.lit("gsc:"), "_query", F.lit(":"), "_page")).when(item, F.concat(F.lit("hn:"), F.col("_id").cast("string"))).alias("external_id"),
        F.when(search, "search_observed").when(item, "community_observed").alias("source_class"),
        F.when(search, F.col("_query")).when(item, _text("$.title")).alias("title"),
        F.when(search, F.col("_page")).when(item, F.concat(F.lit(ITEM_URL), F.col("_id").cast("string"))).alias("canonical_url"),
        F.when(item, _text("$.url")).alias("outbound_url"),
        F.when(search, F.col("collected")).when(item, F.timestamp_seconds(_get("$.time", "long"))).alias("published"),
        F.when(search, _get("$.impressions", "long")).alias("views"),
        F.when(item, score).alias("score"),
        F.when(item, _get("$.descendants", "long")).alias("comments"),
        F.coalesce(F.when(item, (_get("$.type", "string") != "story") | F.coalesce(_get("$.deleted", "boolean"), F.lit(False)) | F.coalesce(_get("$.dead", "boolean"), F.lit(False)) | (F.coalesce(score, F.lit(0)) < minimum_score)), F.lit(False)).alias("_skip"),
    )
    skipped = F.col("_skip") | F.col("title").isNull() | F.col("published").isNull()
    rows = rows.withColumn("status", F.when(F.col("external_id").isNull(), "malformed").when(skipped, "skipped").otherwise("observed"))
    first = rows.where("status = 'observed'").groupBy(F.col("source").alias("_s"), F.col("external_id").alias("_e")).agg(F.min("record_no").alias("_first"))
    joined = rows.join(first, (F.col("status") == "observed") & (F.col("source") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left")
    status = F.when((F.col("status") == "observed") & (F.col("record_no") != F.col("_first")), "repeated").otherwise(F.col("status"))
    return joined.select("source", "record_no", status.alias("status"), "external_id", "source_class", "title", "canonical_url", "outbound_url", "published", "views", "score", "comments")


#: Columns of backlink records: name, type, and the paths of which the first present one counts.
BACKLINK = (
    ("domain_from", "string", ("domain_from",)), ("url_from", "string", ("url_from",)), ("url_to", "string", ("url_to",)), ("anchor", "string", ("anchor",)), ("is_dofollow", "boolean", ("dofollow",)),
    ("rank", "long", ("rank",)), ("spam_score", "long", ("backlink_spam_score", "backlinks_spam_score")), ("first_seen", "string", ("first_seen",)), ("last_seen", "string", ("lost_date", "last_visited")), ("links_count", "long", ("links_count",)),
)


def backlink_rows(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Backlink records (payload, and columns to keep) as rows: missing fields are null, attributes an empty list; lost if said so or with a date of loss; not broken by default. ``malformed`` tells texts that are no JSON."""
    rows = records.select(*keep, F.try_parse_json("payload").alias("_v"))
    first = lambda kind, paths: F.coalesce(*(_get(f"$.{p}", kind) for p in paths))
    attributes = F.coalesce(first("array<string>", ("rel_attributes", "attributes")), F.array().cast("array<string>"))
    lost = F.coalesce(_get("$.is_lost", "boolean"), F.coalesce(_get("$.lost_date", "string"), F.lit("")) != "")
    broken = F.coalesce(_get("$.is_broken", "boolean"), F.lit(False))
    return rows.select(*keep, *(first(kind, paths).alias(name) for name, kind, paths in BACKLINK), attributes.alias("rel_attributes"), lost.alias("is_lost"), broken.alias("is_broken"), F.col("_v").isNull().alias("malformed"))
