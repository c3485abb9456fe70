"""AI visibility and backlinks: share of voice, cited sources, top queries, link profiles and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expr import all_of, brand_pattern, half_up, range_filter, split_terms, text_filter


def share_of_voice(mentions: DataFrame, keys: DataFrame, target: str) -> DataFrame:
    """(label, is_target, mentions, share_pct) of every requested key, most mentions first.

    Keys without data keep null mentions and a null share; the share's denominator is the sum of
    known mentions, and shares are null if that is not positive. ``mentions`` has key and mentions.
    """
    known = mentions.groupBy(F.lower("key").alias("_k")).agg(F.sum(half_up("mentions")).alias("mentions"))
    rows = keys.withColumn("_k", F.lower("label")).join(known, "_k", "left")
    total = F.coalesce(F.sum("mentions").over(Window.partitionBy()), F.lit(0))
    share = F.when((total > 0) & F.col("mentions").isNotNull(), F.col("mentions") / total * 100)
    return rows.select("label", (F.col("_k") == target.lower()).alias("is_target"), F.col("mentions").cast("long").alias("mentions"), share.alias("share_pct"))


def platform_totals(rows: DataFrame, locale_matches: bool, limited: str = "chat_gpt") -> DataFrame:
    """Null-preserving totals; a platform that serves one locale only counts where the locale matches."""
    kept = rows if locale_matches else rows.where(F.col("platform") != limited)
    return kept.agg(F.sum(half_up("mentions")).cast("long").alias("mentions"), F.sum(half_up("volume")).cast("long").alias("volume"))


def top_per_platform(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each platform by an order that ends in an id."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("platform").orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def cited_sources(mentions: DataFrame, per_platform: int = 10, questions: int = 5) -> DataFrame:
    """Cited pages of each platform with mentions, volume and their top questions; null volumes sort as 0."""
    safe = mentions.where(F.col("source_url").rlike(r"^https?://[^/@\s]+"))
    examples = safe.where("question <> ''").groupBy("platform", "source_url", "question").agg(F.min_by("volume", "id").alias("volume"))
    window = Window.partitionBy("platform", "source_url").orderBy(F.coalesce("volume", F.lit(0)).desc(), "question")
    top = examples.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= questions)
    lists = top.groupBy("platform", "source_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "question"))), lambda x: x["question"]).alias("questions"))
    pages = safe.groupBy("platform", "source_url").agg(F.sum("mentions").alias("mentions"), F.sum("volume").alias("volume"))
    order = [F.coalesce("volume", F.lit(0)).desc(), F.coalesce("mentions", F.lit(0)).desc(), F.col("source_url")]
    return top_per_platform(pages, order, per_platform).join(lists, ["platform", "source_url"], "left")


def top_queries(mentions: DataFrame, per_platform: int = 25) -> DataFrame:
    """The questions of most volume of each platform."""
    return top_per_platform(mentions.where("question <> ''"), [F.coalesce("volume", F.lit(0)).desc(), F.col("id")], per_platform)


def monthly_volume(mentions: DataFrame, last: int = 12) -> DataFrame:
    """Volumes summed by month over all mentions, the last months in order."""
    sums = mentions.where("volume is not null").groupBy("year", "month").agg(half_up(F.sum("volume")).cast("long").alias("volume"))
    return sums.orderBy(F.desc("year"), F.desc("month")).limit(last).orderBy("year", "month")


def filter_sources(rows: DataFrame, include: str = "", exclude: str = "", platform: str = "", mentions=(None, None)) -> DataFrame:
    """Any include term in the url and questions, no exclude term, a platform, mentions in a range that null passes."""
    text = F.concat_ws(" ", "source_url", F.array_join(F.coalesce("questions", F.array().cast("array<string>")), " "))
    return rows.where(all_of(text_filter(text, split_terms(include), split_terms(exclude), "any"), F.col("platform") == platform if platform else None, range_filter("mentions", *mentions, nulls="pass")))


def brand_mentions(rows: DataFrame, text: str, brand: str) -> DataFrame:
    """Whether a text names a brand as a word, whatever signs the brand ends in."""
    return rows.withColumn("mentioned", F.coalesce(F.col(text).rlike(brand_pattern(brand)), F.lit(False)))


def backlink_filter(rows: DataFrame, include: str = "", exclude: str = "", domain_rank=(None, None), rank=(None, None), spam=(None, None), dofollow: bool | None = None, hide_lost: bool = False, hide_broken: bool = False, domain: str = "") -> DataFrame:
    """Backlink rows: any include term in the source url, no exclude term, ranges, and link states."""
    return rows.where(
        all_of(
            text_filter("url_from", split_terms(include), split_terms(exclude), "any"),
            range_filter("domain_rank", *domain_rank),
            range_filter("rank", *rank),
            range_filter("spam_score", *spam),
            None if dofollow is None else F.col("dofollow") == dofollow,
            ~F.col("is_lost") if hide_lost else None,
            ~F.col("is_broken") if hide_broken else None,
            F.col("domain_from") == domain if domain else None,
        )
    )


def referring_domains(links: DataFrame) -> DataFrame:
    """Domains with their links, best rank and mean spam."""
    return links.groupBy("domain_from").agg(F.count(F.lit(1)).alias("backlinks"), F.max("domain_rank").alias("rank"), F.avg("spam_score").alias("spam_score"), F.min("first_seen").alias("first_seen"))


def linked_pages(links: DataFrame) -> DataFrame:
    """Own pages with their links and referring domains."""
    return links.groupBy("url_to").agg(F.count(F.lit(1)).alias("backlinks"), F.countDistinct("domain_from").alias("referring_domains"), F.max("rank").alias("rank"))


def link_history(links: DataFrame, last_day: Column, days: int = 365) -> DataFrame:
    """New and lost links by month of the year that ends on a day."""
    rows = links.where((F.col("first_seen") <= last_day) & (F.col("first_seen") > F.date_sub(last_day, days)))
    lost = F.count(F.when(F.col("is_lost"), 1))
    return rows.groupBy(F.trunc("first_seen", "month").alias("month")).agg((F.count(F.lit(1)) - lost).alias("new_links"), lost.alias("lost_links"))


def with_ratings(domains: DataFrame, ratings: DataFrame) -> DataFrame:
    """Domain ratings by host without ``www.``."""
    key = F.regexp_replace(F.lower("domain_from"), r"^www\.", "")
    return domains.withColumn("_h", key).join(ratings, F.col("_h") == F.col("host"), "left").drop("_h", "host")


def fresh_snapshots(snapshots: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The latest snapshot of each project by id, and whether it is younger than so many hours."""
    last = snapshots.groupBy("project_id").agg(F.max_by(F.struct("id", "taken_at"), "id").alias("s")).select("project_id", "s.*")
    return last.withColumn("fresh", (F.unix_micros(now) - F.unix_micros(F.col("taken_at").cast("timestamp"))) < hours * 3_600_000_000)
