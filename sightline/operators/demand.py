"""Demand evidence: duplicates among observations, events, families, coverage, scores and the feed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.expr import clamp01, digest_id, freshness, half_up, hours_between
from sightline.functions.text import jaccard, title_tokens
from sightline.operators.graph import FEW, components

VERSION = "evidence-v1"
# Weights of the 13 positive signals, of the 6 penalties, and of confidence; each sums to 1.
POSITIVE = {"cross_source_diversity": 0.12, "commercial_proximity": 0.12, "first_party_corroboration": 0.11, "search_corroboration": 0.09, "normalized_velocity": 0.09, "recurrence": 0.09, "coverage_gap": 0.08, "source_reliability": 0.07, "icp_fit": 0.07, "persistence": 0.05, "ai_surface_corroboration": 0.05, "decision_clarity": 0.04, "trend_acceleration": 0.02}
PENALTY = {"spam_risk": 0.25, "legal_retention_risk": 0.2, "cannibalization_risk": 0.15, "staleness_risk": 0.15, "source_concentration_risk": 0.1, "uncertainty": 0.15}
CONFIDENCE = {"cross_source_diversity": 0.22, "first_party_corroboration": 0.18, "search_corroboration": 0.16, "recurrence": 0.14, "source_reliability": 0.14, "persistence": 0.1}
# Most points of the 100-point factors, points of the penalties, and band bounds.
POINTS = {"geography": 20, "corroboration": 20, "freshness": 15, "usefulness": 15, "coverage_gap": 10, "citation": 10, "commercial": 10}
DEDUCTIONS = {"compliance_uncertainty": 30, "weak_provenance": 20, "cannibalization": 20, "no_original_contribution": 10, "unowned_maintenance": 10, "vanity": 15}
SHIP, VALIDATE, MONITOR = 75, 60, 45
# Similarity thresholds and windows of duplicates.
CROSS_POST, SAME, NEAR = 0.78, 0.86, 0.70
CROSS_HOURS, NEAR_HOURS = 14 * 24, 72
MATCH_THRESHOLD, STALE = 0.34, 0.5
#: Different token sets of needles, and of intents, in a block that is compared all with all.
BLOCK = 20_000
# What to do about a covered asset, and the order of kinds on ties.
ACTIONS = {"page": "update_existing_page", "supporting_page": "update_existing_page", "faq": "add_faq", "tool": "create_tool", "troubleshooter": "create_troubleshooter", "product_or_offer": "update_product_or_offer", "support_article": "create_support_article"}
KINDS = ("page", "product_or_offer", "support_article", "faq", "troubleshooter", "tool", "supporting_page")
# Retention days by source class (raw content, excerpt, derived features), and by platform.
RETENTION = {"primary_authoritative": (365, 730, 1095), "first_party_observed": (365, 730, 1095), "search_observed": (90, 180, 730), "community_observed": (30, 90, 730), "market_event_observed": (180, 365, 1095), "ai_surface_observed": (90, 180, 730), "generated_candidate": (30, 90, 365)}
PLATFORM_RETENTION = {"reddit": (7, 30, 365)}
CLASS_FLAGS = {"has_first_party": "first_party_observed", "has_primary": "primary_authoritative", "has_search": "search_observed", "has_community": "community_observed", "has_ai_surface": "ai_surface_observed"}


def observation_id(platform="platform", connection="connection_id", external="external_id", url="canonical_url") -> Column:
    return digest_id("obs", VERSION, platform, connection, external, url)


def candidate_pairs(obs: DataFrame, every: bool = False) -> DataFrame:
    """(a, b, record_size, url_size, title_size) of a family's rows that could be duplicates: one record id, one canonical url, or similar enough titles near in time.

    Groups of equal rows are stars: rows of equal record ids, of equal urls, and of equal titles (as sets of
    tokens) of one platform and time are paired with the first of their group, whose size is given. The first
    rows of the title groups stand for all further comparisons of titles, which are linear in a hot title:
    each is linked with the one before it on its platform and with the nearest ones of other platforms
    before and after it. Two rows of a title that are near enough are connected by such links: between two
    rows of different platforms lie only nearer ones. Different titles are compared once for each two, where
    they share a token of a prefix within two-week buckets: tokens by rarity within the family, of which a
    title of n needs n - ceil(0.7 n) + 1 for similarity 0.7.

    ``obs`` have obs_id, family_id, connection_id, external_id, url_key (null if there is no valid
    url), platform, tokens and published (timestamp). With a boolean column ``fresh``, only pairs that the
    fresh rows add to those of the others are returned: enough to connect them with components that are known.
    With ``every``, the first rows of the groups of one title are paired as well as those of different ones, all that are near
    enough in time, where links of neighbours would do to connect them.
    """
    obs = obs if "fresh" in obs.columns else obs.withColumn("fresh", F.lit(True))
    obs = obs.select("family_id", "obs_id", "fresh", "connection_id", "external_id", "url_key", "platform", "published", F.array_join(F.array_sort("tokens"), " ").alias("title"))
    none = F.lit(None).cast("long")
    sizes = ("record_size", "url_size", "title_size")

    def equal(size: str, *keys: str) -> DataFrame:
        """Each row with the first of its equal keys, and their number; of rows that are not fresh only their first, if a fresh one precedes it."""
        rows = obs.select("family_id", "obs_id", "fresh", *keys)
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        known = F.min(F.when(~F.col("fresh"), F.col("obs_id")))
        groups = rows.groupBy("family_id", *keys).agg(F.min("obs_id").alias("a"), F.count(F.lit(1)).alias("size"), known.alias("known")).where("size > 1")
        stars = rows.join(groups.hint("merge"), ["family_id", *keys]).where("obs_id <> a AND (fresh OR obs_id = known)")
        return stars.select("a", F.col("obs_id").alias("b"), *((F.col("size") if s == size else none).alias(s) for s in sizes))

    cells = obs.where("published IS NOT NULL").groupBy("family_id", "title", "platform", "published").agg(F.min("obs_id").alias("obs_id"), F.min_by("fresh", "obs_id").alias("fresh"))
    # A title is named by the first of its rows: what is sorted and joined below are ids, not texts.
    cells = cells.withColumn("name", F.min("obs_id").over(Window.partitionBy("family_id", "title")))
    texts = cells.where("obs_id = name").select("family_id", F.col("obs_id").alias("title"), F.split("title", " ").alias("tokens")).where("tokens[0] <> ''")
    cells = cells.drop("title").withColumnRenamed("name", "title")
    near = (title_pairs(cells) if every else title_links(cells)).unionByName(_similar_titles(cells, texts)).where("fresh").select("a", "b", *(none.alias(s) for s in sizes))
    pairs = equal("record_size", "connection_id", "external_id").unionByName(equal("url_size", "url_key")).unionByName(equal("title_size", "title", "platform", "published")).unionByName(near)
    return pairs.groupBy("a", "b").agg(*(F.max(s).alias(s) for s in sizes))


def title_links(cells: DataFrame) -> DataFrame:
    """(a, b, fresh): rows of one title with their neighbours in time, on their platform and on others, whatever the distance."""
    whole = Window.partitionBy("family_id", "title")
    links = cells
    for name, order in (("before", (F.col("published"), F.col("platform"))), ("after", (F.col("published").desc(), F.col("platform").desc()))):
        row = whole.orderBy(*order)
        last, other = F.lag(F.struct("obs_id", "fresh")).over(row), F.lag("platform").over(row)
        links = links.withColumn("_at", F.when(other != F.col("platform"), last)).withColumn(name, F.last("_at", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    links = links.withColumn("same", F.lag(F.struct("obs_id", "fresh")).over(Window.partitionBy("family_id", "title", "platform").orderBy("published")))
    rows = links.select("obs_id", "fresh", F.explode(F.array("before", "after", "same")).alias("o")).where("o IS NOT NULL")
    return rows.select(F.least("obs_id", "o.obs_id").alias("a"), F.greatest("obs_id", "o.obs_id").alias("b"), (F.col("fresh") | F.col("o.fresh")).alias("fresh")).distinct()


def title_pairs(cells: DataFrame) -> DataFrame:
    """(a, b, fresh): every two rows of one title within the wider window, or on one platform within the narrower."""
    hours = F.abs(F.unix_seconds("published") - F.unix_seconds("published_y")) / 3600
    timed = cells.withColumn("bucket", F.floor(F.unix_seconds("published") / (CROSS_HOURS * 3600)))
    after = timed.select("family_id", "title", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), F.col("bucket").alias("bucket_y"), F.col("obs_id").alias("b"), F.col("platform").alias("platform_y"), F.col("published").alias("published_y"), F.col("fresh").alias("fresh_y"))
    met = timed.join(after.hint("merge"), ["family_id", "title", "bucket"]).where((F.col("bucket") < F.col("bucket_y")) | (F.col("obs_id") < F.col("b")))
    met = met.where(hours <= F.when(F.col("platform") == F.col("platform_y"), NEAR_HOURS).otherwise(CROSS_HOURS))
    return met.select(F.least("obs_id", "b").alias("a"), F.greatest("obs_id", "b").alias("b"), (F.col("fresh") | F.col("fresh_y")).alias("fresh"))


def _similar_titles(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, fresh) of the rows of two different titles that are similar by ``NEAR`` or more, within the wider window. ``texts`` have the tokens of each title."""
    timed = cells.withColumn("bucket", F.floor(F.unix_seconds("published") / (CROSS_HOURS * 3600)))
    places = timed.groupBy("family_id", "title", "bucket").agg(F.bool_or("fresh").alias("fresh"))
    tokens = texts.select("family_id", "title", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rarity = tokens.groupBy("family_id", "token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(rarity.where("df > 1").hint("merge"), ["family_id", "token"], "left").withColumn("k", F.row_number().over(Window.partitionBy("family_id", "title").orderBy(F.coalesce("df", F.lit(1)), "token")))
    # A token of one title alone takes a place in its prefix, but meets nothing.
    prefix = ranked.where((F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(NEAR) - 1e-9) + 1) & (F.col("df") > 1)).select("family_id", "title", "n", "token")
    keyed = prefix.join(places.hint("merge"), ["family_id", "title"])
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))
    left, right = side(keyed, "x"), side(keyed.withColumn("near", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1, F.col("bucket") - 1))), "y")
    met = left.join(right.hint("merge"), (F.col("family_id_x") == F.col("family_id_y")) & (F.col("token_x") == F.col("token_y")) & (F.col("bucket_x") == F.col("near_y")) & (F.col("title_x") < F.col("title_y")))
    met = met.where((F.col("fresh_x") | F.col("fresh_y")) & (F.least("n_x", "n_y") >= F.lit(NEAR) * F.greatest("n_x", "n_y") - 1e-9)).select("title_x", "bucket_x", "title_y", "bucket_y").distinct()
    named = texts.select("title", "tokens")
    alike = met.join(side(named, "x").hint("merge"), "title_x").join(side(named, "y").hint("merge"), "title_y").where(jaccard(F.col("tokens_x"), F.col("tokens_y")) >= NEAR).drop("tokens_x", "tokens_y")
    rows = timed.select("title", "bucket", "obs_id", "published", "fresh")
    pairs = alike.join(side(rows, "x").hint("merge"), ["title_x", "bucket_x"]).join(side(rows, "y").hint("merge"), ["title_y", "bucket_y"])
    pairs = pairs.where((F.abs(F.unix_seconds("published_x") - F.unix_seconds("published_y")) <= CROSS_HOURS * 3600))
    return pairs.select(F.least("obs_id_x", "obs_id_y").alias("a"), F.greatest("obs_id_x", "obs_id_y").alias("b"), (F.col("fresh_x") | F.col("fresh_y")).alias("fresh"))


def relation() -> Column:
    """exact, canonical, syndicated, semantic or null, of a pair of observations ``x`` and ``y`` with ``similarity``."""
    same = F.col("x.platform") == F.col("y.platform")
    hours, s = hours_between("x.published", "y.published"), F.col("similarity")
    return (
        F.when((F.col("x.connection_id") == F.col("y.connection_id")) & (F.col("x.external_id") == F.col("y.external_id")), "exact")
        .when(F.col("x.url_key") == F.col("y.url_key"), "canonical")
        .when(~same & (s >= CROSS_POST) & (hours <= CROSS_HOURS), "syndicated")
        .when(same & (s >= SAME) & (hours <= NEAR_HOURS), "exact")
        .when(same & (s >= NEAR) & (s < SAME) & (hours <= NEAR_HOURS), "semantic")
    )


def duplicate_edges(obs: DataFrame, every: bool = False) -> DataFrame:
    """(a, b, relation, similarity, group_size) of the duplicates: rows of equal records, urls or titles at one time with the
    first of their group (similarity 1, and the group's size), and the pairs of ``candidate_pairs`` that are related by their titles.
    These connect what all pairs would; with ``every`` they are all related pairs of the first rows of groups, of one title or of two."""
    pairs = candidate_pairs(obs, every)
    read = F.struct("connection_id", "external_id", "url_key", "platform", "published", "tokens")
    x, y = obs.select(F.col("obs_id").alias("a"), read.alias("x")), obs.select(F.col("obs_id").alias("b"), read.alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").withColumn("similarity", jaccard(F.col("x.tokens"), F.col("y.tokens"))).withColumn("relation", relation())
    certain = ((F.col("x.connection_id") == F.col("y.connection_id")) & (F.col("x.external_id") == F.col("y.external_id"))) | F.coalesce(F.col("x.url_key") == F.col("y.url_key"), F.lit(False))
    size = F.coalesce("record_size", "url_size", "title_size")
    told = both.where(F.col("relation").isNotNull() & (~certain | size.isNotNull()))
    return told.select("a", "b", "relation", F.when(certain, 1.0).otherwise(half_up("similarity", 4)).alias("similarity"), size.alias("group_size"))


def event_parts(keyed: DataFrame) -> DataFrame:
    """What is known of each (family_id, root): the anchor's order key, counts, sets, dates and flags; parts of one event can be merged."""
    order = F.struct(F.coalesce(F.col("collected").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("collected"), F.col("obs_id"))
    return keyed.groupBy("family_id", "root").agg(
        F.min(order).alias("anchor"),
        F.count(F.lit(1)).alias("raw_count"),
        F.collect_set("source_class").alias("source_classes"),
        F.collect_set("connection_id").alias("connections"),
        F.collect_set(F.when(F.trim("geography") != "", F.col("geography"))).alias("geographies"),
        F.min("published").alias("first_observed"),
        F.max("published").alias("last_observed"),
        F.bool_and("baseline").alias("baseline_only"),
        F.bool_or((F.col("source_class") != "generated_candidate") & ~F.col("baseline")).alias("promotable"),
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """One part for each (family_id, root) of several."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return parts.groupBy("family_id", "root").agg(
        F.min("anchor").alias("anchor"),
        F.sum("raw_count").alias("raw_count"),
        *(union(c) for c in ("source_classes", "connections", "geographies")),
        F.min("first_observed").alias("first_observed"),
        F.max("last_observed").alias("last_observed"),
        F.bool_and("baseline_only").alias("baseline_only"),
        F.bool_or("promotable").alias("promotable"),
    )


def finished_events(parts: DataFrame) -> DataFrame:
    """Events of whole parts, named by their anchor."""
    sets = (F.sort_array(c).alias(c) for c in ("source_classes", "connections", "geographies"))
    return parts.select("family_id", F.col("anchor.obs_id").alias("event_anchor"), "raw_count", *sets, "first_observed", "last_observed", "baseline_only", "promotable")


def evidence_events(obs: DataFrame, edges: DataFrame) -> DataFrame:
    """One event per component of duplicates: anchor, members' number, classes, connections, geographies, dates, baseline.

    The anchor is the member collected first (then the smallest id), so late evidence doesn't
    re-key an event. Dates ignore what is unknown.
    """
    roots = components(edges, few=FEW)
    keyed = obs.join(roots, F.col("obs_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "obs_id"))
    return finished_events(event_parts(keyed))


def family_evidence(events: DataFrame) -> DataFrame:
    """Evidence by family: independent events, raw count, class flags, dates, geographies, generated-only, baseline-only, promotable."""
    has = lambda c: F.bool_or(F.array_contains("source_classes", c))
    only = F.forall("source_classes", lambda c: c == "generated_candidate")
    return events.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("raw_count").alias("raw_count"),
        *(has(c).alias(name) for name, c in CLASS_FLAGS.items()),
        F.bool_and(only).alias("generated_only"),
        F.bool_and("baseline_only").alias("baseline_only"),
        F.bool_or("promotable").alias("promotable"),
        F.min("first_observed").alias("first_observed"),
        F.max("last_observed").alias("last_observed"),
        F.size(F.array_distinct(F.flatten(F.collect_set("geographies")))).cast("long").alias("geography_count"),
    )


def geography_signal() -> Column:
    return F.when(F.col("geography_count") >= 2, 1.0).when(F.col("geography_count") == 1, 0.5).otherwise(0.0)


def with_vector(evidence: DataFrame) -> DataFrame:
    """Default factors and penalties from evidence; columns that exist already override them."""
    defaults = {
        "geography": geography_signal(),
        "corroboration": clamp01(F.col("events") / 3),
        "usefulness": F.when(F.col("has_first_party") | F.col("has_search"), 0.6).otherwise(0.3),
        "citation": F.when(F.col("has_primary"), 0.8).when(F.col("has_search"), 0.4).otherwise(0.0),
        "commercial": F.lit(0.0),
        "freshness": F.lit(0.0),
        "coverage_gap": F.lit(0.0),
        "weak_provenance": F.col("generated_only"),
        "cannibalization": F.coalesce(F.col("cannibalization_risk") >= 0.5, F.lit(False)) if "cannibalization_risk" in evidence.columns else F.lit(False),
    } | {c: F.lit(False) for c in ("compliance_uncertainty", "no_original_contribution", "unowned_maintenance", "vanity")}
    return evidence.withColumns({c: F.coalesce(F.col(c), x) if c in evidence.columns else x for c, x in defaults.items()})


def points_score(rows: DataFrame, block: str | None = None) -> DataFrame:
    """100-point model: factors rounded, summed and capped, fixed deductions, band by unrounded priority; a block rejects."""
    total = lambda parts: sum(parts[1:], parts[0])
    positive = F.least(F.lit(100.0), total([half_up(clamp01(c) * m, 2) for c, m in POINTS.items()]))
    penalty = total([F.when(F.col(c), float(m)).otherwise(0.0) for c, m in DEDUCTIONS.items()])
    blocked = F.col("compliance_uncertainty") if block is None else F.col("compliance_uncertainty") | F.coalesce(F.col(block), F.lit(False))
    rows = rows.withColumn("_pos", positive).withColumn("_pen", penalty).withColumn("_pri", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_pos") - F.col("_pen")))).withColumn("blocked", blocked)
    band = F.when(F.col("blocked"), "reject").when(F.col("_pri") >= SHIP, "ship_now").when(F.col("_pri") >= VALIDATE, "validate_next").when(F.col("_pri") >= MONITOR, "monitor").otherwise("reject")
    sure = clamp01(0.35 * clamp01("corroboration") + 0.25 * clamp01("citation") + 0.2 * clamp01("geography") + F.when(F.col("compliance_uncertainty"), 0.0).otherwise(0.2))
    return rows.withColumns({"positive_score": half_up("_pos", 2), "penalty_score": half_up("_pen", 2), "priority": half_up("_pri", 2), "confidence": half_up(sure, 4), "band": band}).drop("_pos", "_pen", "_pri")


def signal_score(rows: DataFrame, penalty_ceiling: float = 35.0) -> DataFrame:
    """Weighted signals: positive and penalty score, priority, confidence and band (by unrounded values)."""
    weigh = lambda weights: sum((clamp01(c) * w for c, w in weights.items()), F.lit(0.0))
    positive, penalty = weigh(POSITIVE) * 100, weigh(PENALTY) * penalty_ceiling
    priority = F.least(F.lit(100.0), F.greatest(F.lit(0.0), positive - penalty))
    sure = clamp01(sum((F.col(c) * w for c, w in CONFIDENCE.items()), (1 - clamp01("uncertainty")) * 0.06))
    rows = rows.withColumns({"_pri": priority, "_sure": sure, "_pos": positive, "_pen": penalty})
    band = F.when((F.col("_pri") >= 75) & (F.col("_sure") >= 0.65), "ship_now").when((F.col("_pri") >= 55) & (F.col("_sure") >= 0.45), "validate_next").when(F.col("_pri") >= 35, "monitor").otherwise("reject")
    return rows.withColumns({"positive_score": half_up("_pos", 2), "penalty_score": half_up("_pen", 2), "priority": half_up("_pri", 2), "confidence": half_up("_sure", 4), "band": band}).drop("_pri", "_sure", "_pos", "_pen")


def best_matches(families: DataFrame, assets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(family_id, url, kind, strength, exact, updated) of each family's best asset of its project.

    An asset matches if a normal text of the family (language or title) equals its intent, or their
    similarity reaches the threshold. Ties: exact, then kind, then url. Each different text of a project is matched
    once: with its equal text, then with its equal set of tokens, which nothing beats. The sets that are
    left are compared all with all, in blocks of about ``block`` sets of needles by as many of intents: quadratic in different
    sets of a project, but a set is sent once a block, and memory is bounded by the block. ``families`` have family_id, project_id and
    needles (normal texts), ``assets`` project_id, url, kind, intent (normal) and updated.
    """
    project = families.schema["project_id"].dataType
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")), F.lit(0)), F.lit(99)).cast("int").alias("place")
    sets = lambda c: F.array_sort(title_tokens(F.col(c))).alias("tokens")
    needles = families.select("family_id", "project_id", F.explode("needles").alias("needle")).where("needle <> ''")
    stock = assets.where("intent <> ''").select(F.col("project_id").cast(project).alias("project_id"), "intent", F.struct(place, "url", "kind", "updated").alias("asset"))
    stock = stock.groupBy("project_id", "intent").agg(F.min("asset").alias("asset"))
    texts = needles.select("project_id", "needle").distinct().join(stock.withColumnRenamed("intent", "needle").hint("merge"), ["project_id", "needle"], "left")
    offered = stock.select("project_id", sets("intent"), "asset").where("size(tokens) > 0").groupBy("project_id", "tokens").agg(F.min("asset").alias("asset"))
    open_ = texts.where("asset IS NULL").select("project_id", "needle", sets("needle")).where("size(tokens) > 0")
    asked = open_.select("project_id", "tokens").distinct().join(offered.hint("merge"), ["project_id", "tokens"], "left")
    like = asked.where("asset IS NOT NULL").withColumn("strength", F.lit(1.0))
    like = like.unionByName(_nearest_sets(asked.where("asset IS NULL").select("project_id", "tokens"), offered, block))
    like = like.groupBy("project_id", "tokens").agg(F.min(F.struct((-F.col("strength")).alias("order"), "asset")).alias("m"))

    told = lambda order, exact, asset: F.struct(order.alias("order"), F.lit(not exact).alias("apart"), F.col(f"{asset}.place"), F.col(f"{asset}.url"), F.col(f"{asset}.kind"), F.col(f"{asset}.updated")).alias("m")
    found = texts.where("asset IS NOT NULL").select("project_id", "needle", told(F.lit(-1.0), True, "asset"))
    found = found.unionByName(open_.join(like.hint("merge"), ["project_id", "tokens"]).select("project_id", "needle", told(F.col("m.order"), False, "m.asset")))
    best = needles.join(found.hint("merge"), ["project_id", "needle"]).groupBy("family_id").agg(F.min("m").alias("m"))
    return best.select("family_id", "m.url", "m.kind", (-F.col("m.order")).alias("strength"), (~F.col("m.apart")).alias("exact"), "m.updated")


def _nearest_sets(asked: DataFrame, offered: DataFrame, block: int) -> DataFrame:
    """(project_id, tokens, strength, asset): of each block of offered sets the one nearest to each asked set, if similar enough; of equally near ones that of the first asset."""
    count = lambda df, name: df.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = count(asked, "rows").join(count(offered, "columns").hint("merge"), "project_id")
    own = lambda n: F.pmod(F.xxhash64("tokens"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = offered.schema["asset"].dataType
    left = asked.join(sizes.hint("merge"), "project_id").select("project_id", own("rows").alias("i"), every("columns").alias("j"), "tokens", F.lit(None).cast(kind).alias("asset"))
    right = offered.join(sizes.hint("merge"), "project_id").select("project_id", every("rows").alias("i"), own("columns").alias("j"), "tokens", "asset")
    both = left.unionByName(right).select("project_id", "i", "j", "tokens", F.col("asset").isNull().alias("asks"), *(F.col(f"asset.{f.name}") for f in kind.fields))
    names = [f.name for f in kind.fields]
    schema = T.StructType([asked.schema["project_id"], asked.schema["tokens"], T.StructField("strength", T.DoubleType()), *(T.StructField(f.name, f.dataType) for f in kind.fields)])

    def nearest(table):
        asks = table.column("asks").to_numpy()
        x, y = table.filter(pa.array(asks)), table.filter(pa.array(~asks)).sort_by([("place", "ascending"), ("url", "ascending")])
        if not x.num_rows or not y.num_rows:
            return table.slice(0, 0).append_column("strength", pa.array([], pa.float64())).select(schema.names)
        at, column, strength = nearest_sets(x.column("tokens").combine_chunks(), y.column("tokens").combine_chunks())
        out, assets = x.take(at).select(["project_id", "tokens"]).append_column("strength", pa.array(strength)), y.take(column)
        for name in names:
            out = out.append_column(name, assets.column(name))
        return out

    found = both.groupBy("project_id", "i", "j").applyInArrow(nearest, schema)
    return found.select("project_id", "tokens", "strength", F.struct(*names).alias("asset"))


def nearest_sets(asked: pa.ListArray, offered: pa.ListArray, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of asked sets with the first of the offered sets that are most similar, from ``MATCH_THRESHOLD`` on.

    Common tokens are counted by an index of the offered sets, about ``cells`` matches and pairs at a time.
    """
    n, m = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (asked, offered))
    codes = pa.concat_arrays([asked.flatten(), offered.flatten()]).dictionary_encode().indices.to_numpy()
    wanted, held = codes[: n.sum()], codes[n.sum() :]
    order = np.argsort(held, kind="stable")
    owner = np.repeat(np.arange(len(m)), m)[order]
    first = np.searchsorted(held[order], np.arange(codes.max() + 2))
    matches = (first[1:] - first[:-1])[wanted]
    ends = np.cumsum(n)
    load = np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n), matches, len(n)) + len(m))
    out, start = [], 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + cells, "right")))
        part = slice(ends[start] - n[start], ends[stop - 1])
        row, k = np.repeat(np.arange(stop - start), n[start:stop]), matches[part]
        at = np.repeat(first[wanted[part]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        common = np.bincount(np.repeat(row, k) * len(m) + owner[at], minlength=(stop - start) * len(m)).reshape(-1, len(m))
        strength = common / (n[start:stop, None] + m - common)
        best = strength.argmax(1)
        value = strength[np.arange(stop - start), best]
        kept = np.flatnonzero(value >= MATCH_THRESHOLD)
        out.append((kept + start, best[kept], value[kept]))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def coverage(families: DataFrame, matches: DataFrame, now: Column, known: Column | None = None) -> DataFrame:
    """Status (unknown, gap, covered, partial), action, gap signal and cannibalisation risk of each family."""
    rows = families.join(matches, "family_id", "left")
    available = F.lit(True) if known is None else known
    fresh = freshness("updated", now)
    covered = F.col("exact") & (fresh >= STALE)
    status = F.when(~available, "unknown").when(F.col("url").isNull(), "gap").when(covered, "covered").otherwise("partial")
    actions = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    rows = rows.withColumn("status", status)
    return rows.withColumns(
        {
            "action": F.when(F.col("status") == "unknown", "monitor_only").when(F.col("status") == "gap", "create_supporting_page").otherwise(actions[F.col("kind")]),
            "coverage_gap": F.when(F.col("status") == "unknown", 0.0).when(F.col("status") == "gap", 1.0).when(F.col("status") == "covered", 0.1).otherwise(0.5),
            "cannibalization_risk": F.when(F.col("status") == "covered", F.col("strength")).otherwise(0.0),
        }
    )


def select_feed(scored: DataFrame, keys: tuple[str, ...] = ("project_id",), most: int = 5) -> DataFrame:
    """Every family with its reason of exclusion, or its rank in the feed (at most ``most`` by project) and action.

    The first gate that holds gives the reason: generated only, baseline only, nothing observed
    to promote, blocked, below the threshold, and beyond the feed's length.
    """
    gate = (
        F.when(F.col("generated_only") | (F.col("events") == 0), "generated_only_evidence")
        .when(F.col("baseline_only"), "baseline_fingerprint_only")
        .when(~F.col("promotable"), "no_promotable_observed_evidence")
        .when(F.col("blocked"), "compliance_blocked")
        .when(F.col("priority") < MONITOR, "below_score_threshold")
    )
    rows = scored.withColumn("reason", gate)
    # What may be promoted comes first, and of each project only the first rows leave a task.
    window = Window.partitionBy(*keys).orderBy("_no", F.desc("priority"), F.desc("confidence"), "family_id")
    first = rows.select(*keys, "family_id", "priority", "confidence", F.col("reason").isNotNull().alias("_no")).withColumn("_k", F.row_number().over(window)).where((F.col("_k") <= most) & ~F.col("_no"))
    rows = rows.join(first.select(*keys, "family_id", "_k"), [*keys, "family_id"], "left")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_k").isNull(), "feed_limit").otherwise(F.col("reason")))
    return rows.withColumns({"rank": F.when(F.col("reason").isNull(), F.col("_k").cast("long")), "action": F.when(F.col("reason").isNull(), F.when(F.col("band") == "monitor", "monitor_only").otherwise(F.col("action")))}).drop("_k")


def first_family(obs: DataFrame, definitions: list[tuple[str, list[str]]], title: str = "title") -> DataFrame:
    """The first family definition all of whose words a title holds, else a family of its own by its first 120 characters."""
    key = F.lit(None).cast("string")
    for name, words in reversed(definitions):
        hit = F.lit(True)
        for w in words:
            hit = hit & F.col(title).contains(w)
        key = F.when(hit, name).otherwise(key)
    return obs.withColumn("family_key", F.coalesce(key, F.concat(F.lit("auto:"), F.substring(F.col(title), 1, 120))))


def source_gate(rows: DataFrame) -> DataFrame:
    """Why a source may not be fetched: missing, unapproved, disabled or policy_blocked, the first that holds; null if it may."""
    rule = F.when(F.col("approval").isNull(), "missing").when(F.col("approval") != "approved", "unapproved").when(~F.col("enabled"), "disabled").when(F.col("policy") != "allowed", "policy_blocked")
    return rows.withColumn("rule", rule)


def source_health(rows: DataFrame) -> DataFrame:
    """Runs by health, and whether two thirds of the sources, rounded up, are healthy."""
    count = lambda h: F.count(F.when(F.col("health") == h, 1)).alias(h)
    out = rows.agg(F.count(F.lit(1)).alias("runs"), *(count(h) for h in ("healthy", "failed", "blocked", "unknown", "skipped")))
    return out.withColumn("floor_met", F.col("healthy") >= F.ceil(F.col("runs") * 2 / 3))


def retention(rows: DataFrame, collected: str = "collected") -> DataFrame:
    """Expiry of raw content, excerpt and features by source class, unless the platform has its own days."""
    days = F.create_map(*(x for c, d in RETENTION.items() for x in (F.lit(c), F.array(*map(F.lit, d)))))
    own = F.create_map(*(x for c, d in PLATFORM_RETENTION.items() for x in (F.lit(c), F.array(*map(F.lit, d)))))
    rows = rows.withColumn("_d", F.coalesce(F.try_element_at(own, F.lower("platform")), F.try_element_at(days, F.col("source_class"))))
    return rows.withColumns({name: F.col(collected) + F.make_dt_interval(F.col("_d")[i]) for i, name in enumerate(("raw_expiry", "excerpt_expiry", "feature_expiry"))}).drop("_d")


def fixed_expiry(rows: DataFrame, collected: str = "collected", days: int = 30) -> DataFrame:
    """Expiry of stored rows, the same for all."""
    return rows.withColumn("expiry", F.col(collected) + F.make_dt_interval(F.lit(days)))


def page_changes(rows: DataFrame) -> DataFrame:
    """baseline for a page's first fingerprint, changed or same against the one before."""
    before = F.lag("fingerprint").over(Window.partitionBy("page").orderBy("seen", "id"))
    return rows.withColumn("state", F.when(before.isNull(), "baseline").when(before != F.col("fingerprint"), "changed").otherwise("same"))


def latest_feed(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items of the latest run (by date, start and id), by rank."""
    scope = runs.orderBy(F.desc("run_date"), F.desc("started_at"), F.desc("run_id")).limit(1).select("run_id")
    return items.join(F.broadcast(scope), "run_id").orderBy("rank")


def resolved_evidence(links: DataFrame, events: DataFrame, observations: DataFrame) -> DataFrame:
    """Family links with event and observation; ``missing`` marks those whose event or observation is not there."""
    out = links.join(events.withColumn("_e", F.lit(True)), "event_id", "left").join(observations.withColumn("_o", F.lit(True)), "obs_id", "left")
    return out.withColumn("missing", F.col("_e").isNull() | F.col("_o").isNull()).drop("_e", "_o")
