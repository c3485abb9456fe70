"""Rank tracking: snapshots over runs, comparisons, scorecards, histories and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expr import all_of, ctr, half_up, position_filter, range_filter, split_terms, text_filter

DEVICES = ("desktop", "mobile")


def completed_snapshots(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshots of completed runs (semi-join)."""
    return snapshots.join(runs.where("status = 'completed'").select("run_id"), "run_id", "left_semi")


def latest_snapshots(snapshots: DataFrame, before: Column | None = None, earliest: bool = False, ties: bool = False) -> DataFrame:
    """The latest (or earliest) snapshot of each keyword and device, at or before a time if given.

    With ``ties`` all snapshots of that time stay; else the largest id (for ``earliest``: smallest) does.
    One window, whose partitions are a keyword's history.
    """
    if before is not None:
        snapshots = snapshots.where(F.col("checked_at") <= before)
    time = F.col("checked_at").asc() if earliest else F.col("checked_at").desc()
    order = [time] if ties else [time, F.col("snapshot_id").asc() if earliest else F.col("snapshot_id").desc()]
    window = Window.partitionBy("config_id", "keyword_id", "device").orderBy(*order)
    return snapshots.withColumn("_k", F.rank().over(window)).where("_k = 1").drop("_k")


def compared_results(snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """(config, keyword, device, position, previous_position): latest against the last snapshot at or before a cutoff.

    Where there is none the earliest one stands in. That a comparison row exists decides, not
    whether its position is null. The three lookups share one pass: conditional ``max_by`` over
    the keyword's snapshots, combined before the shuffle.
    """
    order = F.struct("checked_at", "snapshot_id")
    older = F.col("checked_at") <= cutoff
    value = F.struct("position")
    out = snapshots.groupBy("config_id", "keyword_id", "device").agg(
        F.max_by(value, order).alias("now"),
        F.max_by(value, F.when(older, order)).alias("then"),
        F.min_by(value, order).alias("first"),
        F.bool_or(older).alias("has_then"),
    )
    return out.select("config_id", "keyword_id", "device", F.col("now.position").alias("position"), F.when(F.col("has_then"), F.col("then.position")).otherwise(F.col("first.position")).alias("previous_position"))


def by_device(results: DataFrame) -> DataFrame:
    """One row per keyword with a struct per device."""
    cell = F.first(F.struct("position", "previous_position"))
    return results.groupBy("config_id", "keyword_id").pivot("device", list(DEVICES)).agg(cell)


def _card(device: str) -> dict[str, Column]:
    p, q = F.col(f"{device}.position"), F.col(f"{device}.previous_position")
    volume = F.when(F.col("search_volume") > 0, F.col("search_volume"))
    count = lambda c: F.count(F.when(c, True)).cast("long")
    share = lambda x: F.when(F.sum(volume) > 0, F.sum(volume * ctr(x)) / (F.sum(volume) * ctr(F.lit(1))) * 100)
    return {
        "visibility": share(p),
        "visibility_delta": share(p) - share(q),
        "ranking": count(p.isNotNull()),
        "ranking_delta": count(p.isNotNull()) - count(q.isNotNull()),
        "top3": count(p <= 3),
        "top10": count(p <= 10),
        "improved": count((p < q) | (p.isNotNull() & q.isNull())),
        "declined": count((p > q) | (p.isNull() & q.isNotNull())),
    }


def scorecards(rows: DataFrame, *devices: str, keys: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Visibility (share of click potential, percent), its change, ranking counts, improved and declined, by device.

    ``rows`` are of ``by_device`` with ``search_volume``. New entries improve, lost ones decline.
    Visibility is null without volumes. All devices share one aggregation.
    """
    devices = devices or DEVICES
    cards = {d: _card(d) for d in devices}
    out = rows.groupBy(*keys).agg(*(x.alias(f"{d}_{c}") for d, card in cards.items() for c, x in card.items()))
    each = (F.struct(F.lit(d).alias("device"), *(F.col(f"{d}_{c}").alias(c) for c in card)) for d, card in cards.items())
    return out.select(*keys, F.inline(F.array(*each)))


def position_buckets(snapshots: DataFrame, runs: DataFrame, device: str, since: Column | None = None) -> DataFrame:
    """Distribution of positions per completed full run: total, 1-3, 4-10, 11-20 and not ranking."""
    whole = runs.where("status = 'completed' and not is_subset")
    if since is not None:
        whole = whole.where(F.col("started_at") >= since)
    between = lambda a, b: F.sum(F.when(F.col("position").between(a, b), 1).otherwise(0)).cast("long")
    out = snapshots.where(F.col("device") == device).join(whole.select("run_id", "started_at"), "run_id").groupBy("run_id", "started_at").agg(F.count(F.lit(1)).alias("total"), between(1, 3).alias("top3"), between(4, 10).alias("top10"), between(11, 20).alias("top20"))
    return out.withColumn("not_ranking", F.greatest(F.lit(0), F.col("total") - F.col("top3") - F.col("top10") - F.col("top20")))


def history_matrix(snapshots: DataFrame, runs: DataFrame, config_id: int, device: str, last_runs: int) -> DataFrame:
    """(run, keyword, position, change) on the full grid of a config's last runs and their keywords.

    The change is previous minus own position, null unless both ranked; a missing cell is null.
    """
    recent = runs.where((F.col("config_id") == config_id) & (F.col("status") == "completed")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(last_runs).select("run_id", "started_at")
    cells = snapshots.where(F.col("device") == device).join(F.broadcast(recent), "run_id").select("run_id", "keyword_id", "position")
    grid = cells.select("keyword_id").distinct().withColumn("_runs", F.lit(1)).join(F.broadcast(recent.agg(F.collect_list(F.struct("run_id", "started_at")).alias("runs")).withColumn("_runs", F.lit(1))), "_runs")
    grid = grid.select("keyword_id", F.explode("runs").alias("r")).select("keyword_id", "r.run_id", "r.started_at")
    window = Window.partitionBy("keyword_id").orderBy("started_at", "run_id")
    dense = grid.join(cells, ["keyword_id", "run_id"], "left")
    return dense.select("run_id", "keyword_id", "position", (F.lag("position").over(window) - F.col("position")).alias("change"))


def pivoted_matrix(matrix: DataFrame, run_ids: list[int]) -> DataFrame:
    """Keyword rows with a column of positions per run."""
    return matrix.groupBy("keyword_id").pivot("run_id", run_ids).agg(F.first("position"))


def keyword_history(snapshots: DataFrame, keyword_id: int, since: Column) -> DataFrame:
    """A keyword's snapshots since a time, oldest first, with the device's position before."""
    window = Window.partitionBy("config_id", "device").orderBy("checked_at", "snapshot_id")
    rows = snapshots.where((F.col("keyword_id") == keyword_id) & (F.col("checked_at") >= since))
    return rows.withColumn("previous", F.lag("position").over(window))


def chart_series(snapshots: DataFrame, depth: int) -> DataFrame:
    """A point per time with a column per device; unranked is drawn at the tracked depth."""
    return snapshots.groupBy("checked_at").pivot("device", list(DEVICES)).agg(F.min(F.coalesce("position", F.lit(depth))))


def dashboard_rollup(rows: DataFrame, configs: int) -> DataFrame:
    """Totals over a few configs and both devices; a change counts only where both positions are known."""
    few = rows.join(F.broadcast(rows.select("config_id").distinct().orderBy("config_id").limit(configs)), "config_id", "left_semi")
    flat = few.select("config_id", F.inline(F.array(*(F.struct(F.lit(d).alias("device"), F.col(f"{d}.position").alias("p"), F.col(f"{d}.previous_position").alias("q")) for d in DEVICES))))
    count = lambda c: F.count(F.when(c, True)).cast("long")
    return flat.agg(count(F.col("p").isNotNull()).alias("ranking"), count(F.col("p") <= 10).alias("top10"), count(F.col("p") < F.col("q")).alias("improved"), count(F.col("p") > F.col("q")).alias("declined"))


def filter_rows(rows: DataFrame, include: str = "", exclude: str = "", desktop=(None, None), mobile=(None, None), volume=(None, None), difficulty=(None, None), cpc=(None, None)) -> DataFrame:
    """Rank table filter: any include term, no exclude term, position bounds, metric ranges that null fails."""
    return rows.where(
        all_of(
            text_filter("keyword", split_terms(include, ","), split_terms(exclude, ","), "any"),
            position_filter("desktop.position", *desktop),
            position_filter("mobile.position", *mobile),
            range_filter("search_volume", *volume, nulls="fail"),
            range_filter("difficulty", *difficulty, nulls="fail"),
            range_filter("cpc", *cpc, nulls="fail"),
        )
    )


def filter_configs(configs: DataFrame, query: str = "", device: str = "all", location: int | None = None) -> DataFrame:
    return configs.where(all_of(text_filter("domain", [query.strip().lower()] if query.strip() else []), None if device == "all" else F.col("devices") == device, None if location is None else F.col("location_code") == location))


def config_options(configs: DataFrame) -> DataFrame:
    """Distinct devices in the order both, desktop, mobile, then distinct locations by label, numbered."""
    rank = F.when(F.col("devices") == "both", 0).when(F.col("devices") == "desktop", 1).otherwise(2)
    devices = configs.select(F.lit("device").alias("kind"), F.col("devices").alias("value"), rank.cast("string").alias("sort")).distinct()
    places = configs.select(F.lit("location").alias("kind"), F.col("location_code").cast("string").alias("value"), F.col("location_code").cast("string").alias("sort")).distinct()
    window = Window.partitionBy("kind").orderBy("sort")
    return devices.unionByName(places).select("kind", "value", F.row_number().over(window).cast("long").alias("place"))


def config_summary(configs: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Each config with its number of keywords (0 without) and its latest run."""
    counts = snapshots.groupBy("config_id").agg(F.countDistinct("keyword_id").alias("keywords"))
    last = runs.groupBy("config_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("last_run"), F.max("started_at").alias("last_started"))
    return configs.join(counts, "config_id", "left").join(last, "config_id", "left").select("config_id", "domain", F.coalesce("keywords", F.lit(0)).alias("keywords"), "last_run", "last_started")


def due_configs(configs: DataFrame, projects: DataFrame, due: Column, most: int = 50) -> DataFrame:
    """Active configs of unarchived projects whose next check is due, by id."""
    return configs.where(F.col("is_active") & due).join(projects.where("not archived").select("project_id"), "project_id", "left_semi").orderBy("config_id").limit(most)


def same_market(configs: DataFrame, code, name) -> DataFrame:
    """Configs of a location; a null name is the whole country and matches null only."""
    return configs.where((F.col("location_code") == F.lit(code)) & F.col("location_name").eqNullSafe(F.lit(name)))


def add_keywords(existing: DataFrame, wanted: DataFrame, capacity: int) -> DataFrame:
    """(keyword, ordinal) that are new, first occurrences in order, until the capacity is used up."""
    fresh = wanted.select(F.lower(F.trim("keyword")).alias("keyword"), "ordinal").where("keyword <> ''").groupBy("keyword").agg(F.min("ordinal").alias("ordinal"))
    fresh = fresh.join(existing.select(F.lower(F.trim("keyword")).alias("keyword")), "keyword", "left_anti")
    room = capacity - existing.count()
    return fresh.orderBy("ordinal", "keyword").limit(max(0, room))


def check_estimate(configs: DataFrame, keywords: str = "keywords", first_page: float = 0.002, next_page: float = 0.0015, markup: float = 1.25, credits_per_usd: int = 1000) -> DataFrame:
    """Cost of a check: pages of ten results at first and further prices, times devices and markup."""
    pages = F.col("depth") / 10
    devices = F.when(F.col("devices") == "both", 2).otherwise(1)
    usd = half_up(F.col(keywords) * devices * (F.lit(first_page) + (pages - 1) * F.lit(next_page)) * F.lit(markup), 6)
    return configs.withColumn("cost_usd", usd).withColumn("cost_credits", F.ceil(usd * credits_per_usd))


def competitor_visibility(latest: DataFrame, volumes: DataFrame) -> DataFrame:
    """Addition: click potential captured by each config over all keywords, by the visibility curve."""
    joined = latest.join(volumes, "keyword_id")
    return joined.groupBy("config_id").agg(F.sum(F.coalesce("search_volume", F.lit(0)) * ctr("position")).alias("captured"))
