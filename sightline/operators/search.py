"""Search performance reports over rows of (day, query, page, clicks, impressions, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.expr import all_of, report_range
from sightline.sources.staging import stage

OPERATORS = {
    "equals": lambda c, x: c == x,
    "notEquals": lambda c, x: c != x,
    "contains": lambda c, x: F.lower(c).contains(x.lower()),
    "notContains": lambda c, x: ~F.lower(c).contains(x.lower()),
}


def totals_columns() -> list[Column]:
    impressions = F.coalesce(F.sum("impressions"), F.lit(0))
    clicks = F.coalesce(F.sum("clicks"), F.lit(0))
    weighted = F.sum(F.col("position") * F.col("impressions"))
    return [
        clicks.cast("long").alias("clicks"),
        impressions.cast("long").alias("impressions"),
        F.when(impressions > 0, clicks / impressions).otherwise(0.0).alias("ctr"),
        F.when(impressions > 0, weighted / impressions).otherwise(0.0).alias("position"),
    ]


def totals(rows: DataFrame) -> DataFrame:
    """Clicks, impressions, click rate and impression-weighted position; zeros without rows."""
    return rows.agg(*totals_columns())


def by_dimensions(rows: DataFrame, dimensions: list[str] | None = None, filters: list[tuple[str, str, str]] | None = None, row_limit: int = 1000, start_row: int = 0) -> DataFrame:
    """Totals by dimension (query, by default) of rows that pass all filters, most clicks first, in pages of at most 1000."""
    dimensions = dimensions or ["query"]
    kept = rows.where(all_of(*(OPERATORS[op](F.col(c), x) for c, op, x in filters or [])))
    out = kept.groupBy(*dimensions).agg(*totals_columns()).orderBy(F.desc("clicks"), F.desc("impressions"), *dimensions)
    return out.offset(max(0, start_row)).limit(min(1000, max(1, row_limit)))


def striking_distance(rows: DataFrame, low: float = 5, high: float = 20, most: int = 100) -> DataFrame:
    """Queries whose best page (lowest position, then most impressions, then page) ranks within bounds, most impressions first."""
    rows = rows.where("query <> '' and page <> ''")
    best = rows.groupBy("query").agg(F.min_by(F.struct("page", "clicks", "impressions", "position"), F.struct("position", -F.col("impressions"), "page")).alias("b"))
    out = best.select("query", "b.*").where(F.col("position").between(low, high))
    return out.orderBy(F.desc("impressions"), "query").limit(most)


def page_totals(rows: DataFrame) -> DataFrame:
    """One row per query and page over all days."""
    return rows.groupBy("query", "page").agg(*totals_columns())


def period_comparison(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Totals of a period and of the equally long one before it, side by side."""
    day = F.col("day")
    length = (F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))).cast("int")
    now = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    before = day.between(F.date_sub(F.lit(start).cast("date"), length + 1), F.date_sub(F.lit(start).cast("date"), 1))
    marked = rows.withColumn("period", F.when(now, "current").when(before, "previous")).where("period is not null")
    return marked.groupBy("period").agg(*totals_columns())


def within_range(rows: DataFrame, today: Column, name: str) -> DataFrame:
    """Rows of a named report range."""
    start, end = report_range(today, name)
    return rows.where(F.col("day").between(start, end))


def daily_series(events: DataFrame, value: Column) -> DataFrame:
    """Sum of a value per day: the tumbling bins of a usage chart."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.sum(value).alias("total"))


def usage_by_feature(events: DataFrame) -> DataFrame:
    """Usage by label: an explicit property, else the event type; positive sums, largest first."""
    label = F.coalesce(F.get_json_object("props", "$.feature"), F.col("event_type"))
    return events.groupBy(label.alias("label")).agg(F.sum("value").alias("used")).where("used > 0").orderBy(F.desc("used"), "label")


def moving_sums(rows: DataFrame, keys: list[str], day_no: str, value: str, spans: dict[str, int]) -> DataFrame:
    """Sums over the last so many days up to each row's day, by range windows."""
    out = rows
    for name, days in spans.items():
        window = Window.partitionBy(*keys).orderBy(day_no).rangeBetween(-(days - 1), 0)
        out = out.withColumn(name, F.sum(value).over(window))
    return out


def regimes(rows: DataFrame, keys: list[str], day_no: str, value: str) -> DataFrame:
    """Addition: spike, pulse, persistence and baseline windows, year-over-year change and a regime by them.

    Rates per day over 7, 30, 90 and 365 days: emerging without anything before the last 30 days,
    spiking if the week runs at twice the month, decaying if the month runs at less than half of
    the quarter, recurring if the same week a year ago had any, else steady.
    """
    out = moving_sums(rows, keys, day_no, value, {"spike": 7, "pulse": 30, "persistence": 90, "baseline": 365})
    year_ago = Window.partitionBy(*keys).orderBy(day_no).rangeBetween(-371, -365)
    out = out.withColumn("year_ago", F.coalesce(F.sum(value).over(year_ago), F.lit(0)))
    regime = (
        F.when(F.col("baseline") == F.col("pulse"), "emerging")
        .when(F.col("spike") / 7 > 2 * F.col("pulse") / 30, "spiking")
        .when(F.col("pulse") / 30 < 0.5 * F.col("persistence") / 90, "decaying")
        .when(F.col("year_ago") > 0, "recurring")
        .otherwise("steady")
    )
    return out.withColumn("regime", regime)


def engagement_norms(rows: DataFrame, group: list[str], value: str, age_days: str) -> DataFrame:
    """Addition: age-adjusted velocity, its percentile within the group, and its distance from the median in deviations."""
    velocity = F.col(value) / F.greatest(F.col(age_days), F.lit(1))
    out = rows.withColumn("velocity", velocity)
    places = ranked_values(out, group, "velocity")
    out = out.join(medians(places, group, "velocity").withColumnRenamed("median", "_m"), group).withColumn("_d", F.abs(F.col("velocity") - F.col("_m")))
    out = out.join(medians(ranked_values(out, group, "_d"), group, "_d").withColumnRenamed("median", "mad"), group)
    share = F.when(F.col("_total") > 1, F.col("_less") / (F.col("_total") - 1)).otherwise(0.0)
    out = out.join(places.select(*group, "velocity", share.alias("percentile")), [*group, "velocity"])
    return out.withColumn("deviations", F.when(F.col("mad") > 0, (F.col("velocity") - F.col("_m")) / F.col("mad")).otherwise(0.0)).drop("_m", "_d")


def ranked_values(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, _n, _less, _total): how often each value occurs in its group, how many rows have smaller ones, and all.

    Values are counted, dealt by ranges of (group, value), and summed up within each range and over
    the ranges before: a hot group is spread over all tasks, and no task sorts it whole.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = stage(counts.repartitionByRange(*group, value).withColumn("_range", F.spark_partition_id()), "ranked")
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A row a group and range, as many as shuffle partitions.
    ranges = dealt.groupBy(*group, "_range").agg(F.sum("_n").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    totals = ranges.groupBy(*group).agg(F.sum("_all").alias("_total"))
    out = dealt.withColumn("_less", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ranges.drop("_all"), [*group, "_range"]).join(totals, group)
    return out.select(*group, value, "_n", (F.col("_less") + F.col("_before")).alias("_less"), "_total")


def medians(places: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, median) from ``ranked_values``: the middle value, or the mean of the two middle ones."""
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda at: (F.col("_less") <= at) & (at < F.col("_less") + F.col("_n"))
    return places.groupBy(*group).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def acceleration(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Addition: change of a windowed count against the window before."""
    return rows.withColumn("acceleration", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(time)))
