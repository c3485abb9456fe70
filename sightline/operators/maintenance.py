"""Maintenance: duplicate maps, merging through a mapping, back-fills, validation and incremental extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_map(rows: DataFrame, group: list[str], order: list[Column], key: str = "id") -> DataFrame:
    """Each row's place in its group, the group's first row and size; places after the first are duplicates."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({"keep_rank": F.row_number().over(window).cast("long"), "canonical_id": F.first(key).over(window), "copies": F.count(F.lit(1)).over(Window.partitionBy(*group))})


def backfilled_value(rows: DataFrame, donors: DataFrame, key: str, column: str, order: Column) -> DataFrame:
    """Null values take the newest non-null one of the key's donors, if there is any."""
    best = donors.where(F.col(column).isNotNull()).groupBy(key).agg(F.max_by(column, order).alias("_v"))
    return rows.join(best, key, "left").withColumn(column, F.coalesce(column, "_v")).drop("_v")


def repointed(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Foreign keys through (old, new) of a mapping; others stay."""
    return rows.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def without_collisions(rows: DataFrame, mapping: DataFrame, column: str, others: list[str]) -> DataFrame:
    """Rows but those that would equal an existing row of the target once re-pointed."""
    target = rows.select(F.col(column).alias("new"), *others)
    moving = rows.join(mapping.select(F.col("old").alias(column), "new"), column)
    doomed = moving.join(target, ["new", *others], "left_semi").select(column, *others)
    return rows.join(doomed, [column, *others], "left_anti")


def newest_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` of each key."""
    window = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def json_pick(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One value of a JSON array of strings, by a list of preferences; bad JSON and empty arrays give null."""
    values = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
    rank = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(o) for o in order)), x), F.lit(0)), F.lit(len(order) + 1))
    best = F.array_min(F.transform(values, lambda x: F.struct(rank(x).alias("r"), x.alias("v"))))
    return rows.withColumn("picked", best["v"])


def incremental(parents: DataFrame, children: DataFrame, key: str, child_key: str, since: Column, last_id=None, page: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Recent parents, a page of them by key if asked for, and their children."""
    rows = parents.where(since if last_id is None else since & (F.col(key) > last_id))
    if page is not None:
        rows = rows.orderBy(key).limit(page)
    return rows, children.join(rows.select(F.col(key).alias(child_key)), child_key, "left_semi")


def orphan_rows(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children whose parent is not there."""
    return children.join(parents.select(F.col(key).alias(child_key)), child_key, "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def converted(rows: DataFrame, booleans: list[str] = (), epoch_ms: list[str] = (), spaced: list[str] = ()) -> DataFrame:
    """0/1 to booleans, epoch milliseconds and spaced timestamps to times."""
    return rows.withColumns({**{c: F.col(c).cast("boolean") for c in booleans}, **{c: F.timestamp_millis(c) for c in epoch_ms}, **{c: F.try_to_timestamp(c) for c in spaced}})


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (a rule that is unknown is not broken)."""
    counts = rows.agg(*(F.count(F.when(~rule, 1)).alias(name) for name, rule in rules.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(n) for n in rules)), F.array(*(F.col(n) for n in rules)))).alias("rule", "broken"))
