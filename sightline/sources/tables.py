"""Table maintenance on DataFrames: upserts, ignoring inserts, deletes, claims and versioned updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_with_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among the keys, however many those are (semi-join)."""
    return df.join(keys, on, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Last write wins: new rows replace old ones of their key; of several new ones the greatest ``order``."""
    if order is not None:
        window = Window.partitionBy(*key).orderBy(order.desc())
        new = new.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """First write wins: only new rows of unknown keys are appended."""
    window = Window.partitionBy(*key).orderBy(order if order is not None else F.lit(0))
    fresh = new.join(old.select(*key), key, "left_anti").withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")
    return old.unionByName(fresh)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def claim_once(runs: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """Claims whose key has no run yet, one per key by claim id."""
    window = Window.partitionBy(*key).orderBy("claim_id")
    return claims.join(runs.select(*key), key, "left_anti").withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def versioned_update(df: DataFrame, key: Column, expected: int, changes: dict[str, Column]) -> DataFrame:
    """Change the row of a key if its version is the expected one, and raise the version."""
    hit = key & (F.col("version") == expected)
    return df.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in changes.items()} | {"version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))})


def backfilled(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """A time that is set once: the old value if there is one, else the new."""
    other = new.select(key, F.col(column).alias("_new"))
    return old.join(other, key, "full").withColumn(column, F.coalesce(column, "_new")).drop("_new")
