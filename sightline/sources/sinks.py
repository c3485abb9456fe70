"""Exports: CSV and JSON files, text tables, and typed reading of nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.functions.expr import csv_cell, table_cell


def csv_cells(df: DataFrame) -> DataFrame:
    """All values as CSV texts: two decimals, guarded against running as formulas."""
    return df.select(*(csv_cell(c, kind).alias(c) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("quoteAll", True).option("header", True).option("lineSep", "\n").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def text_rows(df: DataFrame) -> DataFrame:
    """Each row as one line of a text table."""
    return df.select(F.concat_ws(" | ", *(table_cell(c, kind) for c, kind in df.dtypes)).alias("line"))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Nested provider records with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def string_array(column: str):
    """The strings of a JSON array; other members are left out, bad JSON is empty."""
    items = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: x.isNotNull())


def keyword_items(items: DataFrame) -> DataFrame:
    """Ranked-keyword records to rows: nested values with fall-backs, rounded volumes, difficulty and url."""
    return items.select(
        F.coalesce("keyword_data.keyword", "keyword").alias("keyword"),
        F.coalesce("keyword_data.keyword_info.search_volume", F.lit(0)).alias("search_volume"),
        F.coalesce("ranked.rank_group", "ranked.rank_absolute").alias("position"),
        F.col("ranked.url").alias("url"),
    ).where("keyword is not null")
