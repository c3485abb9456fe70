"""Mergeable sketches of distinct values and quantiles: built once for fine groups, merged for coarser ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct sketch: its standard error is 1.04 / 2 ** (bits / 2), 1.6 % for 12.
HLL_BITS = 12


def sketch(rows: DataFrame, groups: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(groups, n, distinct_sketch, value_sketch): rows, a sketch of the distinct values of one column and of another's quantiles; nulls are left out.

    The rows are read once; whatever is asked later merges these few rows.
    """
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("value_sketch"),
    )


def rolled_up(sketches: DataFrame, groups: Sequence[str], ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Estimates for every level of a rollup over ``groups``: n, distinct_estimate and an estimate for each rank (``q50``, ``q90``), with ``level`` (grouping id)."""
    merged = sketches.rollup(*groups).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("value_sketch").alias("v"))
    named = (F.kll_sketch_get_quantile_double("v", F.lit(r)).alias(f"q{round(100 * r)}") for r in ranks)
    return merged.select(*groups, "level", "n", F.hll_sketch_estimate("d").alias("distinct_estimate"), *named, "v")
