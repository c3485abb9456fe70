"""Global positions by a range sort: numbers rows within groups of any size without one task a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import stage_table

#: Fragments (a group's rows in one range partition) that are broadcast at most: about 5 MB.
MAX_FRAGMENTS = 100_000
#: monotonically_increasing_id: the partition above this bit, the row in it below.
_SHIFT = 33


def sorted_ranges(df: DataFrame, *order: str) -> DataFrame:
    """The rows in range partitions that are sorted by ``order``, nulls first.

    Rows equal in all of ``order`` are interchangeable there; so that even a hot run of them is
    dealt out, their number in the input is the last sort key.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    return rows.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")


def positions(df: DataFrame, group: str, *order: str, label: str = "positions") -> DataFrame:
    """Add ``pos`` (from 0, in ``order`` within the group, nulls first) and ``n`` (rows of the group).

    ``df`` should be a written table, since it is read for the ranges and again for the sort. Each range
    partition writes its rows in order with their places; a group's offsets in the partitions it spans
    come from counts, one row a partition and group. Null groups are one group.
    """
    placed = sorted_ranges(df, group, *order).withColumn("__id", F.monotonically_increasing_id())
    rows = stage_table(placed, label)
    part, at = F.shiftright("__id", _SHIFT), F.col("__id").bitwiseAND((1 << _SHIFT) - 1)
    counted = rows.groupBy(F.col(group).alias("__g"), part.alias("__part")).agg(F.min(at).alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    fragments = stage_table(counted.select("__g", "__part", shift.alias("__shift"), F.sum("__n").over(whole).alias("n")), f"{label}-fragments")
    fragments = F.broadcast(fragments) if fragments.count() <= MAX_FRAGMENTS else fragments
    joined = rows.drop("n", "pos").join(fragments, F.col(group).eqNullSafe(F.col("__g")) & (part == F.col("__part")))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns if c not in ("__id", "pos", "n")), (at + F.col("__shift")).alias("pos"), "n")


def integral(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
