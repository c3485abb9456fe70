"""As-of and interval joins on equality keys and time, without nested loops.

As-of: both sides are one union; time is cut at quantiles of all rows' times, so that a bucket holds a
bounded share of them whatever the skew of a key. The last right row is carried on within each key and
bucket by a window, and into later buckets by one row a key and bucket. Rows are shuffled once.

Intervals: an interval of length n lies in at most two bins of the next power of two. Each pair of
intervals meets in bins of the longer one's length, in the bin of its overlap's start alone, and a
residual test decides, so that long intervals are not cut into many short bins.
"""

from __future__ import annotations

import math
from fractions import Fraction

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key and time bucket, about.
BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 512


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, right_time: str, columns: Sequence[str], strict: bool = False, tolerance: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every left row with the ``columns`` of the right row of its key whose time is the latest at or before its own (``strict``: before).

    Without such a row, or with one that is more than ``tolerance`` seconds older, they are null. Of right
    rows of one key and time the greatest by ``columns`` counts. Null keys or times match nothing; left rows
    are all kept, equal ones too. ``columns`` replace left columns of the same names; times are timestamps.
    """
    left = left.drop(*columns)
    found = right.select(*on, F.col(right_time).cast("timestamp").alias("_t"), F.struct(F.col(right_time).cast("timestamp").alias("_t"), *columns).alias("_r"))
    found = found.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*on, "_t"])).groupBy(*on, "_t").agg(F.max("_r").alias("_r"))
    asked = left.select(*on, F.col(time).cast("timestamp").alias("_t"), F.struct(*left.columns).alias("_l"))
    cuts = _cuts(asked.select("_t").unionByName(found.select("_t")), bucket_rows)
    # At one time, right rows come first, or last if only earlier ones count.
    both = asked.withColumn("_r", F.lit(None).cast(found.schema["_r"].dataType)).withColumn("_side", F.lit(1))
    both = both.unionByName(found.withColumn("_l", F.lit(None).cast(asked.schema["_l"].dataType)).withColumn("_side", F.lit(2 if strict else 0)))
    both = both.withColumn("_bucket", _bucket(F.col("_t"), cuts))
    within = Window.partitionBy(*on, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_last", F.last("_r", ignorenulls=True).over(within)).where("_l IS NOT NULL")
    if cuts:
        # What earlier buckets hand on: a row for each key and bucket.
        ends = both.groupBy(*on, "_bucket").agg(F.max("_r").alias("_r"))
        before = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        handed = ends.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), F.col("_bucket").alias("_b"), F.last("_r", ignorenulls=True).over(before).alias("_before"))
        same = F.col("_bucket") == F.col("_b")
        for i, c in enumerate(on):
            same &= F.col(c) == F.col(f"_k{i}")
        rows = rows.join(handed, same, "left").withColumn("_last", F.coalesce("_last", "_before"))
    known = F.col("_t").isNotNull()
    for c in on:
        known &= F.col(c).isNotNull()
    if tolerance is not None:
        known &= F.unix_micros("_t") - F.unix_micros("_last._t") <= tolerance * 1_000_000
    return rows.select(*(F.col(f"_l.`{c}`").alias(c) for c in left.columns), *(F.when(known, F.col(f"_last.`{c}`")).alias(c) for c in columns))


def _cuts(times: DataFrame, bucket_rows: int) -> list[int]:
    """Quantiles of the times, in microseconds: a bounded list, for about ``bucket_rows`` rows a bucket."""
    counted = times.agg(F.count("_t").alias("n")).first()["n"]
    buckets = min(MAX_BUCKETS, -(-counted // bucket_rows))
    if buckets < 2:
        return []
    found = times.agg(F.percentile_approx(F.unix_micros("_t"), [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def _bucket(time: Column, cuts: list[int]) -> Column:
    """The number of cuts at or before a time, by halving; null times are in the first bucket."""
    at = F.unix_micros(time)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at >= F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return F.when(at.isNull(), F.lit(0)).otherwise(search(0, len(cuts)))


#: Bits between two lengths of bins.
STEP = 2


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str | None], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of one key whose half-open spans [start, end) overlap; left rows without an end column are points in time.

    Null keys or ends, and spans that don't end after their start, meet nothing. Columns: those of the left, then those of
    the right without the keys; they must differ. Times are timestamps.
    """
    x = _spanned(left, on, left_span, "_l")
    y = _spanned(right, on, right_span, "_r")
    levels = {side: {r[0] for r in df.select(f"{side}_level").distinct().collect()} for side, df in (("_l", x), ("_r", y))}  # 32 at most

    def binned(df: DataFrame, side: str, other: set[int]) -> DataFrame:
        """A row for each length of bins in which the row may meet one of the other side, and each of its one or two bins."""
        own = F.col(f"{side}_level")
        coarser = F.filter(F.array(*(F.lit(k) for k in sorted(other))).cast("array<int>"), lambda k: k > own)
        at = F.concat(F.array(own), coarser)
        bins = F.flatten(F.transform(at, lambda k: F.transform(F.array_distinct(F.array(_bin(F.col(f"{side}_s"), k), _bin(F.col(f"{side}_e") - 1, k))), lambda b: F.struct(k.alias("level"), b.alias("bin")))))
        return df.withColumn("_at", F.explode(bins)).select("*", F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin")).drop("_at")

    met = binned(x, "_l", levels["_r"]).join(binned(y, "_r", levels["_l"]), [*on, "_level", "_bin"])
    first = F.greatest("_l_s", "_r_s")
    met = met.where((F.col("_l_s") < F.col("_r_e")) & (F.col("_r_s") < F.col("_l_e")) & (F.col("_level") == F.greatest("_l_level", "_r_level")) & (F.col("_bin") == _bin(first, F.col("_level"))))
    return met.select(*(F.col(c) for c in left.columns), *(F.col(c) for c in right.columns if c not in on))


def _bin(time: Column, level: Column) -> Column:
    return F.floor(time / F.pow(F.lit(2.0), level * STEP)).cast("long")


def _spanned(df: DataFrame, on: Sequence[str], span: tuple[str, str | None], side: str) -> DataFrame:
    """Start, end (in microseconds) and level of the least bins that are as long as the span."""
    start = F.unix_micros(F.col(span[0]).cast("timestamp"))
    end = F.unix_micros(F.col(span[1]).cast("timestamp")) if span[1] else start + 1
    rows = df.withColumns({f"{side}_s": start, f"{side}_e": end})
    for c in [*on, f"{side}_s", f"{side}_e"]:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where(F.col(f"{side}_e") > F.col(f"{side}_s"))
    bits = F.length(F.bin(F.col(f"{side}_e") - F.col(f"{side}_s")))  # 2 ** bits is longer than the span
    return rows.withColumn(f"{side}_level", F.ceil(bits / STEP).cast("int"))


def quantiles(rows: DataFrame, value: Column, shares: list[str], bins: int = 10_000) -> list[int]:
    """The smallest long that at least each share of the values doesn't exceed (as SQL's ``quantile_disc``), nulls left out; none of no values.

    Exact at any size: values are counted in at most ``bins`` equal ranges, then again within the range that holds
    the rank, until it is one value. Shares are decimal texts, so that ranks don't depend on rounding.
    """
    values = rows.select(value.cast("long").alias("x")).where("x IS NOT NULL")
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    found = [(low, high, max(1, math.ceil(n * Fraction(share)))) for share in shares] if n else []
    while any(a < b for a, b, _ in found):
        widths = [(b - a) // bins + 1 for a, b, _ in found]
        inside = F.array(*(F.when(F.col("x").between(a, b), F.struct(F.lit(i).alias("i"), F.expr(f"(x - {a}L) div {w}L").alias("bin"))) for i, ((a, b, _), w) in enumerate(zip(found, widths, strict=True))))
        counted = values.select(F.explode(F.filter(inside, lambda e: e.isNotNull())).alias("e")).groupBy("e.i", "e.bin").count().collect()  # bins rows a share at most
        for i, ((a, b, rank), w) in enumerate(zip(found, widths, strict=True)):
            for k, c in sorted((r["bin"], r["count"]) for r in counted if r["i"] == i):
                if rank <= c:
                    found[i] = (a + k * w, min(b, a + k * w + w - 1), rank)
                    break
                rank -= c
    return [a for a, _, _ in found]
