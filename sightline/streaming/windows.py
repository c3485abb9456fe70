"""Event-time windows over batch or streaming rows of (ts, event_type, value); additions to the analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def tumbling(df: DataFrame, size: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type; sliding windows with ``slide``. Streams drop rows later than ``delay``."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _late(df, delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: rows no further apart than ``gap``."""
    out = _late(df, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def joined_within(left: DataFrame, right: DataFrame, key: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Left rows with the right rows of their key that are at most ``within`` older (columns ts, and those of ``right`` named apart by ``right_``).

    On streams both sides keep rows until the watermarks show that no partner can come.
    """
    a, b = _late(left, delay), _late(right, delay)
    b = b.select(*(F.col(c).alias(f"right_{c}") for c in b.columns))
    when = (F.col("right_ts") <= F.col("ts")) & (F.col("right_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"right_{key}")) & when)
