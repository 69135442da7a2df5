"""Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_quote(stream: DataFrame, time: str, symbol: str, values: list[str], window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Last values of every (window, symbol), emitted once the watermark has passed the window."""
    row = F.struct(*[F.col(v) for v in values])
    return stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", delay).groupBy(F.window("__ts", window).alias("w"), symbol).agg(F.max_by(row, F.col("__ts")).alias("r")).select(F.col("w.start").alias("time_bin"), symbol, "r.*")


def dedup(stream: DataFrame, time: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """One row per key within the watermark: overlapping pages of a cursor."""
    return stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", delay).dropDuplicatesWithinWatermark([key]).drop("__ts")


def around(trades: DataFrame, centers: DataFrame, minutes: int = 10, delay: str = "20 minutes") -> DataFrame:
    """Trades within minutes of other events: an interval join of two streams (ts, center).

    Streams join on an equality, which time buckets give; the watermarks and the
    interval bound the state.
    """
    half = minutes * 60
    bucket = lambda seconds: F.floor(seconds / (2 * half))
    at = F.unix_seconds("center")
    t = trades.withWatermark("ts", delay).withColumn("__b", bucket(F.unix_seconds("ts")))
    c = centers.withWatermark("center", delay).withColumn("__c", F.explode(F.sequence(bucket(at - half), bucket(at + half))))
    inside = F.expr(f"__b = __c AND ts BETWEEN center - INTERVAL {minutes} MINUTES AND center + INTERVAL {minutes} MINUTES")
    return t.join(c, inside).drop("__b", "__c")


def sliding_mean(stream: DataFrame, time: str, key: str, value: str, width: str = "3 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Mean over sliding calendar windows."""
    return stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", delay).groupBy(F.window("__ts", width, step).alias("w"), key).agg(F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "mean")
