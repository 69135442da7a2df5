"""Registered queries that run the streaming forms over ``events`` to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import live
from .archives import scratch


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder


def _result(out: DataFrame) -> DataFrame:
    """Rows that a stream has put out when all that was there is read."""
    spark = out.sparkSession
    folder = scratch(spark)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _ntz(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def stream_last_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last quote of every window that the watermark has passed."""
    return _ntz(_result(live.last_quote(_stream(spark, sf_dir), "ts", "user_id", ["event_id", "value"])), "time_bin")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, of a stream in which a third comes twice."""
    e = _stream(spark, sf_dir)
    return _result(live.dedup(e.unionByName(e.where("event_id % 3 = 0")), "ts", "event_id")).select("event_id", "user_id", "value")


def stream_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within a minute of events of one kind: an interval join of two streams."""
    trades = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    centers = _stream(spark, sf_dir).where("event_type = 'click'").select(F.col("ts").cast("timestamp").alias("center"), F.col("event_id").alias("center_id"))
    return _result(live.around(trades, centers, 1)).select("event_id", "center_id")


def stream_sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three hours, every hour, of the windows that the watermark has passed."""
    out = _ntz(_result(live.sliding_mean(_stream(spark, sf_dir), "ts", "event_type", "value")), "start")
    return out.withColumn("mean", F.round("mean", 6))


QUERIES = {"stream_last_quote": stream_last_quote, "stream_dedup": stream_dedup, "stream_around": stream_around, "stream_sliding_mean": stream_sliding_mean}
ORACLE_SQL = {
    "stream_last_quote": """
WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events),
r AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS time_bin, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') ORDER BY ts DESC) AS r FROM events)
SELECT time_bin, user_id, event_id, value FROM r, w WHERE r = 1 AND time_bin + INTERVAL 5 MINUTE <= mark""",
    "stream_dedup": "SELECT event_id, user_id, value FROM events",
    "stream_around": "SELECT e.event_id, c.event_id AS center_id FROM events e JOIN events c ON c.event_type = 'click' AND e.ts BETWEEN c.ts - INTERVAL 1 MINUTE AND c.ts + INTERVAL 1 MINUTE",
    "stream_sliding_mean": """
WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events),
s AS (SELECT date_trunc('hour', ts) - to_hours(k::BIGINT) AS start, event_type, value FROM events, (SELECT unnest([0, 1, 2]) AS k))
SELECT start, event_type, round(avg(value), 6) AS mean FROM s, w WHERE start + INTERVAL 3 HOUR <= mark GROUP BY ALL""",
}
