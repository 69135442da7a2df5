"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "smileforge") -> SparkSession.Builder:
    """UTC clock, adaptive execution with skew handling, Arrow transfer."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
