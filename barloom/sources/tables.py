"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str, by: str = "event_type") -> DataFrame:
    """Price ticks: series, ts, event_id (tie breaker), value (price)."""
    return table(spark, folder, "events").select(
        F.col(by).cast("string").alias("series"), "ts", "event_id", "value"
    )
