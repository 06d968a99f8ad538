"""Streaming counterparts of the batch aggregations: an extra, built on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, time: str, width: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums by time window and keys; state older than the watermark is dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), *keys)
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begins"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key, ended by a gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), key, "n")
