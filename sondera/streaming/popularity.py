"""Popularity from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """New event files of a folder as they come; the schema is that of the files there."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{folder}/{pattern}" if "*" in pattern else f"{folder}")


def windowed_popularity(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n, users)`` of each window; rows later than ``late`` are left out. State goes as windows close."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    counted = at.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "users")
