"""Counts over event streams. Each function takes a batch or streaming DataFrame with ``event_time`` and gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _late(rows: DataFrame, watermark: str) -> DataFrame:
    return rows.withWatermark("event_time", watermark) if rows.isStreaming else rows


def tumbling(rows: DataFrame, size: str = "7 days", key: str = "record_type", watermark: str = "1 day") -> DataFrame:
    counts = _late(rows, watermark).groupBy(F.window("event_time", size).alias("w"), key).agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), key, "records", "total")


def sliding(rows: DataFrame, size: str = "2 days", step: str = "1 day", watermark: str = "1 day") -> DataFrame:
    counts = _late(rows, watermark).groupBy(F.window("event_time", size, step).alias("w")).agg(F.count(F.lit(1)).alias("records"))
    return counts.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "records")


def sessions(rows: DataFrame, gap: str = "2 hours", key: str = "source_id", watermark: str = "1 day") -> DataFrame:
    counts = _late(rows, watermark).groupBy(F.session_window("event_time", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("records"))
    return counts.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "records")


def first_seen(rows: DataFrame, key: str = "record_id", watermark: str = "1 day") -> DataFrame:
    """Each id once; on a stream an id may come back after the watermark, which bounds the state."""
    return _late(rows, watermark).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])
