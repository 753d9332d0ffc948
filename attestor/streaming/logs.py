"""Streaming ingest of append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_log(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each key once; a repeat within the watermark's delay is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def quarantine(stream: DataFrame, date: str, cutoff: Column) -> DataFrame:
    """Records dated after the cutoff are marked, not dropped."""
    return stream.withColumn("late", F.coalesce(F.col(date) > cutoff, F.lit(False)))


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
