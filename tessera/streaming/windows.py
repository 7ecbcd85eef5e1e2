"""Windowed aggregates that are the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tumbling(df: DataFrame, ts: str, size: str, value: str, *keys: str, lateness: str | None = None) -> DataFrame:
    """(window_start, keys, n, total); a stream needs the lateness it tolerates."""
    return _windowed(df, F.window(ts, size), ts, value, keys, lateness)


def sliding(df: DataFrame, ts: str, size: str, slide: str, value: str, *keys: str, lateness: str | None = None) -> DataFrame:
    return _windowed(df, F.window(ts, size, slide), ts, value, keys, lateness)


def session(df: DataFrame, ts: str, gap: str, value: str, *keys: str, lateness: str | None = None) -> DataFrame:
    return _windowed(df, F.session_window(ts, gap), ts, value, keys, lateness)


def _windowed(df, window, ts, value, keys, lateness) -> DataFrame:
    if lateness:  # watermarks are of instants; local times count in the session's zone
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    grouped = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def deduplicated(df: DataFrame, ts: str, lateness: str | None, *keys: str) -> DataFrame:
    """First row of each key; of a stream, within the lateness it tolerates."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys)) if lateness else df.dropDuplicates(list(keys))
