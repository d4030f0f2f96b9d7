"""Windowed counts, alike for batches and streams: with a watermark they run under readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming and late else df


def tumbling_counts(df: DataFrame, ts: str, length: str, *keys: str, late: str | None = "1 hour") -> DataFrame:
    out = _marked(df, ts, late).groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sliding_counts(df: DataFrame, ts: str, length: str, slide: str, *keys: str, late: str | None = "1 hour") -> DataFrame:
    out = _marked(df, ts, late).groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(df: DataFrame, key: str, ts: str, gap: str, late: str | None = "1 hour") -> DataFrame:
    out = _marked(df, ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def first_of_each(df: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
