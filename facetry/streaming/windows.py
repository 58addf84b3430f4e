"""Windowed measures over a stream.

Moments, class shares and class entropy are mergeable aggregates, so Structured
Streaming can keep them per event-time window with a watermark; measures of order
statistics, pairs of rows or models stay batch-only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str, value: str, by: str | None = None, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation, skewness, kurtosis and extremes of each window (and key)."""
    keys = [F.window(time, length, slide or length).alias("w")] + ([F.col(by)] if by else [])
    x = F.col(value).cast("double")
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([by] if by else []), "n", "mean", "sd", "skewness", "kurtosis", "min", "max")


def windowed_class_counts(events: DataFrame, time: str, label: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each class in each window."""
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("w"), F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "class", "n")


def windowed_class_entropy(events: DataFrame, time: str, label: str, classes: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entropy (bits) of the class shares of each window, for known classes: one count
    per class keeps the state a fixed number of values."""
    counts = [F.count_if(F.col(label) == c).alias(f"n{k}") for k, c in enumerate(classes)]
    found = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length).alias("w")).agg(F.count("*").alias("n"), *counts)
    share = [F.col(f"n{k}") / F.col("n") for k in range(len(classes))]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", entropy.alias("entropy"))
