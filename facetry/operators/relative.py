"""Relative ranks of landmarking results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relative(results: DataFrame) -> DataFrame:
    """``name, value`` with average ranks, ascending, of the measures that share a
    summary; names get ``.relative`` at their end. ``results``: ``name, value`` with names
    ``measure.summary``."""
    parts = results.withColumn("summary", F.regexp_replace("name", r"^[^.]*\.", ""))
    by = Window.partitionBy("summary")
    rank = F.rank().over(by.orderBy(F.col("value").asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy("summary", "value"))
    return parts.select(F.concat("name", F.lit(".relative")).alias("name"), (rank + (ties - 1) / 2).cast("double").alias("value"))
