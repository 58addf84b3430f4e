"""Itemset measures of the category columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.plans.data import Data
from facetry.plans.registry import TooLarge, measure

#: Pairs of values that the measure gives at most.
MAX_PAIRS = 100_000_000


@measure("itemset")
def one_itemset(data: Data) -> DataFrame:
    """Share of rows of each value of each attribute."""
    own = data.counts.groupBy("key", "v").agg(F.sum("n").alias("n"))
    return own.select(F.concat_ws("=", "key", "v").alias("key"), (F.col("n") / data.n).alias("value"))


@measure("itemset")
def two_itemset(data: Data) -> DataFrame:
    """For each pair of values of two attributes, the share of rows with exactly one of
    them; also for pairs that don't occur together. The grid is made of values, not of
    rows."""
    names = list(data.categories)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    levels = {r["key"]: r["k"] for r in data.counts.groupBy("key").agg(F.count_distinct("v").alias("k")).collect()}
    if (made := sum(levels[a] * levels[b] for a, b in pairs)) > MAX_PAIRS:
        raise TooLarge(f"two_itemset has a value for each of {made} pairs of values; at most {MAX_PAIRS}")
    own = data.counts.groupBy("key", "v").agg(F.sum("n").alias("n"))
    place = F.element_at(F.create_map(*[z for k, c in enumerate(names) for z in (F.lit(c), F.lit(k))]), F.col("key"))
    left = own.select(F.col("key").alias("a"), F.col("v").alias("x"), F.col("n").alias("nx"), place.alias("ka"))
    right = own.select(F.col("key").alias("b"), F.col("v").alias("y"), F.col("n").alias("ny"), place.alias("kb"))
    grid = left.join(right, F.col("ka") < F.col("kb"))
    if not pairs:
        return grid.select(F.lit("").alias("key"), F.lit(0.0).alias("value")).limit(0)
    seen = data.contingency(pairs)
    both = grid.join(seen, ["a", "b", "x", "y"], "left")
    key = F.concat(F.col("a"), F.lit("="), F.col("x"), F.lit(","), F.col("b"), F.lit("="), F.col("y"))
    return both.select(key.alias("key"), ((F.col("nx") + F.col("ny") - 2 * F.coalesce("n", F.lit(0))) / data.n).alias("value"))
