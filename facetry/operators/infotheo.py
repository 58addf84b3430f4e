"""Information-theoretic measures, on grouped counts.

Joint tables are dense in definition: every (value, class) cell gets a small constant,
also those that don't occur; their share is added in closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.plans.data import Data
from facetry.plans.registry import measure
from facetry.session import settled

EPSILON = 1e-8


def _per_key(df: DataFrame) -> dict[str, float]:
    return {r["key"]: float(r["value"]) for r in df.collect()}


def _in_order(data: Data, values: dict[str, float]) -> list[tuple[str, float]]:
    return [(c, values[c]) for c in data.categories]


def attribute_entropies(data: Data) -> dict[str, float]:
    p = F.col("m") / data.n
    return _per_key(data.counts.groupBy("key", "v").agg(F.sum("n").alias("m")).groupBy("key").agg((-F.sum(p * F.log2(p))).alias("value")))


def class_entropy(data: Data) -> float:
    p = np.array([n for _, n in data.classes], float) / data.n
    return float(-(p * np.log2(p)).sum())


def joint_entropies(data: Data) -> dict[str, float]:
    k = len(data.classes)
    p = F.col("n") / data.n + EPSILON
    found = data.counts.groupBy("key").agg(F.sum(p * F.log2(p)).alias("s"), F.count_distinct("v").alias("kv"), F.count("*").alias("cells"))
    empty = (F.col("kv") * k - F.col("cells")) * float(EPSILON * np.log2(EPSILON))
    return _per_key(found.select("key", (-(F.col("s") + empty)).alias("value")))


def mutual_information(data: Data) -> dict[str, float]:
    own, both, h = attribute_entropies(data), joint_entropies(data), class_entropy(data)
    return {c: own[c] + h - both[c] for c in own}


def concentration(pairs: DataFrame, total: int) -> DataFrame:
    """``key, value`` of ``key, x, y, n`` rows: how much ``y`` tells about ``x``."""
    size = pairs.groupBy("key").agg(F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    by_x = pairs.groupBy("key", "x").agg((F.sum("n") / total).alias("px")).join(size, "key").groupBy("key").agg(F.sum(F.pow(F.col("px") + F.col("ky") * EPSILON, 2)).alias("own"))
    by_y = pairs.groupBy("key", "y").agg((F.sum("n") / total).alias("py"), F.sum(F.pow(F.col("n") / total + EPSILON, 2)).alias("sq"), F.count("*").alias("seen")).join(size, "key")
    cells = by_y.groupBy("key").agg(F.sum((F.col("sq") + (F.col("kx") - F.col("seen")) * EPSILON**2) / (F.col("py") + F.col("kx") * EPSILON)).alias("cells"))
    return cells.join(by_x, "key").select("key", F.try_divide(F.col("cells") - F.col("own"), 1 - F.col("own")).alias("value"))


@measure("info-theory")
def attr_conc(data: Data, max_attr_num: int = 12):
    """Concentration coefficient of every ordered pair of attributes; of more than
    ``max_attr_num`` attributes, so many are drawn."""
    names = list(data.categories)
    if max_attr_num and len(names) > max_attr_num:
        drawn = np.random.RandomState(data.seed).choice(len(names), max_attr_num, replace=False)
        names = [names[k] for k in drawn]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    if not pairs:
        return []
    half = settled(data.contingency(pairs))
    both = half.select(F.concat_ws(",", "a", "b").alias("key"), "x", "y", "n").unionByName(half.select(F.concat_ws(",", "b", "a").alias("key"), F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    found = _per_key(concentration(both, data.n))
    return [(f"{a},{b}", found[f"{a},{b}"]) for a in names for b in names if a != b]


@measure("info-theory")
def attr_ent(data: Data):
    """Entropy of each attribute in bits."""
    return _in_order(data, attribute_entropies(data))


@measure("info-theory", supervised=True)
def class_conc(data: Data):
    """Concentration coefficient of each attribute and the class."""
    found = concentration(data.counts.withColumnRenamed("v", "x"), data.n)
    return _in_order(data, _per_key(found))


@measure("info-theory", scalar=True, supervised=True)
def class_ent(data: Data):
    """Entropy of the class in bits."""
    return class_entropy(data)


@measure("info-theory", scalar=True, supervised=True)
def eq_num_attr(data: Data):
    """Attributes that an optimal description of the class would need."""
    found = mutual_information(data)
    return len(found) * class_entropy(data) / sum(found.values())


@measure("info-theory", supervised=True)
def joint_ent(data: Data):
    """Joint entropy of each attribute and the class."""
    return _in_order(data, joint_entropies(data))


@measure("info-theory", supervised=True)
def mut_inf(data: Data):
    """Mutual information of each attribute and the class."""
    return _in_order(data, mutual_information(data))


@measure("info-theory", scalar=True, supervised=True)
def ns_ratio(data: Data):
    """Noise over signal of the attributes."""
    signal = sum(mutual_information(data).values())
    return (sum(attribute_entropies(data).values()) - signal) / signal
