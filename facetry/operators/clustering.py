"""Clustering measures with the classes as clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from facetry.operators.pairwise import shared_statistics
from facetry.plans.data import NAN, Data
from facetry.plans.registry import measure


def _class_pairs(data: Data, metric: str):
    """Distances by ordered pair of classes."""
    stats = shared_statistics(data, metric, part="sums")
    return {(r["y"], r["c"]): r for r in stats.groupBy("y", "c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("q").alias("q")).collect()}


@measure("clustering", scalar=True, supervised=True)
def vdu(data: Data, dist_metric: str = "euclidean"):
    """Least distance between classes, each divided by the classes' pairs, over the
    largest one inside a class."""
    sizes = [n for _, n in data.classes]
    pairs = _class_pairs(data, dist_metric)
    between = [r["lo"] / (sizes[a] * sizes[b]) for (a, b), r in pairs.items() if a < b]
    within = [r["hi"] for (a, b), r in pairs.items() if a == b]
    return min(between) / max(within) if between and within and max(within) else NAN


@measure("clustering", scalar=True, supervised=True)
def vdb(data: Data):
    """Davies-Bouldin index."""
    names = [c for c, _ in data.classes]
    centres = np.array([[m["mean"] for m in data.by_class[c]] for c in names])
    held = F.broadcast(data.spark.createDataFrame([(c, [float(v) for v in centre]) for c, centre in zip(names, centres, strict=True)], "_y string, centre array<double>"))  # a row for each class
    away = F.sqrt(F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    spread = {r["_y"]: r["s"] for r in data.matrix.join(held, "_y").groupBy("_y").agg(F.avg(away).alias("s")).collect()}
    worst = []
    for i, a in enumerate(names):
        worst.append(max(((spread[a] + spread[b]) / np.linalg.norm(centres[i] - centres[j]) for j, b in enumerate(names) if j != i), default=NAN))
    return float(np.mean(worst)) if len(names) > 1 else NAN


@measure("clustering", "int", scalar=True, supervised=True)
def int_(data: Data, dist_metric: str = "euclidean"):
    """Mean distance between classes."""
    k = len(data.classes)
    if k < 2:
        return NAN
    pairs = _class_pairs(data, dist_metric)
    return sum(r["s"] / r["n"] for (a, b), r in pairs.items() if a < b) * 2 / (k * (k - 1))


@measure("clustering", scalar=True, supervised=True)
def sil(data: Data, dist_metric: str = "euclidean", sample_frac: float | None = None):
    """Mean silhouette."""
    if sample_frac is not None:
        data = data.subsample(sample_frac)
    stats = shared_statistics(data, dist_metric, part="sums")
    mean = F.col("s") / F.col("n")
    rows = stats.groupBy("i", "y").agg(F.max(F.when(F.col("c") == F.col("y"), mean)).alias("a"), F.min(F.when(F.col("c") != F.col("y"), mean)).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return rows.agg(F.avg(value)).first()[0]


@measure("clustering", scalar=True, supervised=True)
def pb(data: Data, dist_metric: str = "euclidean"):
    """Correlation of sharing a class with the distance, over all pairs of rows."""
    own = [0, 0.0, 0.0]
    all_ = [0, 0.0, 0.0]
    for (a, b), r in _class_pairs(data, dist_metric).items():
        for total in (all_, own) if a == b else (all_,):
            for k, v in enumerate((r["n"], r["s"], r["q"])):
                total[k] += v
    n, m = all_[0], own[0]
    var = all_[2] / n - (all_[1] / n) ** 2
    share = m / n
    return (own[1] / n - share * all_[1] / n) / math.sqrt(share * (1 - share) * var) if 0 < m < n and var > 0 else NAN


@measure("clustering", scalar=True, supervised=True)
def ch(data: Data):
    """Calinski-Harabasz index."""
    n, k = data.n, len(data.classes)
    total = {c: m["mean"] for c, m in data.moments.items()}
    between = sum(m["n"] * (m["mean"] - mean) ** 2 for c, _ in data.classes for m, mean in zip(data.by_class[c], total.values(), strict=True))
    within = sum(m["n"] * m["var"] for c, _ in data.classes for m in data.by_class[c])
    return between * (n - k) / (within * (k - 1)) if within and k > 1 else 1.0


@measure("clustering", scalar=True, supervised=True)
def nre(data: Data):
    """Entropy of the class shares in nats."""
    p = np.array([n for _, n in data.classes]) / data.n
    return float(-(p * np.log(p)).sum())


@measure("clustering", scalar=True, supervised=True)
def sc(data: Data, size: int = 15, normalize: bool = False):
    """Number (or share) of classes with fewer than ``size`` rows."""
    small = sum(n < size for _, n in data.classes)
    return small / len(data.classes) if normalize else small
