"""Bootstrap confidence intervals.

Each replicate draws exactly as many rows as there are, with replacement: draw ``i`` of a
replicate takes the row whose rank (by id) is a hash of seed, replicate and ``i``, so a
draw is the same in every run and partitioning. Ranks are made once for all replicates,
which then run some at a time, as their jobs are independent."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.plans.data import Data
from facetry.session import settled

#: Replicates that run at a time.
AT_ONCE = 8


def numbered(data: Data) -> DataFrame:
    """The rows with their rank ``_rank``, stored."""
    ranks = data.ranked().select(F.col("_id").alias("_its"), F.col("rank").alias("_rank"))
    return settled(data.df.join(ranks, F.col(data.row_id).cast("long") == F.col("_its")).drop("_its"))


def replicate(rows: DataFrame, n: int, row_id: str, number: int, seed: int) -> DataFrame:
    """A resample of ``numbered`` rows; its ids are the numbers of the draws."""
    draws = rows.sparkSession.range(n).select(F.col("id").alias("_draw"), F.pmod(F.xxhash64(F.lit(seed), F.lit(number), F.col("id")), F.lit(n)).alias("_rank"))
    drawn = draws.join(rows.drop(row_id), "_rank")
    return drawn.withColumnRenamed("_draw", row_id).drop("_rank").select(*[F.col(f"`{c}`") for c in rows.columns if c != "_rank"])


def intervals(point: float, sample: np.ndarray, confidences: list[float]) -> list[tuple[float, float]]:
    """Basic (reflected) intervals of each confidence."""
    out = []
    for c in confidences:
        low, high = np.nanquantile(sample - point, [1 - (1 - c) / 2, (1 - c) / 2]) if np.isfinite(sample).any() else (math.nan, math.nan)
        out.append((float(point - low), float(point - high)))
    return out


def with_confidence(extractor, sample_num: int = 128, confidence=0.95, arguments: dict | None = None, verbose: int = 0) -> DataFrame:
    """``name, value, confidence, low, high`` (and ``time`` of the values, if it is
    measured) of an extractor that has a dataset."""
    from facetry.plans.extractor import Extractor

    levels = list(confidence) if isinstance(confidence, (list, tuple)) else [confidence]
    if any(not 0 < c < 1 for c in levels):
        raise ValueError("a confidence is between 0 and 1")
    data = extractor.data
    if data is None:
        raise TypeError("fit a dataset first")
    if not data.row_id:
        raise ValueError("bootstrap needs a row id")
    found = extractor.extract(arguments, verbose=verbose).collect()
    point = {r["name"]: r["value"] for r in found}
    seed, rows = extractor.random_state or 0, numbered(data)

    def run(k: int) -> dict[str, float]:
        own = Extractor(extractor.groups, [m.name for m in extractor.measures], extractor.summary, random_state=seed + k, suppress_warnings=True, **extractor.folds)
        own.data = data.derive(replicate(rows, data.n, data.row_id, k, seed), seed=seed + k)
        got = {r["name"]: r["value"] for r in own.extract(arguments).collect()}
        if verbose:
            print(f"replicate {k + 1} of {sample_num}", flush=True)
        return got

    with ThreadPoolExecutor(AT_ONCE) as pool:
        replicates = list(pool.map(run, range(sample_num)))
    sample = {x: [got.get(x, math.nan) for got in replicates] for x in point}
    out = [(x, point[x], c, low, high) for x, v in sample.items() for c, (low, high) in zip(levels, intervals(point[x], np.array(v, float), levels), strict=True)]
    made = data.spark.createDataFrame(out, "name string, value double, confidence double, low double, high double")
    if extractor.measure_time:
        times = data.spark.createDataFrame([(r["name"], r["time"]) for r in found], "name string, time double")
        made = made.join(F.broadcast(times), "name")
    return made.orderBy("name", "confidence")
