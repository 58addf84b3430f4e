"""The 32 summary functions, as aggregations of long frames.

A long frame has a row per value, ``name, v``; each summary is one or more aggregate
expressions, so all summaries of all measures are one ``groupBy``. A null row keeps the
group of a measure without values. ``nan*`` variants leave NaN out. Order statistics come
from a radix selection by group before that, as an aggregate of them would hold all
different values of a group in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("mean", "sd", "var", "count", "histogram", "iq_range", "kurtosis", "max", "median", "min", "quantiles", "range", "skewness", "sum", "powersum", "pnorm")
SUMMARIES = (*BASE, *(f"nan{x}" for x in BASE))
DEFAULT_SUMMARIES = ("mean", "sd")
#: Summaries made of a group's values in order.
ORDERED = ("median", "iq_range", "quantiles")


def _nan() -> Column:
    return F.lit(float("nan"))


def check(names) -> tuple[str, ...]:
    """The summaries of a selection, in order; unknown ones raise ``ValueError``."""
    names = [names] if isinstance(names, str) else list(names or ())
    if "all" in names:
        return SUMMARIES
    if unknown := [x for x in names if x not in SUMMARIES]:
        raise ValueError(f"unknown summaries: {', '.join(map(str, unknown))}")
    return tuple(dict.fromkeys(names))


def _linear(share: float):
    """The ranks (from 0) on either side of a share of ``n`` values, and the part between."""

    def at(n: int) -> tuple[int, int, float]:
        place = share * (n - 1)
        return math.floor(place), math.ceil(place), place - math.floor(place)

    return at


def _plotted(share: float, alpha: float, beta: float):
    """The same by plotting positions."""

    def at(n: int) -> tuple[int, int, float]:
        place = n * share + alpha + share * (1 - alpha - beta)
        k = max(1, min(math.floor(place), n - 1))
        return k - 1, min(k, n - 1), max(0.0, min(place - k, 1.0))

    return at


def ordered(kind: str, args: dict) -> list[list]:
    """What each value of an order statistic is made of: a quantile, or one less another."""
    if kind == "median":
        return [[_linear(0.5)]]
    if kind == "iq_range":
        return [[_linear(0.75), _linear(0.25)]]
    shares, package = (0.0, 0.25, 0.5, 0.75, 1.0), args.get("package", "numpy")
    if package not in ("numpy", "scipy"):
        raise ValueError(f"unknown package {package!r}")
    if package == "numpy":
        return [[_linear(s)] for s in shares]
    return [[_plotted(s, args.get("scipy_alphap", 0.4), args.get("scipy_betap", 0.4))] for s in shares]


def _order_statistics(frame: DataFrame, keys: list[str], made: dict[str, list]) -> DataFrame:
    """``keys`` and the values of ``made`` (places by column) of each group that has any."""
    from facetry.plans.data import selected

    def split(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        found = batch.column("k").dictionary_encode()
        place, v = found.indices.to_numpy(), batch.column("v").to_numpy(zero_copy_only=False)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place, minlength=len(found.dictionary)))
        for key, own in zip(found.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True):
            yield key, v[own]

    def places(n: int) -> list[int]:
        return [rank for parts in made.values() for at in parts for rank in at(n)[:2]]

    def quantile(value: dict[int, float], low: int, high: int, part: float) -> float:
        one, two = value[low], value[high]
        gap = two - one
        return one if one == two else one + gap * part if math.isfinite(gap) else (1 - part) * one + part * two

    name = F.to_json(F.struct(*keys))
    types = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys)
    rows = []
    for key, (n, value) in selected(frame.select(name.alias("k"), "v").filter("v IS NOT NULL"), split, places).items():
        got = [[quantile(value, *at(n)) for at in parts] for parts in made.values()]
        rows.append((key, *[float(g[0] - g[1] if len(g) > 1 else g[0]) for g in got]))
    out = frame.sparkSession.createDataFrame(rows, "_key string, " + ", ".join(f"{c} double" for c in made))
    return out.select(F.from_json("_key", types).alias("_at"), *made).select("_at.*", *made)


def _guard(value: Column, v: Column, plain: bool) -> Column:
    """NaN where there is no value, or (plain) any NaN among them."""
    broken = F.count_if(F.isnan(v)) > 0 if plain else F.lit(False)
    return F.when(broken, _nan()).otherwise(F.coalesce(value.cast("double"), _nan()))


def expressions(name: str, v: Column, low: Column, high: Column, **args) -> list[Column]:
    """Aggregates of the summary over the column ``v``; ``low`` and ``high`` are the
    group's extremes (for histograms)."""
    plain = not name.startswith("nan")
    kind = name if plain else name[3:]
    x = F.when(~F.isnan(v), v)
    n = F.count(x)
    ddof = args.get("ddof", 1)
    if kind == "count":
        return [(F.count(v) if plain else n).cast("double")]
    if kind == "histogram":
        bins, normal = args.get("bins", 10), args.get("normalize", True)
        width = (high - low) / bins
        place = F.when(high > low, F.least(F.floor((x - low) / F.when(high > low, width)), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
        finite = (F.count_if(x.isin(float("inf"), float("-inf"))) == 0) & (n > 0)
        out = []
        for k in range(bins):
            share = F.count_if((place == k) & x.isNotNull()).cast("double")
            out.append(F.when(finite, _guard(F.try_divide(share, n) if normal else share, v, plain)).otherwise(_nan()))
        return out
    if kind in ORDERED:
        return [_guard(F.max(f"_{name}{k}"), v, plain) for k in range(len(ordered(kind, args)))]
    if kind in ("powersum", "pnorm"):
        powers = args.get("p", 2)
        out = []
        for p in powers if isinstance(powers, (list, tuple)) else [powers]:
            if kind == "powersum":
                value = F.sum(F.pow(x, F.lit(float(p))))
            elif p < 0:
                value = _nan()
            elif p == 0:
                value = F.count_if(x != 0).cast("double")
            elif math.isinf(p):
                value = F.max(F.abs(x))
            else:
                value = F.pow(F.sum(F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))
            out.append(F.when(n + F.count_if(F.isnan(v)) > 0, _guard(value, v, plain)).otherwise(_nan()))
        return out
    size = F.count(v)
    m = n.cast("double")
    if kind == "mean":
        value = F.avg(x)
    elif kind in ("var", "sd"):
        value = F.when(size > ddof, F.var_pop(x) * m / F.when(n > ddof, m - ddof))
        value = F.sqrt(value) if kind == "sd" else value
    elif kind == "max":
        value = F.max(x)
    elif kind == "min":
        value = F.min(x)
    elif kind == "range":
        value = F.max(x) - F.min(x)
    elif kind == "sum":
        value = F.sum(x)
    elif kind == "skewness":
        method, bias = args.get("method", 3), args.get("bias", True)
        if method not in (1, 2, 3):
            raise ValueError(f"skewness has no method {method}")
        value = F.skewness(x)
        unbias = F.sqrt(m * (m - 1)) / F.when(n > 2, m - 2)
        if not bias:
            value = F.coalesce(value * unbias, value)
        if method == 2:
            value = F.coalesce(value * unbias, value)
        elif method == 3:
            value = value * F.pow((m - 1) / F.when(n > 0, m), F.lit(1.5))
    elif kind == "kurtosis":
        method, bias = args.get("method", 3), args.get("bias", True)
        if method not in (1, 2, 3):
            raise ValueError(f"kurtosis has no method {method}")
        value = F.kurtosis(x)
        unbias = ((m + 1) * value + 6) * (m - 1) / F.when(n > 3, (m - 2) * (m - 3))
        if not bias:
            value = F.coalesce(unbias, value)
        if method == 2:
            value = F.coalesce(((m + 1) * value + 6) * (m - 1) / F.when(n > 3, (m - 2) * (m - 3)), value)
        elif method == 3:
            value = (value + 3) * F.pow(1 - 1 / F.when(n > 0, m), F.lit(2.0)) - 3
    else:
        raise ValueError(f"unknown summary {name!r}")
    return [_guard(value, v, plain)]


def summarise(long: DataFrame, summaries=DEFAULT_SUMMARIES, arguments: dict[str, dict] | None = None, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """``name, value`` of a frame ``name, v``: names become ``measure.summary``, or
    ``measure.summary.i`` where a summary has several values."""
    summaries, arguments = check(summaries), arguments or {}
    keys, extra = list(by), [c for c in by if c != "name"]
    frame = long.withColumn("v", F.col("v").cast("double"))
    if any(x.endswith("histogram") for x in summaries):
        x = F.when(~F.isnan("v"), F.col("v"))
        ends = frame.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
        frame = frame.join(ends, keys)
    else:
        frame = frame.withColumns({"_low": F.lit(0.0), "_high": F.lit(0.0)})
    made = {}
    for s in summaries:
        if (kind := s.removeprefix("nan")) in ORDERED:
            # a variant may have arguments of its own
            made |= {f"_{s}{k}": parts for k, parts in enumerate(ordered(kind, arguments.get(s, {})))}
    if made:
        # names may be null, so keys are compared as such
        found = _order_statistics(frame, keys, made).withColumnsRenamed({k: f"_of_{k}" for k in keys})
        met = F.lit(True)
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        frame = frame.join(found, met, "left")
    aggs, names = [], []
    for s in summaries:
        found = expressions(s, F.col("v"), F.col("_low"), F.col("_high"), **arguments.get(s, {}))
        for k, value in enumerate(found):
            names.append(s if len(found) == 1 else f"{s}.{k}")
            aggs.append(value.alias(f"a{len(names) - 1}"))
    wide = frame.groupBy(*keys).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(x).alias("s"), F.col(f"a{k}").alias("v")) for k, x in enumerate(names)])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*extra, F.concat_ws(".", "name", "p.s").alias("name"), F.col("p.v").alias("value"))
