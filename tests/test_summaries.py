"""Summaries against numpy on vectors with and without NaN."""

import math

import numpy as np
import pytest

from facetry.functions import summaries as S

VALUES = {"a": [1.0, 2.0, 3.0, 4.0, 10.5], "b": [5.0], "c": [2.0, math.nan, 7.0, -1.0], "d": [], "e": [3.0, 3.0, 3.0], "f": [math.nan, math.nan]}


def want(name, v):
    plain = not name.startswith("nan")
    kind, v = (name, np.array(v, float)) if plain else (name[3:], np.array(v, float))
    size = len(v)
    x = v if plain else v[~np.isnan(v)]
    nan = [math.nan]
    if kind == "count":
        return [float(len(x))]
    if kind == "histogram":
        return list(np.histogram(x, 10)[0] / len(x)) if len(x) and not np.isnan(x).any() else nan * 10
    if kind == "quantiles":
        return list(np.quantile(x, [0, 0.25, 0.5, 0.75, 1])) if len(x) else nan * 5
    if not len(x):
        return nan
    n, m = len(x), x.mean()
    m2 = ((x - m) ** 2).mean()
    with np.errstate(all="ignore"):
        table = {
            "mean": m, "sd": x.std(ddof=1) if size > 1 and n > 1 else math.nan, "var": x.var(ddof=1) if size > 1 and n > 1 else math.nan,
            "iq_range": np.quantile(x, 0.75) - np.quantile(x, 0.25), "max": x.max(), "min": x.min(), "median": np.median(x), "range": np.ptp(x), "sum": x.sum(),
            "skewness": ((x - m) ** 3).mean() / m2**1.5 * ((n - 1) / n) ** 1.5 if m2 else math.nan, "kurtosis": ((x - m) ** 4).mean() / m2**2 * (1 - 1 / n) ** 2 - 3 if m2 else math.nan,
            "powersum": (x**2).sum(), "pnorm": math.sqrt((x**2).sum()),
        }
    return [float(table[kind])]


def test_all_summaries(spark):
    rows = [(k, v) for k, vs in VALUES.items() for v in vs] + [(k, None) for k in VALUES]
    got = {r["name"]: r["value"] for r in S.summarise(spark.createDataFrame(rows, "name string, v double"), "all").collect()}
    for key, vector in VALUES.items():
        for name in S.SUMMARIES:
            values = want(name, vector)
            names = [f"{key}.{name}"] if len(values) == 1 else [f"{key}.{name}.{i}" for i in range(len(values))]
            assert [got[x] for x in names] == pytest.approx(values, nan_ok=True), (key, name)


def test_arguments(spark):
    frame = spark.createDataFrame([("a", v) for v in VALUES["a"]], "name string, v double")
    got = {r["name"]: r["value"] for r in S.summarise(frame, ["powersum", "pnorm", "quantiles", "histogram", "sd"], {"powersum": {"p": [1, 3]}, "pnorm": {"p": [0, math.inf, -1]}, "quantiles": {"package": "scipy"}, "histogram": {"bins": 2, "normalize": False}, "sd": {"ddof": 0}}).collect()}
    x = np.array(VALUES["a"])
    assert got["a.powersum.0"] == x.sum() and got["a.powersum.1"] == (x**3).sum()
    assert got["a.pnorm.0"] == 5 and got["a.pnorm.1"] == 10.5 and math.isnan(got["a.pnorm.2"])
    assert got["a.sd"] == pytest.approx(x.std()) and [got["a.histogram.0"], got["a.histogram.1"]] == [4, 1]
    m = 0.25 * 5 + 0.4 + 0.25 * 0.2
    assert got["a.quantiles.1"] == pytest.approx(x[0] + (m - 1) * (x[1] - x[0]))


def test_unknown():
    with pytest.raises(ValueError):
        S.check(["mean", "nope"])
    assert S.check("all") == S.SUMMARIES and len(S.SUMMARIES) == 32
