"""Order statistics and the summaries made of them are bounded in what reaches the driver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.plans import data as module
from facetry.plans.data import order_statistics


def test_passes_send_few_codes(spark, monkeypatch):
    """Many ranks over many different values: what a pass sends to the driver stays near
    the budget of codes (it was all different values under the wanted prefixes)."""
    draw = np.random.RandomState(0)
    x = np.concatenate([draw.uniform(900, 99_000, 20_000), np.repeat([3.0, -7.5, math.inf], 40)])
    df = spark.createDataFrame([(float(v), float(k % 3)) for k, v in enumerate(x)], "a double, b double").repartition(3)
    sent = []
    for name in ("collect", "toLocalIterator"):
        plain = getattr(type(df), name)

        def counted(self, *given, _plain=plain, **more):
            rows = list(_plain(self, *given, **more))
            sent.append(sum(len(v) // 8 if isinstance(v, (bytes, bytearray)) else 1 for r in rows for v in r) // 2)
            return iter(rows)

        monkeypatch.setattr(type(df), name, counted)
    monkeypatch.setattr(module, "BRACKET", 500)
    monkeypatch.setattr(module, "CODES", 1024, raising=False)
    shares = [k / 40 for k in range(40)]
    got = order_statistics(df, {"a": F.col("a"), "b": F.col("b")}, shares)
    assert got["a"] == pytest.approx(np.quantile(x, shares)) and got["b"] == np.quantile(np.arange(len(x)) % 3, shares).tolist()
    assert sent and max(sent) <= 2500


def test_summaries_of_order_hold_no_values(spark):
    """No plan aggregates the values of a group in one task (percentiles did)."""
    from facetry.functions import summaries as S

    draw = np.random.RandomState(1)
    v = {"a": draw.normal(size=3000), "b": np.append(draw.normal(size=7), math.inf), "c": np.full(4, 2.0)}
    frame = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("d", None)], "name string, v double")
    found = S.summarise(frame, ["median", "naniq_range", "quantiles"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan and "collect_list" not in plan
    got = {r["name"]: r["value"] for r in found.collect()}
    for k, xs in v.items():
        assert got[f"{k}.median"] == pytest.approx(np.median(xs))
        assert got[f"{k}.naniq_range"] == pytest.approx(np.quantile(xs, 0.75) - np.quantile(xs, 0.25))
        assert [got[f"{k}.quantiles.{j}"] for j in range(5)] == pytest.approx([np.quantile(xs, s) if s < 1 else max(xs) for s in (0, 0.25, 0.5, 0.75, 1)])
    assert math.isnan(got["d.median"])
