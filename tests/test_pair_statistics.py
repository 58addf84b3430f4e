"""Statistics of pairs from cells of a grid against plain matrices, and what leaves a cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.operators import pairwise
from facetry.plans.data import Data

N, D = 150, 5


@pytest.fixture(scope="module")
def rows():
    draw = np.random.RandomState(3)
    x = draw.uniform(-3, 4, (N, D)) + 1000
    x[40:60] = x[:20]  # copies, also of other classes
    x[:, 4] = np.round(x[:, 4])
    return x, np.arange(N) % 4


@pytest.fixture(scope="module")
def data(spark, rows):
    x, y = rows
    df = spark.createDataFrame([(int(k), f"k{y[k]}", *map(float, x[k])) for k in range(N)], "id long, kind string, a double, b double, c double, d double, e double")
    return Data(df, "kind", row_id="id", seed=2)


@pytest.mark.parametrize("least", [1 << 18, 1024])
@pytest.mark.parametrize("metric", ["euclidean", "gower", "cityblock", "chebyshev"])
def test_statistics(data, rows, monkeypatch, least, metric):
    monkeypatch.setattr(pairwise, "LEAST", least)
    monkeypatch.setattr(pairwise, "ROWS", 16)
    monkeypatch.setattr(pairwise, "TILE", 8, raising=False)
    x, y = rows
    gap = np.abs(x[:, None] - x[None])
    dist = {"euclidean": np.sqrt((gap**2).sum(-1)), "gower": gap.mean(-1), "cityblock": gap.sum(-1), "chebyshev": gap.max(-1)}[metric]
    packed = pairwise.blocks(data, False)
    other = ~np.eye(N, dtype=bool)
    for part in ("sums", "near"):
        found = pairwise.row_statistics(data, metric, 2, packed, None, None, part).collect()
        assert len(found) == N * 4
        for r in found:
            own = other[r["i"]] & (y == r["c"])
            d = np.where(own, dist[r["i"]], np.inf)
            assert r["n"] == own.sum() and r["y"] == y[r["i"]]
            if part == "sums":
                assert r["s"] == pytest.approx(dist[r["i"]][own].sum()) and r["q"] == pytest.approx((dist[r["i"]][own] ** 2).sum())
            if "lo" in r:
                assert r["lo"] == pytest.approx(d.min(), abs=1e-12)
            if part == "near":
                assert r["at"] == np.flatnonzero(d <= d.min() + 1e-12)[0]
            else:
                assert r["hi"] == pytest.approx(dist[r["i"]][own].max())


def test_rows_leave_a_cell_once(data, monkeypatch):
    """One cell of ten blocks gives a row for each row and class, not for each block too."""
    monkeypatch.setattr(pairwise, "ROWS", 16)
    packed = pairwise.blocks(data, False)
    assert packed.count() >= 10
    given, plain = [], pairwise.cells

    def counted(*args, **more):
        given.append(plain(*args, **more))
        return given[-1]

    monkeypatch.setattr(pairwise, "cells", counted, raising=False)
    pairwise.row_statistics(data, "gower", 2, packed, None).agg(F.count("*")).collect()
    assert given[0].count() == N * 4
