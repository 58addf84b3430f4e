"""The neighbour graph is bits of pairs of groups, not rows of pairs."""

import numpy as np
import pytest

import facetry.plans.extractor  # noqa: F401
from facetry.operators import complexity, pairwise
from facetry.plans.data import Data
from facetry.plans.registry import MEASURES


def test_graph(spark, monkeypatch):
    monkeypatch.setattr(complexity, "GROUP", 16, raising=False)
    monkeypatch.setattr(pairwise, "ROWS", 16)
    n = 90
    draw = np.random.RandomState(9)
    x, y = np.round(draw.uniform(size=(n, 3)), 1), np.arange(n) % 3
    x[:2] = [[0, 0, 0], [1, 1, 1]]  # many equal distances, some of them zero
    df = spark.createDataFrame([(k, f"k{y[k]}", *map(float, x[k])) for k in range(n)], "id long, kind string, a double, b double, c double")
    data = Data(df, "kind", row_id="id")
    dist = np.abs(x[:, None] - x[None]).mean(-1)
    k = round(0.15 * n)
    near = np.zeros((n, n), bool)
    for i in range(n):
        others = np.array([j for j in range(n) if j != i])
        near[i, others[np.lexsort((others, dist[i, others]))[:k]]] = True
    edge = (near | near.T) & (y[:, None] == y[None]) & (dist > 0)
    degree = edge.sum(1)
    e = edge.astype(int)
    assert MEASURES["complexity", "density"].function(data) == pytest.approx(1 - edge.sum() / (n * (n - 1)))
    assert MEASURES["complexity", "cls_coef"].function(data) == pytest.approx(1 - np.trace(e @ e @ e) / 2 / (degree * (degree - 1) / 2).sum())
    # two groups a class: four rows for each, whatever the edges' number
    assert complexity._edges(data, "gower", 2.0, 0.15).count() == 12
