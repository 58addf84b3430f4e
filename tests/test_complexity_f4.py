import itertools

import numpy as np
import pytest

from facetry.operators import complexity
from facetry.plans.data import Data


def alone(x, y, a, b):
    """f4 of two classes on arrays."""
    keep = (y == a) | (y == b)
    x, first = x[keep], y[keep] == a
    total, left = len(x), list(range(x.shape[1]))
    while left and len(x):
        one, two = x[first][:, left], x[~first][:, left]
        inside = np.zeros((len(x), len(left)), bool)
        if len(one) and len(two):
            inside = (x[:, left] >= np.maximum(one.min(0), two.min(0))) & (x[:, left] <= np.minimum(one.max(0), two.max(0)))
        best = int(inside.sum(0).argmin())
        x, first = x[inside[:, best]], first[inside[:, best]]
        del left[best]
    return len(x) / total


def test_f4_has_no_row_bound(spark, monkeypatch):
    monkeypatch.setattr(complexity, "MAX_TASK_ROWS", 10)
    draw = np.random.RandomState(2)
    y = draw.choice(["a", "b", "c"], 300)
    x = draw.normal(size=(300, 3)) + np.array([[0, 0, 0], [1, 2, 0], [9, 0, 1]])[[ord(v) - 97 for v in y]]
    df = spark.createDataFrame([(k, c, *map(float, v)) for k, (c, v) in enumerate(zip(y.tolist(), x, strict=True))], "id long, y string, a double, b double, c double")
    got = dict(complexity.f4(Data(df, "y", ["a", "b", "c"], "id")))
    assert got == {f"{a},{b}": pytest.approx(alone(x, y, a, b)) for a, b in itertools.combinations("abc", 2)} and any(0 < v < 1 for v in got.values())
