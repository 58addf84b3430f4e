"""The linear machine is at its optimum, in time that grows with the rows and no faster."""

import time

import numpy as np
import pytest

from facetry.functions.kernels import linear_svm


def objective(w, x, y, c=2.0):
    a = np.hstack([x, np.ones((len(x), 1))])
    return 0.5 * w @ w + c * np.maximum(0, 1 - y * (a @ w)).sum()


@pytest.mark.parametrize("apart", [0.0, 0.5, 3.0])
def test_optimum(apart):
    draw = np.random.RandomState(0)
    y = np.where(np.arange(300) % 2 == 0, 1.0, -1.0)
    x = draw.normal(size=(300, 6)) + apart * y[:, None] * np.array([1, 0.5, 0, 0, 0, 0])
    w = linear_svm(x, y)
    best = objective(w, x, y)
    # convex: no step from the optimum helps
    for size in (1e-2, 1e-3, 1e-4):
        assert min(objective(w + size * draw.normal(size=7), x, y) for _ in range(300)) >= best - 1e-7 * abs(best)


def test_many_overlapping_rows():
    draw = np.random.RandomState(1)
    x = draw.normal(size=(20_000, 64))
    y = np.where(draw.uniform(size=20_000) < 0.5, 1.0, -1.0)
    began = time.process_time()
    w = linear_svm(x, y)
    assert time.process_time() - began < 60
    a = np.hstack([x, np.ones((len(x), 1))])
    assert objective(w, x, y) < objective(np.zeros(65), x, y) and np.isfinite(a @ w).all()
