"""Trees and neighbours see equal rows once: copies change no value and meet no bound."""

import numpy as np
import pytest

import facetry.plans.extractor  # noqa: F401
from facetry.operators import landmarking, modelbased
from facetry.plans.data import Data
from facetry.plans.registry import MEASURES

TREES = ("best_node", "random_node", "worst_node", "elite_nn", "one_nn")


def rows(times):
    draw = np.random.RandomState(6)
    x = np.round(draw.normal(size=(40, 3)) * 2) / 2
    y = np.where(x[:, 0] + draw.normal(size=40) > 0, "a", "b")
    return [(k + 40 * t, str(y[k]), *map(float, x[k])) for t in range(times) for k in range(40)]


def plain(x, y, ids, fold, metric_columns):
    """Scores of the nearest row of the other folds, the least id of equals."""
    out = []
    for f in np.unique(fold):
        hits = []
        for i in np.flatnonzero(fold == f):
            d = ((x[:, metric_columns] - x[i, metric_columns]) ** 2).sum(1)
            d[fold == f] = np.inf
            hits.append(y[np.lexsort((ids, d))[0]] == y[i])
        out.append(np.mean(hits))
    return out


def test_copies_stay_within_the_bound(spark, monkeypatch):
    schema = "id long, kind string, a double, b double, c double"
    data = Data(spark.createDataFrame(rows(4), schema), "kind", row_id="id")
    monkeypatch.setattr(landmarking, "MAX_TASK_ROWS", 40)
    monkeypatch.setattr(modelbased, "MAX_EXACT_ROWS", 40)
    found = {m: [v for _, v in MEASURES["landmarking", m].function(data)] for m in TREES}
    held = sorted(landmarking.folded(data).collect(), key=lambda r: r["_id"])
    x, y = np.array([r["x"] for r in held]), np.array([r["_y"] for r in held])
    assert found["one_nn"] == pytest.approx(plain(x, y, np.arange(160), np.array([r["fold"] for r in held]), [0, 1, 2]))
    # the tree of weighted rows is that of all rows
    from facetry.functions.kernels import Tree

    tree = Tree(x, (y == "b").astype(int), 2)
    assert MEASURES["model-based", "leaves"].function(data) == sum(f < 0 for f in tree.feature)
    assert [v for _, v in MEASURES["model-based", "var_importance"].function(data)] == pytest.approx(tree.importances().tolist())
