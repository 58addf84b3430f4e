"""Values of measures that SQL can't say, against plain versions over the same rows."""

import math

import numpy as np
import pytest

from facetry.operators import complexity
from facetry.plans.data import Data
from facetry.plans.registry import MEASURES

GROUPS, COLUMNS, ROWS = 3, 4, 72


@pytest.fixture(scope="module")
def table():
    """``x, y``: three overlapping groups, with ties in the last column."""
    draw = np.random.RandomState(8)
    y = np.arange(ROWS) % GROUPS
    x = draw.normal(0, 1, (ROWS, COLUMNS)) + y[:, None] * np.array([1.5, 0.7, 0.0, 1.0])
    x[:, 3] = np.round(x[:, 3])
    return x, y


@pytest.fixture(scope="module")
def data(spark, table):
    x, y = table
    rows = [(k, *map(float, x[k]), f"k{y[k]}") for k in range(ROWS)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind string")
    return Data(df, "kind", row_id="id", seed=5)


def values(data, group, name, **hyper):
    found = MEASURES[group, name].function(data, **hyper)
    if hasattr(found, "collect"):
        found = [(r["key"], r["value"]) for r in found.collect()]
        return np.array([v for _, v in sorted(found, key=lambda r: int(r[0]))])
    return np.array([v for _, v in found]) if isinstance(found, list) else float(found)


# ---- statistical


def scatters(x, y):
    within = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in range(GROUPS))
    total = (x - x.mean(0)).T @ (x - x.mean(0))
    return within, total - within


def test_discriminant_statistics(data, table):
    within, between = scatters(*table)
    roots = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1][: GROUPS - 1]
    assert values(data, "statistical", "can_cor") == pytest.approx(np.sqrt(roots / (1 + roots)))
    assert values(data, "statistical", "nr_disc") == GROUPS - 1
    assert values(data, "statistical", "w_lambda") == pytest.approx(np.prod(1 / (1 + roots)))
    assert values(data, "statistical", "p_trace") == pytest.approx((roots / (1 + roots)).sum())
    assert values(data, "statistical", "lh_trace") == pytest.approx(roots.sum())
    assert values(data, "statistical", "roy_root") == pytest.approx(roots[0])
    assert values(data, "statistical", "roy_root", criterion="cancor") == pytest.approx(roots[0] / (1 + roots[0]))


def test_covariance_statistics(data, table):
    x, y = table
    assert values(data, "statistical", "eigenvalues") == pytest.approx(np.linalg.eigvalsh(np.cov(x.T)))
    own = [np.cov(x[y == k].T) for k in range(GROUPS)]
    sizes = np.array([(y == k).sum() for k in range(GROUPS)])
    pooled = sum((n - 1) * s for n, s in zip(sizes, own)) / (ROWS - GROUPS)
    gamma = 1 - (2 * COLUMNS**2 + 3 * COLUMNS - 1) / (6 * (COLUMNS + 1) * (GROUPS - 1)) * ((1 / (sizes - 1)).sum() - 1 / (ROWS - GROUPS))
    m = gamma * ((ROWS - GROUPS) * math.log(np.linalg.det(pooled)) - sum((n - 1) * math.log(np.linalg.det(s)) for n, s in zip(sizes, own)))
    assert values(data, "statistical", "sd_ratio") == pytest.approx(math.exp(m / (COLUMNS * (ROWS - GROUPS))))
    shares = np.cumsum(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    kept = int((shares / shares[-1] <= 0.95).sum()) + 1
    assert values(data, "complexity", "t3") == kept / ROWS and values(data, "complexity", "t4") == kept / COLUMNS


def test_normality_counts(spark):
    draw = np.random.RandomState(1)
    rows = [(k, float(draw.normal()), float(draw.exponential()), float(draw.normal(3, 9))) for k in range(400)]
    found = Data(spark.createDataFrame(rows, "id long, a double, b double, c double"), row_id="id")
    for method in ("shapiro-wilk", "dagostino-pearson", "anderson-darling"):
        assert values(found, "statistical", "nr_norm", method=method) == 2


# ---- trees


class PlainTree:
    """Grown by trying every threshold of every column, node by node."""

    def __init__(self, x, y, depth=0, most=None):
        self.rows, self.depth, self.split = len(y), depth, None
        self.counts = np.bincount(y, minlength=GROUPS)
        self.impurity = 1 - ((self.counts / len(y)) ** 2).sum()
        if len(set(y.tolist())) < 2 or depth == most:
            return
        best = None
        for j in range(x.shape[1]):
            levels = sorted(set(x[:, j].tolist()))
            for a, b in zip(levels, levels[1:]):
                low = x[:, j] <= a
                cost = sum(s.sum() * (1 - ((np.bincount(y[s], minlength=GROUPS) / s.sum()) ** 2).sum()) for s in (low, ~low))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, j, (a + b) / 2, low)
        if best:
            _, self.split, self.cut, low = best
            self.kids = (PlainTree(x[low], y[low], depth + 1, most), PlainTree(x[~low], y[~low], depth + 1, most))

    def nodes(self):
        yield self
        if self.split is not None:
            for kid in self.kids:
                yield from kid.nodes()

    def say(self, row):
        at = self
        while at.split is not None:
            at = at.kids[int(row[at.split] > at.cut)]
        return int(at.counts.argmax())

    def importances(self):
        out = np.zeros(COLUMNS)
        for t in self.nodes():
            if t.split is not None:
                out[t.split] += t.rows * t.impurity - sum(k.rows * k.impurity for k in t.kids)
        return out / out.sum() if out.sum() else out


def test_model_based(data, table):
    every = list(PlainTree(*table).nodes())
    leaves, inner = [t for t in every if t.split is None], [t for t in every if t.split is not None]
    of = lambda name: values(data, "model-based", name)
    assert of("leaves") == len(leaves) and of("nodes") == len(inner)
    assert of("nodes_per_attr") == len(inner) / COLUMNS and of("nodes_per_inst") == len(inner) / ROWS
    assert of("tree_depth").tolist() == [t.depth for t in every]
    depths = np.array([t.depth for t in leaves])
    assert of("leaves_branch").tolist() == depths.tolist()
    assert of("leaves_corrob") == pytest.approx([t.rows / ROWS for t in leaves])
    assert of("tree_shape") == pytest.approx(depths * 2.0**-depths)
    assert of("leaves_homo") == pytest.approx(len(leaves) / (depths * 2.0**-depths))
    said = np.bincount([t.counts.argmax() for t in leaves], minlength=GROUPS)
    assert of("leaves_per_class") == pytest.approx(said[said > 0] / len(leaves))
    levels = np.bincount([t.depth for t in inner])
    assert of("nodes_per_level").tolist() == levels.tolist()
    used = np.bincount([t.split for t in inner], minlength=COLUMNS)
    assert of("nodes_repeated").tolist() == used[used > 0].tolist()
    assert of("var_importance") == pytest.approx(PlainTree(*table).importances())
    by_depth = np.bincount(depths)
    chance = [2.0 ** (-(2.0**-d) * by_depth[d]) for d in range(len(by_depth)) if by_depth[d]][::-1]
    assert of("tree_imbalance") == pytest.approx([-p * math.log2(p) for p in chance])


def test_tree_options(data, table):
    short = data.derive(data.df, tree={"max_depth": 2})
    assert values(short, "model-based", "tree_depth").max() == 2
    assert values(short, "model-based", "leaves") == sum(t.split is None for t in PlainTree(*table, most=2).nodes())
    fat = data.derive(data.df, tree={"min_samples_leaf": 9})
    assert values(fat, "model-based", "leaves_corrob").min() * ROWS >= 9 - 1e-9
    assert values(data.derive(data.df, tree={"min_samples_split": 30}), "model-based", "leaves") < values(data, "model-based", "leaves")
    assert values(data.derive(data.df, tree={"min_impurity_decrease": 0.2}), "model-based", "leaves") < values(data, "model-based", "leaves")
    assert values(data.derive(data.df, tree={"kind": "binned"}), "model-based", "leaves") >= 3
    with pytest.raises(ValueError):
        values(data.derive(data.df, tree={"depth": 2}), "model-based", "leaves")


# ---- landmarking


def folds(y, count=10):
    """Folds of rows in id order: the classes, by first row, are laid out one after the
    other and dealt in turn; a class fills its folds in order."""
    out = np.zeros(len(y), int)
    place = 0
    for k in sorted(set(y.tolist()), key=lambda k: y.tolist().index(k)):
        own = np.flatnonzero(y == k)
        dealt = [0] * count
        for _ in own:
            dealt[place % count] += 1
            place += 1
        out[own] = np.repeat(np.arange(count), dealt)
    return out


def scores(table, predict):
    x, y = table
    fold = folds(y)
    return [float(np.mean([predict(x[fold != f], y[fold != f], row) == k for row, k in zip(x[fold == f], y[fold == f])])) for f in range(10)]


def nearest(x, y, row, j=slice(None)):
    return int(y[((x[:, j] - row[j]) ** 2).reshape(len(x), -1).sum(1).argmin()])


def bayes(x, y, row):
    smooth = 1e-9 * x.var(0).max()
    logs = [math.log((y == k).mean()) - 0.5 * sum(math.log(2 * math.pi * (v + smooth)) + (a - m) ** 2 / (v + smooth) for a, m, v in zip(row, x[y == k].mean(0), x[y == k].var(0))) for k in range(GROUPS)]
    return int(np.argmax(logs))


def discriminant(x, y, row):
    within = scatters(x, y)[0] / len(y)
    return int(np.argmax([math.log((y == k).mean()) - 0.5 * (row - x[y == k].mean(0)) @ np.linalg.solve(within, row - x[y == k].mean(0)) for k in range(GROUPS)]))


def test_nearest_rows():
    from facetry.operators.landmarking import nearest_rows

    draw = np.random.RandomState(3)
    a, b = draw.randint(0, 4, (40, 3)) + 1e6, draw.randint(0, 4, (60, 3)) + 1e6
    barred = draw.rand(40, 60) < 0.3
    barred[7] = True
    dist = np.where(barred, np.inf, ((a[:, None] - b[None]) ** 2).sum(-1))
    best, at = nearest_rows(a.astype(float), b.astype(float), barred)
    assert (best == dist.min(1)).all() and (at[best < np.inf] == dist.argmin(1)[best < np.inf]).all() and best[7] == np.inf


def test_landmarking(data, table):
    of = lambda name: values(data, "landmarking", name)
    order = lambda x, y: np.argsort(PlainTree(x, y).importances(), kind="stable")
    drawn = int(np.random.RandomState(5).randint(0, COLUMNS))
    single = lambda x, y, row, j: PlainTree(x[:, [j]], y, most=1).say(row[[j]])
    assert of("naive_bayes") == pytest.approx(scores(table, bayes))
    assert of("linear_discr") == pytest.approx(scores(table, discriminant))
    assert of("one_nn") == pytest.approx(scores(table, nearest))
    assert of("best_node") == pytest.approx(scores(table, lambda x, y, r: PlainTree(x, y, most=1).say(r)))
    assert of("random_node") == pytest.approx(scores(table, lambda x, y, r: single(x, y, r, drawn)))
    worst, best = {}, {}

    def ranked(x, y, which, store):
        key = x.tobytes()
        if key not in store:
            store[key] = int(order(x, y)[which])
        return store[key]

    assert of("worst_node") == pytest.approx(scores(table, lambda x, y, r: single(x, y, r, ranked(x, y, 0, worst))))
    assert of("elite_nn") == pytest.approx(scores(table, lambda x, y, r: nearest(x, y, r, ranked(x, y, -1, best))))


def test_subsamples_keep_all_options(spark, table):
    """A column of another scale weighs nothing once rescaled, also in a subsample."""
    x, y = table
    rows = [(k, *map(float, x[k] * np.array([1, 1000, 1, 1])), f"k{y[k]}") for k in range(ROWS)]
    found = Data(spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind string"), "kind", row_id="id", rescale="standard", seed=5)
    half = found.subsample(0.75)
    assert half.n == 54 and half.rescale == "standard" and half.seed == 5
    scaled = np.array([r["x"] for r in half.matrix.orderBy("_id").collect()])
    assert scaled.std(0) == pytest.approx([1] * COLUMNS) and values(found, "landmarking", "one_nn", lm_sample_frac=0.75).mean() > 0.4
    ids = {r["id"] for r in half.df.select("id").collect()}
    assert ids == {r["id"] for r in found.derive(found.df.repartition(7)).subsample(0.75).df.select("id").collect()}
    assert math.isfinite(values(found, "clustering", "sil", sample_frac=0.5))


# ---- neighbours


def gower(x):
    z = (x - x.min(0)) / (x.max(0) - x.min(0))
    return np.abs(z[:, None] - z[None]).mean(-1)


def graph(table, share=0.15):
    x, y = table
    dist = gower(x)
    edges = np.zeros((ROWS, ROWS), bool)
    for i in range(ROWS):
        near = [j for j in np.argsort(np.where(np.arange(ROWS) == i, np.inf, dist[i]), kind="stable")[: round(share * ROWS)]]
        for j in near:
            if y[i] == y[j] and dist[i, j] > 0:
                edges[i, j] = edges[j, i] = True
    return edges


def test_neighbour_graph(data, table):
    edges = graph(table).astype(float)
    assert values(data, "complexity", "density") == pytest.approx(1 - edges.sum() / (ROWS * (ROWS - 1)))
    degree = edges.sum(1)
    assert values(data, "complexity", "cls_coef") == pytest.approx(1 - np.trace(edges @ edges @ edges) / (degree * (degree - 1)).sum())
    roots, vectors = np.linalg.eigh(edges)
    lead = np.abs(vectors[:, -1]) / np.abs(vectors[:, -1]).max()
    assert roots[-1] - roots[-2] > 1e-3
    assert values(data, "complexity", "hubs") == pytest.approx(1 - lead, abs=1e-6)


def test_leading_vector():
    draw = np.random.RandomState(2)
    a = draw.rand(300, 300) < 0.05
    a = (a | a.T).astype(float)
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert complexity.leading_vector(lambda v: a @ v, 300) == pytest.approx(want / want.max(), abs=1e-6)
    with pytest.raises(complexity.NotConverged):
        complexity.leading_vector(lambda v: a @ v, 300, basis=2, restarts=1)


def test_spanning_tree(data, table):
    x, y = table
    dist = gower(x)
    dist[dist == 0] = np.inf  # zero distances are no edges
    inside, border = {0}, set()
    while len(inside) < ROWS:
        _, i, j = min((dist[i, j], i, j) for i in inside for j in range(ROWS) if j not in inside)
        inside.add(j)
        if y[i] != y[j]:
            border |= {i, j}
    assert values(data, "complexity", "n1") == pytest.approx(len(border) / ROWS)


def test_spheres(data, table):
    x, y = table
    dist = gower(x)
    enemy = [int(np.where(y == y[i], np.inf, dist[i]).argmin()) for i in range(ROWS)]
    radius = {}

    def reach(i, path):
        if i in radius:
            return radius[i]
        if enemy[enemy[i]] == i:
            radius[i] = radius[enemy[i]] = dist[i, enemy[i]] / 2
        elif i in path:
            radius[i] = 0.0
        else:
            radius[i] = abs(dist[i, enemy[i]] - reach(enemy[i], path | {i}))
        return radius[i]

    for i in range(ROWS):
        reach(i, frozenset())
    holds = [[j for j in range(ROWS) if dist[i, j] <= radius[i]] for i in range(ROWS)]
    left = [1] * ROWS
    for i in sorted(range(ROWS), key=lambda i: (-len(holds[i]), i)):
        if left[i]:
            total = sum(left[j] for j in holds[i])
            for j in holds[i]:
                left[j] = 0
            left[i] = total
    assert values(data, "complexity", "t1") == pytest.approx(sum(v > 0 for v in left) / ROWS)


def test_interpolated_neighbours(data, table):
    x, y = table
    made = sorted((r["_id"], r["_y"], r["x"]) for r in complexity.interpolated(data).collect())
    assert len(made) == ROWS
    span = x.max(0) - x.min(0)
    wrong = []
    for _, kind, row in made[::-1]:
        assert ((np.array(row) >= x[y == int(kind[1])].min(0) - 1e-9) & (np.array(row) <= x[y == int(kind[1])].max(0) + 1e-9)).all()
        wrong.append(float(f"k{y[np.abs((x - row) / span).mean(1).argmin()]}" != kind))
    assert sorted(values(data, "complexity", "n4")) == sorted(wrong)


# ---- class pairs


def test_directional_ratio(data, table):
    x, y = table
    want = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        one, two = x[y == a], x[y == b]
        w = (len(one) * np.cov(one.T) + len(two) * np.cov(two.T)) / (len(one) + len(two))
        gap = one.mean(0) - two.mean(0)
        d = np.linalg.solve(w, gap)
        want.append(1 / (1 + (d @ gap) ** 2 / (d @ w @ d)))
    found = dict(MEASURES["complexity", "f1v"].function(data))
    assert list(found.values()) == pytest.approx(want)


def test_linear_machines(spark):
    """Classes that a plane parts have no errors; equal ones about half."""
    draw = np.random.RandomState(4)
    rows = [(k, float(draw.normal() + 9 * (k % 2)), float(draw.normal()), f"k{k % 2}") for k in range(60)]
    apart = Data(spark.createDataFrame(rows, "id long, a double, b double, kind string"), "kind", row_id="id", seed=1)
    assert [dict(MEASURES["complexity", m].function(apart)) for m in ("l1", "l2", "l3")] == [{"k0,k1": 0.0}] * 3
    same = Data(spark.createDataFrame([(k, float(k // 2 % 7), f"k{k % 2}") for k in range(56)], "id long, a double, kind string"), "kind", row_id="id", seed=1)
    assert dict(MEASURES["complexity", "l2"].function(same)) == {"k0,k1": 0.5}
