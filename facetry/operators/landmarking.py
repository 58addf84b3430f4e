"""Landmarking: cross-validated scores of simple learners.

Fold numbers come from ranks inside each class. Gaussian Bayes and the linear
discriminant are made of per-fold, per-class sums (training sums are totals less the
fold's), nearest neighbours of the block kernel with other folds only; tree learners are
one Arrow task per fold. Trees and neighbours see equal rows once, with their numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.kernels import Tree
from facetry.functions.scoring import score_table
from facetry.operators.pairwise import Block, block_pairs, blocks
from facetry.plans.data import Data
from facetry.plans.registry import TooLarge, measure
from facetry.session import settled, ship

#: Different rows that one task may hold for the exact tree learners.
MAX_TASK_ROWS = 1_000_000


def allocation(data: Data, folds: int) -> dict[str, np.ndarray]:
    """By class, the rows of it that each fold gets; folds as even as can be."""
    sizes = {c: n for c, n in data.classes}
    first = {r["_y"]: r["f"] for r in data.source.groupBy("_y").agg(F.min("_id").alias("f")).collect()}
    order = sorted(sizes, key=lambda c: first[c])  # classes by first appearance
    ends = np.cumsum([sizes[c] for c in order])
    out = {}
    for k, c in enumerate(order):
        start = ends[k] - sizes[c]
        # positions start .. end of the sorted classes, dealt out in turn
        out[c] = np.array([max(0, -(-(ends[k] - f) // folds)) - max(0, -(-(start - f) // folds)) for f in range(folds)])
    return out


def sampled(data: Data, lm_sample_frac: float) -> Data:
    """The rows that the learners see, with all options of the dataset; made once."""
    if not 0.5 <= lm_sample_frac <= 1:
        raise ValueError("lm_sample_frac is from 0.5 to 1")
    store = data.__dict__.setdefault("_sampled", {})
    if lm_sample_frac not in store:
        store[lm_sample_frac] = data.subsample(lm_sample_frac) if lm_sample_frac < 1 else data
    return store[lm_sample_frac]


def folded(data: Data, num_cv_folds: int = 10, shuffle_cv_folds: bool = False) -> DataFrame:
    """``_id, _y, x, fold``: stratified folds in id order (or in a seeded hash's)."""
    key = ("_folds", num_cv_folds, shuffle_cv_folds)
    store = data.__dict__.setdefault("_folded", {})
    if key not in store:
        ranks = data.ranked("_y", shuffle_cv_folds)
        fold = F.lit(None).cast("int")
        for c, counts in allocation(data, num_cv_folds).items():
            place = F.lit(0)
            for end in np.cumsum(counts)[:-1]:
                place = place + (F.col("rank") >= int(end)).cast("int")
            fold = F.when(F.col("_y") == c, place).otherwise(fold)
        store[key] = settled(data.matrix.join(ranks.select("_id", fold.alias("fold")), "_id"))
    return store[key]


def _scores(data: Data, predicted: DataFrame, score: str) -> list[tuple[str, float]]:
    """Score of each fold from ``fold, y, p, n`` rows, or one row for each prediction."""
    n = F.sum("n") if "n" in predicted.columns else F.count("*")
    table: dict[int, dict[tuple[str, str], int]] = {}
    for r in predicted.groupBy("fold", "y", "p").agg(n.alias("n")).collect():
        table.setdefault(r["fold"], {})[r["y"], r["p"]] = r["n"]
    return [(str(f), score_table(t, score)) for f, t in sorted(table.items())]


def _training(data: Data, rows: DataFrame) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Per fold, rows, sums and centred cross products of each class outside it."""
    parts = data.grams(rows, ["fold", "_y"])
    folds = sorted({f for f, _ in parts})
    names = [c for c, _ in data.classes]
    d = data.d
    none = (0, np.zeros(d), np.zeros((d, d)))
    total = {c: [sum(parts.get((f, c), none)[k] for f in folds) for k in range(3)] for c in names}
    return {f: [tuple(total[c][k] - parts.get((f, c), none)[k] for k in range(3)) for c in names] for f in folds}


def _linear_scores(data: Data, rows: DataFrame, models: dict[int, tuple], decide) -> DataFrame:
    """``fold, y, p`` with ``decide(model, centred rows)`` the index of the class."""
    ship(data.spark)
    names = [c for c, _ in data.classes]
    centre = np.array([m["mean"] for m in data.moments.values()])
    held = data.spark.sparkContext.broadcast(models)  # a model for each fold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre)) - centre
            fold = batch.column("fold").to_numpy()
            out = np.zeros(len(fold), np.int64)
            for f in np.unique(fold):
                out[fold == f] = decide(held.value[int(f)], x[fold == f])
            yield pa.RecordBatch.from_pydict({"fold": pa.array(fold, pa.int32()), "y": batch.column("_y"), "p": pa.array([names[k] for k in out])})

    return rows.select("fold", "_y", "x").mapInArrow(work, "fold int, y string, p string")


@measure("landmarking", supervised=True)
def naive_bayes(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of Gaussian naive Bayes."""
    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    models = {}
    for f, parts in _training(data, rows).items():
        n = np.array([p[0] for p in parts], float)
        sums, squares = np.array([p[1] for p in parts]), np.array([np.diag(p[2]) for p in parts])
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = sums / n[:, None]
            var = squares / n[:, None] - mean**2
        overall = squares.sum(0) / n.sum() - (sums.sum(0) / n.sum()) ** 2
        models[f] = (mean, var + 1e-9 * overall.max(), np.log(np.maximum(n, 1e-300) / n.sum()))

    def decide(model, x):
        mean, var, prior = model
        logs = prior - 0.5 * np.log(2 * np.pi * var).sum(1) - 0.5 * (((x[:, None, :] - mean) ** 2) / var).sum(2)
        return np.nan_to_num(logs, nan=-np.inf).argmax(1)

    return _scores(data, _linear_scores(data, rows, models, decide), score)


@measure("landmarking", supervised=True)
def linear_discr(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of the linear discriminant. Columns are scaled by their deviation inside
    classes; directions without spread are left out by rank."""
    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    models = {}
    for f, parts in _training(data, rows).items():
        n = np.array([p[0] for p in parts], float)
        ok = n > 0
        mean = np.array([p[1] / max(p[0], 1) for p in parts])
        within = sum(p[2] - np.outer(p[1], p[1]) / p[0] for p in parts if p[0]) / n.sum()
        sd = np.sqrt(np.maximum(np.diag(within), 0))
        sd[sd < 1e-12] = 1.0
        values, vectors = np.linalg.eigh(within / np.outer(sd, sd))
        keep = values > 1e-8 * max(values.max(), 1e-300)
        white = (vectors[:, keep] / np.sqrt(values[keep])) / sd[:, None]
        centres = mean @ white
        models[f] = (white @ centres.T, np.where(ok, -0.5 * (centres**2).sum(1) + np.log(np.maximum(n, 1e-300) / n.sum()), -np.inf))
    return _scores(data, _linear_scores(data, rows, models, lambda m, x: (x @ m[0] + m[1]).argmax(1)), score)


def nearest_rows(a: np.ndarray, b: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and place of the nearest row of ``b`` for each of ``a`` that isn't
    barred (infinite if all are); the first of equals. One matrix product finds what may be
    nearest to within its rounding, and only that is measured exactly."""
    centre = b.mean(0)
    u, v = a - centre, b - centre
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    rough = uu[:, None] + vv[None, :] - 2 * (u @ v.T)
    rough[barred] = np.inf
    limit = rough.min(1) + 1e-10 * (uu + vv.max())
    row, place = np.nonzero((rough <= limit[:, None]) & ~barred)
    gap = a[row] - b[place]
    exact = (gap * gap).sum(1)
    order = np.lexsort((place, exact, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    best, at = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
    best[row[first]], at[row[first]] = exact[first], place[first]
    return best, at


def _nearest(data: Data, rows: DataFrame) -> DataFrame:
    """``fold, y, p, n`` by the nearest row of the other folds. Of equal rows, those of a
    fold and class ask once; and two can be nearest: the one of the least id, and for its
    own fold, the one of the least id of the other folds."""
    names = [c for c, _ in data.classes]
    asking = settled(rows.groupBy("x", "fold", "_y").agg(F.min("_id").alias("_id"), F.count("*").alias("n")))
    own = asking.groupBy("x", "fold").agg(F.min_by("_y", "_id").alias("_y"), F.min("_id").alias("_id"))
    place = F.row_number().over(Window.partitionBy("x").orderBy("_id"))  # a row for each fold
    left, right = blocks(data, False, asking, "fold"), blocks(data, False, own.withColumn("place", place).filter("place <= 2"), "fold")

    def kernel(a: Block, b: Block) -> dict[str, np.ndarray]:
        best, at = nearest_rows(a.x, b.x, a.e[:, None] == b.e[None, :])
        ok = np.isfinite(best)
        return {"i": a.ids[ok], "fold": a.e[ok].astype(np.int32), "y": a.ys[ok], "d": best[ok], "j": b.ids[at][ok], "c": b.ys[at][ok]}

    found = block_pairs(left, right, kernel, "i long, fold int, y int, d double, j long, c int")
    near = found.groupBy("i", "fold", "y").agg(F.min_by("c", F.struct("d", "j")).alias("c")).join(asking.select(F.col("_id").alias("i"), "n"), "i")
    label = F.array(*[F.lit(c) for c in names])
    return near.select("fold", F.element_at(label, F.col("y") + 1).alias("y"), F.element_at(label, F.col("c") + 1).alias("p"), "n")


def nearest_values(v: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of the nearest of sorted, different values for each of ``v``; the least id
    of two equally near."""
    after = np.searchsorted(values, v)
    low, high = np.maximum(after - 1, 0), np.minimum(after, len(values) - 1)
    one, two = (v - values[low]) ** 2, (v - values[high]) ** 2
    return np.where((one < two) | (one == two) & (ids[low] <= ids[high]), low, high)


def _nearest_on(data: Data, rows: DataFrame, columns: dict[int, int]) -> DataFrame:
    """``fold, y, p, n`` by the nearest row of the other folds on one column for each fold:
    a task for each fold looks its different values up among those of the others."""
    ship(data.spark)
    folds = sorted(columns)
    runs = F.array(*[F.struct(F.lit(f).alias("run"), F.col("x")[columns[f]].alias("v")) for f in folds])
    each = rows.select("_id", "_y", "fold", F.explode(runs).alias("r")).select("_id", "_y", "fold", "r.*").withColumn("test", F.col("fold") == F.col("run"))
    used = each.groupBy("run", "v", "test", F.when(F.col("test"), F.col("_y")).alias("y")).agg(F.min("_id").alias("id"), F.min_by("_y", "_id").alias("c"), F.count("*").alias("n"))

    def work(table: pa.Table) -> pa.Table:
        test = table.column("test").to_numpy(zero_copy_only=False)
        v, n, ids = (table.column(c).to_numpy() for c in ("v", "n", "id"))
        order = np.flatnonzero(~test)
        order = order[np.argsort(v[order], kind="stable")]
        if not len(order):
            test[:] = False
        at = order[nearest_values(v[test], v[order], ids[order])] if len(order) else order
        return pa.table({"fold": pa.array(np.full(int(test.sum()), table.column("run")[0].as_py(), np.int32)), "y": table.column("y").filter(pa.array(test)), "p": table.column("c").take(pa.array(at)), "n": n[test]})

    return used.groupBy("run").applyInArrow(work, "fold int, y string, p string, n long")


@measure("landmarking", supervised=True)
def one_nn(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of the nearest neighbour."""
    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    return _scores(data, _nearest(data, rows), score)


def _per_fold(data: Data, rows: DataFrame, learn) -> DataFrame:
    """``fold, y, p, n`` by ``learn(x, y, weight, test, classes)`` for each fold in a task
    of its own, over the different rows with their numbers; it gives classes of the tests
    (or one number)."""
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    counts = F.array(*[F.count_if(F.col("fold") == f) for f in folds])
    different = settled(rows.groupBy("_y", "x").agg(counts.alias("n")))
    if different.count() > MAX_TASK_ROWS:
        raise TooLarge(f"the exact tree learners hold a fold's different training rows in one task; at most {MAX_TASK_ROWS} of them")
    ship(data.spark)
    names = {c: k for k, (c, _) in enumerate(data.classes)}
    called = list(names)
    each = different.select("_y", "x", "n", F.explode(F.array(*[F.lit(k) for k in range(len(folds))])).alias("run"))

    def work(table: pa.Table) -> pa.Table:
        x, n = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) for c in ("x", "n"))
        y = np.array([names[v] for v in table.column("_y").to_pylist()])
        run = table.column("run")[0].as_py()
        own, weight = n[:, run], n.sum(1) - n[:, run]
        test, train = own > 0, weight > 0
        got = learn(x[train], y[train], weight[train], x[test], len(names))
        if isinstance(got, int):
            return pa.table({"fold": pa.array([folds[run]], pa.int32()), "y": [""], "p": [str(got)], "n": pa.array([1], pa.int64())})
        return pa.table({"fold": pa.array([folds[run]] * int(test.sum()), pa.int32()), "y": [called[k] for k in y[test]], "p": [called[k] for k in got], "n": own[test]})

    return each.groupBy("run").applyInArrow(work, "fold int, y string, p string, n long")


@measure("landmarking", supervised=True)
def best_node(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of a tree with one split on any column."""
    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    return _scores(data, _per_fold(data, rows, lambda x, y, w, t, k: Tree(x, y, k, 1, weight=w).predict(t)), score)


@measure("landmarking", supervised=True)
def random_node(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of a tree with one split on one drawn column."""
    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    drawn = int(np.random.RandomState(data.seed or 0).randint(0, data.d))
    return _scores(data, _per_fold(data, rows, lambda x, y, w, t, k: Tree(x[:, [drawn]], y, k, 1, weight=w).predict(t[:, [drawn]])), score)


def _ranking(x, y, w, k) -> np.ndarray:
    return np.argsort(Tree(x, y, k, weight=w).importances(), kind="stable")


@measure("landmarking", supervised=True)
def worst_node(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of a tree with one split on the least important column of each fold."""

    def learn(x, y, w, t, k):
        column = [int(_ranking(x, y, w, k)[0])]
        return Tree(x[:, column], y, k, 1, weight=w).predict(t[:, column])

    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    return _scores(data, _per_fold(data, rows, learn), score)


@measure("landmarking", supervised=True)
def elite_nn(data: Data, score: str = "accuracy", num_cv_folds: int = 10, shuffle_cv_folds: bool = False, lm_sample_frac: float = 1.0):
    """Scores of the nearest neighbour on the most important column of each fold."""
    data = sampled(data, lm_sample_frac)
    rows = folded(data, num_cv_folds, shuffle_cv_folds)
    best = _per_fold(data, rows, lambda x, y, w, t, k: int(_ranking(x, y, w, k)[-1])).collect()
    return _scores(data, _nearest_on(data, rows, {r["fold"]: int(r["p"]) for r in best}), score)
