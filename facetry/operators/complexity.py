"""Complexity measures: overlap, linearity, neighbourhood, balance, dimension, network.

Class bounds, moments and Gram matrices are shared jobs; neighbourhood measures come
from the block kernel of all pairs; class pairs that need rows together (linear machines
and shrinking overlap) are one Arrow task per pair."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.kernels import linear_svm, standardise
from facetry.operators.pairwise import Block, Rough, Rows, block_pairs, blocks, cells, distances, exact, met, nearest, reach, row_statistics, scaling, shared_blocks, shared_statistics
from facetry.plans.data import NAN, Data
from facetry.plans.registry import NotConverged, TooLarge, measure
from facetry.session import settled, ship

#: Rows at most for what one task has to hold (t1; the class pairs of l1, l2, l3).
MAX_TASK_ROWS = 200_000
#: Rows of a class that meet others of it in a task of the neighbour graph.
GROUP = 4096


def _pairs(data: Data) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(len(data.classes)), 2))


def _name(data: Data, a: int, b: int) -> str:
    return f"{data.classes[a][0]},{data.classes[b][0]}"


@measure("complexity", supervised=True)
def f1(data: Data):
    """Inverse discriminant ratio of each column."""
    out = []
    for k, c in enumerate(data.numeric_names):
        own = [data.by_class[name][k] for name, _ in data.classes]
        between = sum(m["n"] * (m["mean"] - data.moments[c]["mean"]) ** 2 for m in own)
        within = sum(m["n"] * m["var"] for m in own)
        out.append((c, 1 / (1 + between / within) if within else (0.0 if between else NAN)))
    return out


@measure("complexity", supervised=True)
def f1v(data: Data):
    """Inverse directional discriminant ratio of each pair of classes."""
    out = []
    for a, b in _pairs(data):
        (na, sa, ga), (nb, sb, gb) = (data.gram[data.classes[k][0]] for k in (a, b))
        covs = [(g - np.outer(s, s) / n) / (n - 1) if n > 1 else np.full_like(g, NAN) for n, s, g in ((na, sa, ga), (nb, sb, gb))]
        w = (na * covs[0] + nb * covs[1]) / (na + nb)
        gap = sa / na - sb / nb
        if not np.isfinite(w).all():
            out.append((_name(data, a, b), NAN))
            continue
        direction = np.linalg.pinv(w) @ gap
        spread = direction @ w @ direction
        ratio = (direction @ gap) ** 2 / spread if spread else NAN
        out.append((_name(data, a, b), float(1 / (1 + ratio))))
    return out


def _bounds(data: Data, a: int, b: int) -> list[tuple[float, float, float, float]]:
    """Per column the greatest min, least max, least min and greatest max of two classes."""
    one, two = (data.by_class[data.classes[k][0]] for k in (a, b))
    return [(max(p["min"], q["min"]), min(p["max"], q["max"]), min(p["min"], q["min"]), max(p["max"], q["max"])) for p, q in zip(one, two, strict=True)]


@measure("complexity", supervised=True)
def f2(data: Data):
    """Volume of the overlap of each pair of classes."""
    out = []
    for a, b in _pairs(data):
        share = [max(0.0, minmax - maxmin) / (top - bottom) if top > bottom else NAN for maxmin, minmax, bottom, top in _bounds(data, a, b)]
        out.append((_name(data, a, b), float(np.prod(share))))
    return out


@measure("complexity", supervised=True)
def f3(data: Data):
    """Least share of rows in the overlap of a column, of each pair of classes."""
    ship(data.spark)
    pairs, d = _pairs(data), data.d
    bounds = np.array([[(lo, hi) for lo, hi, _, _ in _bounds(data, *p)] for p in pairs]).reshape(len(pairs), d, 2)
    names = {c: k for k, (c, _) in enumerate(data.classes)}
    of = {k: [i for i, p in enumerate(pairs) if k in p] for k in names.values()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), d), np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = np.array([names.get(v, -1) for v in batch.column("_y").to_pylist()])
            for k in np.unique(y[y >= 0]):
                own = x[y == k]
                for i in of[int(k)]:
                    total[i] += ((own >= bounds[i, :, 0]) & (own <= bounds[i, :, 1])).sum(0)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(total.size), pa.int32()), "n": pa.array(total.ravel())})

    table = np.zeros(len(pairs) * d, np.int64)
    for r in data.matrix.select("_y", "x").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        table[r["place"]] = r["n"]
    least = table.reshape(len(pairs), d).min(1) if pairs else []
    return [(_name(data, a, b), float(n) / (data.classes[a][1] + data.classes[b][1])) for (a, b), n in zip(pairs, least, strict=True)]


def _pair_rows(data: Data) -> DataFrame:
    """``pair, _id, y, x``: the rows of each pair of classes, for one task each."""
    ship(data.spark)
    pairs, names = _pairs(data), [c for c, _ in data.classes]
    for a, b in pairs:
        if data.classes[a][1] + data.classes[b][1] > MAX_TASK_ROWS:
            raise TooLarge(f"classes {_name(data, a, b)} have more rows than one task may hold ({MAX_TASK_ROWS})")
    to = F.array(*[F.when(F.col("_y").isin(names[a], names[b]), F.lit(k)) for k, (a, b) in enumerate(pairs)])
    return data.matrix.select(F.explode(F.filter(to, lambda p: p.isNotNull())).alias("pair"), "_id", F.col("_y").alias("y"), "x")


@measure("complexity", supervised=True)
def f4(data: Data):
    """Share of rows left in the overlap when columns are used up one by one, of each
    pair of classes."""
    ship(data.spark)
    pairs, d = _pairs(data), data.d
    names = {c: k for k, (c, _) in enumerate(data.classes)}
    rows = settled(data.matrix.select("_y", "x"))
    used, low, high = np.zeros((len(pairs), d), bool), np.zeros((len(pairs), d)), np.zeros((len(pairs), d))
    share, total, active = np.ones(len(pairs)), np.zeros(len(pairs)), list(range(len(pairs)))

    def tally(inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By pair, class and column of the rows left: minima, maxima and rows; ``inside``
        counts those within the bounds of each column."""
        of = {k: [i for i in active if k in pairs[i]] for k in names.values()}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi, n = np.full((len(pairs), 2, d), np.inf), np.full((len(pairs), 2, d), -np.inf), np.zeros((len(pairs), 2, d), np.int64)
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = np.array([names.get(v, -1) for v in batch.column("_y").to_pylist()])
                for k in np.unique(y[y >= 0]).tolist():
                    own = x[y == k]
                    for i in of[k]:
                        u, side = used[i], pairs[i].index(k)
                        left = own[((own[:, u] >= low[i, u]) & (own[:, u] <= high[i, u])).all(1)]
                        if inside:
                            n[i, side] += ((left >= low[i]) & (left <= high[i])).sum(0)
                        elif len(left):
                            lo[i, side], hi[i, side] = np.minimum(lo[i, side], left.min(0)), np.maximum(hi[i, side], left.max(0))
                            n[i, side] += len(left)
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(n.size), pa.int32()), "lo": lo.ravel(), "hi": hi.ravel(), "n": n.ravel()})

        lo, hi, n = np.full(len(pairs) * 2 * d, np.inf), np.full(len(pairs) * 2 * d, -np.inf), np.zeros(len(pairs) * 2 * d, np.int64)
        for r in rows.mapInArrow(work, "place int, lo double, hi double, n long").groupBy("place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect():
            lo[r["place"]], hi[r["place"]], n[r["place"]] = r["lo"], r["hi"], r["n"]
        return lo.reshape(-1, 2, d), hi.reshape(-1, 2, d), n.reshape(-1, 2, d)

    for step in range(d):
        lo, hi, n = tally(False)
        if not step:
            total = n[:, :, 0].sum(1)
        for i in [i for i in active if not n[i, :, 0].all()]:  # a class is used up: nothing overlaps
            share[i] = 0.0
            active.remove(i)
        for i in active:
            low[i], high[i] = np.where(used[i], low[i], lo[i].max(0)), np.where(used[i], high[i], hi[i].min(0))
        if not active:
            break
        left = tally(True)[2].sum(1)
        for i in active:
            best = int(np.where(used[i], np.iinfo(np.int64).max, left[i]).argmin())
            used[i, best], share[i] = True, left[i, best] / total[i]
        active = [i for i in active if share[i] > 0]
        if not active:
            break
    return [(_name(data, *p), float(v)) for p, v in zip(pairs, share, strict=True)]


def _machines(data: Data, max_iter: int, seed: int | None) -> list[dict]:
    """Per pair of classes: error sum, training error and error on interpolated rows; with
    a seed, one fit for all measures."""
    store = data.__dict__.setdefault("_fitted", {})
    if seed is not None and (max_iter, seed) in store:
        return store[max_iter, seed]
    pairs, names = _pairs(data), [c for c, _ in data.classes]
    rows = _pair_rows(data)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        pair = table.column("pair")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        first = np.array([v == names[pairs[pair][0]] for v in table.column("y").to_pylist()])
        z, mean, sd = standardise(x)
        w = linear_svm(z, np.where(first, 1.0, -1.0), max_iter=int(max_iter))
        decided = z @ w[:-1] + w[-1]
        wrong = (decided > 0) != first
        random = np.random.RandomState(None if seed is None else seed + pair + 1)
        errors = 0
        for own in (first, ~first):
            rows = x[own]
            a, b = rows[random.choice(len(rows), len(rows))], rows[random.choice(len(rows), len(rows))]
            made = a + (b - a) * random.random_sample(rows.shape)
            errors += int((((made - mean) / sd @ w[:-1] + w[-1] > 0) != own[own][0] if own is first else ((made - mean) / sd @ w[:-1] + w[-1] > 0)).sum())
        return pa.table({"pair": pa.array([pair], pa.int32()), "distance": [float(np.abs(decided[wrong]).sum() / len(x))], "error": [float(wrong.mean())], "made": [errors / len(x)]})

    store[max_iter, seed] = sorted((r.asDict() for r in rows.groupBy("pair").applyInArrow(fit, "pair int, distance double, error double, made double").collect()), key=lambda r: r["pair"])
    return store[max_iter, seed]


def _by_pair(data: Data, rows: list[dict], of) -> list[tuple[str, float]]:
    return [(_name(data, *_pairs(data)[r["pair"]]), of(r)) for r in rows]


@measure("complexity", supervised=True)
def l1(data: Data, max_iter: int = 100_000):
    """Distance of misclassified rows to a linear machine, of each pair of classes."""
    return _by_pair(data, _machines(data, max_iter, data.seed), lambda r: 1 - 1 / (1 + r["distance"]))


@measure("complexity", supervised=True)
def l2(data: Data, max_iter: int = 100_000):
    """Training error of a linear machine, of each pair of classes."""
    return _by_pair(data, _machines(data, max_iter, data.seed), lambda r: r["error"])


@measure("complexity", supervised=True)
def l3(data: Data, max_iter: int = 100_000):
    """Error of a linear machine on interpolated rows, of each pair of classes."""
    return _by_pair(data, _machines(data, max_iter, data.seed), lambda r: r["made"])


@measure("complexity", scalar=True, supervised=True)
def n1(data: Data, metric: str = "gower", p: float = 2):
    """Share of rows at an edge between classes in the minimum spanning tree.

    Boruvka rounds: every component's shortest edge out is found by the block kernel;
    zero distances are no edges. Ties are broken by the ids of the edge, so the tree is
    one and the same in every run."""
    state = {r["_id"]: r["_id"] for r in data.source.select("_id").collect()} if data.n <= MAX_TASK_ROWS else None
    if state is None:
        raise TooLarge(f"n1 labels at most {MAX_TASK_ROWS} rows")
    packed = shared_blocks(data, True)
    edges: set[tuple[int, int]] = set()
    border: set[int] = set()
    spark = data.spark
    while True:
        held = spark.sparkContext.broadcast(state)  # a number for each row; n is checked above

        def kernel(a: Block, b: Block) -> dict[str, np.ndarray]:
            dist = distances(a.x, b.x, metric, p)
            ca, cb = (np.array([held.value[i] for i in z.ids.tolist()]) for z in (a, b))
            dist[(ca[:, None] == cb[None, :]) | (dist <= 0)] = np.inf
            low = np.minimum(a.ids[:, None], b.ids[None, :])
            best = dist.min(1)
            tie = np.where(dist == best[:, None], low, np.iinfo(np.int64).max)
            least = tie.min(1)
            at = np.where(tie == least[:, None], np.maximum(a.ids[:, None], b.ids[None, :]), np.iinfo(np.int64).max)
            j = b.ids[at.argmin(1)]
            cross = a.ys != b.ys[at.argmin(1)]
            ok = np.isfinite(best)
            return {"c": ca[ok], "d": best[ok], "u": np.minimum(a.ids, j)[ok], "v": np.maximum(a.ids, j)[ok], "cross": cross[ok]}

        found = block_pairs(packed, packed, kernel, "c long, d double, u long, v long, cross boolean")
        best = found.groupBy("c").agg(F.min(F.struct("d", "u", "v", "cross")).alias("e")).select("e.*").distinct().collect()
        if not best:
            break
        above = {c: c for c in set(state.values())}

        def root(c: int) -> int:
            while above[c] != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        for r in sorted(best, key=lambda r: (r["d"], r["u"], r["v"])):
            ra, rb = root(state[r["u"]]), root(state[r["v"]])
            if ra != rb:
                above[max(ra, rb)] = min(ra, rb)
                edges.add((r["u"], r["v"]))
                if r["cross"]:
                    border |= {r["u"], r["v"]}
        state = {i: root(c) for i, c in state.items()}
    return len(border) / data.n


@measure("complexity", supervised=True)
def n2(data: Data, metric: str = "gower", p: float = 2):
    """Per row, distance to the nearest row of the class over that to another class."""
    stats = shared_statistics(data, metric, p, scaled=True)
    own, other = nearest(stats, False).select("i", F.col("d").alias("own")), nearest(stats, True).select("i", F.col("d").alias("other"))
    ratio = F.when(F.col("other") > 0, F.col("own") / F.col("other"))
    value = F.coalesce(1 - 1 / (1 + ratio), F.when(F.col("own") > 0, 1.0), F.lit(NAN))
    return own.join(other, "i").select(F.col("i").cast("string").alias("key"), value.alias("value"))


@measure("complexity", supervised=True)
def n3(data: Data, metric: str = "gower", p: float = 2):
    """Per row, whether its nearest neighbour has another class."""
    best = shared_statistics(data, metric, p, scaled=True).groupBy("i", "y").agg(F.min_by("c", F.struct("lo", "at")).alias("c"))
    return best.select(F.col("i").cast("string").alias("key"), (F.col("c") != F.col("y")).cast("double").alias("value"))


def interpolated(data: Data) -> DataFrame:
    """As many rows of each class, each between two rows of it; drawn by seeded hashes of
    the row ids, so the draw doesn't depend on partitions."""
    sizes = {c: n for c, n in data.classes}
    ranks = data.ranked("_y").select("_id", F.col("rank"))
    rows = settled(data.matrix.join(ranks, "_id"))
    size = F.element_at(F.create_map(*[z for c, n in sizes.items() for z in (F.lit(c), F.lit(n))]), F.col("_y"))
    seed = data.seed or 0
    draw = lambda k: F.pmod(F.xxhash64("_id", F.lit(seed), F.lit(k)), size)
    picks = rows.select("_id", "_y", draw(1).alias("ra"), draw(2).alias("rb"))
    one = rows.select("_y", F.col("rank").alias("ra"), F.col("x").alias("xa"))
    two = rows.select("_y", F.col("rank").alias("rb"), F.col("x").alias("xb"))
    u = lambda j: F.pmod(F.xxhash64("_id", F.lit(seed), F.lit(3), j), F.lit(1 << 30)) / float(1 << 30)
    mixed = F.transform("xa", lambda v, j: v + (F.element_at("xb", j + 1) - v) * u(j))
    return picks.join(one, ["_y", "ra"]).join(two, ["_y", "rb"]).select((-1 - F.col("_id")).alias("_id"), "_y", mixed.alias("x"))


@measure("complexity", supervised=True)
def n4(data: Data, metric: str = "gower", p: float = 2, n_neighbors: int = 1):
    """Per interpolated row, whether its nearest neighbours vote for another class."""
    left, right = blocks(data, True, interpolated(data)), shared_blocks(data, True)
    if n_neighbors == 1:
        best = row_statistics(data, metric, p, left, right).groupBy("i", "y").agg(F.min_by("c", F.struct("lo", "at")).alias("c"))
        return best.select(F.col("i").cast("string").alias("key"), (F.col("c") != F.col("y")).cast("double").alias("value"))

    def kernel(a: Block, b: Block) -> dict[str, np.ndarray]:
        dist = distances(a.x, b.x, metric, p)
        order = np.argsort(dist, axis=1, kind="stable")[:, :n_neighbors]
        row = np.broadcast_to(np.arange(len(a.ids))[:, None], order.shape).ravel()
        return {"i": a.ids[row], "y": a.ys[row], "j": b.ids[order.ravel()], "c": b.ys[order.ravel()], "d": np.take_along_axis(dist, order, 1).ravel()}

    found = block_pairs(left, right, kernel, "i long, y int, j long, c int, d double")
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("place") <= n_neighbors)
    votes = near.groupBy("i", "y", "c").agg(F.count("*").alias("n")).groupBy("i", "y").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("c"))
    return votes.select(F.col("i").cast("string").alias("key"), (F.col("c") != F.col("y")).cast("double").alias("value"))


@measure("complexity", scalar=True, supervised=True)
def c1(data: Data):
    """Entropy of the class shares over its maximum."""
    p = np.array([n for _, n in data.classes]) / data.n
    return float(-(p * np.log(p)).sum() / math.log(len(p))) if len(p) > 1 else NAN


@measure("complexity", scalar=True, supervised=True)
def c2(data: Data):
    """Imbalance of the classes."""
    n, k = data.n, len(data.classes)
    if k < 2:
        return NAN
    return 1 - 1 / ((k - 1) / k * sum(m / (n - m) for _, m in data.classes))


@measure("complexity", scalar=True, supervised=True)
def t1(data: Data, metric: str = "gower", p: float = 2, agglomeration_metric: str = "mass", agglomeration_reference: str = "center"):
    """Hyperspheres that cover the classes, over the rows. Radii come from the nearest
    enemies; absorbing spheres is a sequence, done by one task that reads what each
    sphere holds as a bit row."""
    if agglomeration_metric not in ("mass", "radius") or agglomeration_reference not in ("center", "border"):
        raise ValueError("agglomeration is by mass or radius, from the center or the border")
    if data.n > 20_000:
        raise TooLarge("t1 holds a bit for each pair of rows; at most 20,000 rows")
    packed = shared_blocks(data, True)
    enemies = nearest(shared_statistics(data, metric, p, scaled=True), True)
    rows = sorted((r["i"], r["at"], r["d"]) for r in enemies.collect())
    radius: dict[int, float] = {}
    near = {i: (at, d) for i, at, d in rows}
    for start, _, _ in rows:  # follow enemies until one is known, mutual, or closes a ring
        path, i = [], start
        while i not in radius:
            enemy, d = near[i]
            if near[enemy][0] == i:
                radius[i] = radius[enemy] = d / 2
                break
            radius[i] = 0.0
            path.append(i)
            i = enemy
        for i in reversed(path):
            radius[i] = abs(near[i][1] - radius[near[i][0]])
    held = data.spark.sparkContext.broadcast(radius)  # n is checked above
    border = agglomeration_reference == "border"

    def kernel(a: Block, b: Block) -> dict[str, np.ndarray]:
        rb = np.array([held.value[i] for i in b.ids.tolist()])
        ra = np.array([held.value[i] for i in a.ids.tolist()])
        inside = distances(a.x, b.x, metric, p) <= (rb[None, :] - ra[:, None] if border else rb[None, :])
        i, j = np.nonzero(inside)
        return {"sphere": b.ids[j], "row": a.ids[i]}

    found = block_pairs(packed, packed, kernel, "sphere long, row long")
    holds = {r["sphere"]: set(r["rows"]) for r in found.groupBy("sphere").agg(F.collect_list("row").alias("rows")).collect()}
    order = sorted(near, key=lambda i: (-(len(holds.get(i, ())) if agglomeration_metric == "mass" else radius[i]), i))
    left = {i: 1 for i in near}
    for i in order:
        if left[i] > 0:
            inside = holds.get(i, set())
            total = sum(left[j] for j in inside)
            for j in inside:
                left[j] = 0
            left[i] = total
    return sum(v > 0 for v in left.values()) / data.n


@measure("complexity", scalar=True)
def t2(data: Data):
    """Columns over rows."""
    return data.d / data.n


def _components(data: Data, share: float = 0.95) -> int:
    values = np.linalg.eigvalsh(data.covariance())[::-1]
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share, side="right") + 1)


@measure("complexity", scalar=True)
def t3(data: Data):
    """Principal components for 95 % of the variance, over the rows."""
    return min(_components(data), data.d) / data.n


@measure("complexity", scalar=True)
def t4(data: Data):
    """Principal components for 95 % of the variance, over the columns."""
    return min(_components(data), data.d) / data.d


@measure("complexity", scalar=True, supervised=True)
def lsc(data: Data, metric: str = "gower", p: float = 2):
    """One less the mean share of rows nearer than a row's nearest enemy."""
    enemy = nearest(shared_statistics(data, metric, p, scaled=True), True).select(F.col("i").alias("_id"), F.col("d").alias("enemy"))
    packed = blocks(data, True, data.matrix.join(enemy, "_id"), "enemy")

    def work(a: Rows, b: Rows | None) -> Iterator[dict[str, np.ndarray]]:
        rough, other, total = Rough(a, b, metric, p), a if b is None else b, 0
        for (_, i), (_, j), same in met(a, b):
            tile = rough.tile(i, j)
            # both rows of a pair have a nearest enemy
            for e in (other.e[j][None, :],) if same else (other.e[j][None, :], a.e[i][:, None]):
                low, high = (rough.limits(rough.of(e), sign, tile) for sign in (-1, 1))
                total += int((tile < low).sum())
                row, column = np.nonzero((tile >= low) & (tile <= high))
                total += int((exact(a.x[i][row], other.x[j][column], metric, p) < np.broadcast_to(e, tile.shape)[row, column]).sum())
        yield {"n": np.array([total])}

    return 1 - (cells(packed, work, "n long").agg(F.sum("n")).first()[0] or 0) / data.n**2


def _edges(data: Data, metric: str, p: float, radius_frac: float) -> DataFrame:
    """``y, g, h, parts, u, v, bits``: the adjacency of two groups of a class (of ``parts``)
    with the ids of their rows (zero distances are no edges), so each edge is there from
    both ends. The reach of each row comes first; after that only
    rows of a class meet, and an edge is a bit and no row."""
    store, key = data.__dict__.setdefault("_edges", {}), (metric, p, radius_frac)
    if key in store:
        return store[key]
    k = max(1, int(round(data.n * radius_frac) if 0 < radius_frac < 1 else radius_frac))
    far = settled(reach(data, k, metric, p))
    rows = data.matrix.join(far, "_id")
    low, span = scaling(data, True)
    shift, size = F.array(*[F.lit(float(v)) for v in low]), F.array(*[F.lit(float(v)) for v in span])
    scaled = F.transform("x", lambda v, j: (v - F.get(shift, j)) / F.get(size, j))
    each = settled(rows.select("_id", "_y", scaled.alias("x"), "d", "j"))
    names = {c: n for n, (c, _) in enumerate(data.classes)}
    groups = {c: max(1, -(-n // GROUP)) for c, n in data.classes}
    ship(data.spark)
    number = F.element_at(F.create_map(*[z for c, n in groups.items() for z in (F.lit(c), F.lit(n))]), F.col("_y"))
    own = each.withColumn("parts", number).withColumn("parts", F.col("parts").cast("long")).withColumn("g", F.pmod(F.xxhash64("_id"), F.col("parts")))
    one = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("h")).withColumn("side", F.lit(0))
    two = own.withColumnRenamed("g", "h").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g")).withColumn("side", F.lit(1))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        side = table.column("side").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        ids, d, j = (table.column(c).to_numpy() for c in ("_id", "d", "j"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        bits = []
        for at in range(0, len(a), 256):
            r = a[at : at + 256]
            dist = distances(x[r], x[b], metric, p)
            inside = (dist < d[r, None]) | (dist == d[r, None]) & (ids[None, b] <= j[r, None])
            inside |= (dist < d[None, b]) | (dist == d[None, b]) & (ids[r, None] <= j[None, b])
            inside &= (dist > 0) & (ids[r, None] != ids[None, b])
            bits += [row.tobytes() for row in np.packbits(inside, axis=1)]
        place = [table.column(c)[0].as_py() for c in ("g", "h", "parts")]
        row = [names[table.column("_y")[0].as_py()], *place, ids[a].tobytes(), ids[b].tobytes(), b"".join(bits)]
        return pa.table({c: pa.array([v] if len(a) and len(b) else [], t) for c, v, t in zip(("y", "g", "h", "parts", "u", "v", "bits"), row, [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 3], strict=True)})

    met = one.unionByName(two).groupBy("_y", "g", "h").applyInArrow(work, "y int, g long, h long, parts long, u binary, v binary, bits binary")
    store[key] = settled(met)
    return store[key]


def _bits(u: bytes, v: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the rows and columns of an adjacency, and its packed rows."""
    ids, others = np.frombuffer(u, np.int64), np.frombuffer(v, np.int64)
    return ids, others, np.frombuffer(bits, np.uint8).reshape(len(ids), -1)


def _degrees(edges: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, _, packed = _bits(*[batch.column(c)[k].as_py() for c in ("u", "v", "bits")])
                yield pa.RecordBatch.from_pydict({"u": ids, "n": np.bitwise_count(packed).sum(1, dtype=np.int64)})

    return edges.select("u", "v", "bits").mapInArrow(work, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))


@measure("complexity", scalar=True, supervised=True)
def density(data: Data, metric: str = "gower", p: float = 2.0, radius_frac: float = 0.15):
    """One less the density of the neighbour graph."""
    ends = _degrees(_edges(data, metric, p, radius_frac)).agg(F.sum("n")).first()[0] or 0
    return 1 - ends / (data.n * (data.n - 1))


@measure("complexity", scalar=True, supervised=True)
def cls_coef(data: Data, metric: str = "gower", p: float = 2.0, radius_frac: float = 0.15):
    """One less the transitivity of the neighbour graph. Closed paths of three edges are
    products of the adjacency's rows; a task has a group's rows and the bits of its class."""
    edges = _edges(data, metric, p, radius_frac)

    def work(table: pa.Table) -> pa.Table:
        cells = [_bits(*[table.column(c)[k].as_py() for c in ("u", "v", "bits")]) for k in range(table.num_rows)]
        ids = np.unique(np.concatenate([c[0] for c in cells]))
        whole = np.zeros((len(ids), len(ids) // 8 + 1), np.uint8)
        for at in range(0, len(ids), 512):  # rows of the class, put together
            part = np.zeros((min(512, len(ids) - at), whole.shape[1] * 8), np.uint8)
            for u, v, packed in cells:
                place = np.searchsorted(ids, u)
                own = np.flatnonzero((place >= at) & (place < at + len(part)))
                part[np.ix_(place[own] - at, np.searchsorted(ids, v))] = np.unpackbits(packed[own], axis=1, count=len(v))
            whole[at : at + len(part)] = np.packbits(part, axis=1)
        run = table.column("run")[0].as_py()
        mine = np.searchsorted(ids, np.concatenate([np.zeros(0, np.int64), *[c[0] for c, g, h in zip(cells, table.column("g").to_pylist(), table.column("h").to_pylist(), strict=True) if g == run and h == run]]))
        wide = lambda rows: np.unpackbits(whole[rows], axis=1, count=len(ids)).astype(np.float32)
        total = 0
        for low in range(0, len(mine), 512):
            left = wide(mine[low : low + 512])
            for at in range(0, len(ids), 512):
                # numbers below 2^24 are exact
                paths = left @ wide(np.arange(at, min(at + 512, len(ids)))).T
                total += int((paths * left[:, at : at + 512]).sum(dtype=np.float64))
        return pa.table({"n": pa.array([total], pa.int64())})

    each = edges.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    closed = each.groupBy("y", "run").applyInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0
    triples = _degrees(edges).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return 1 - closed / 2 / triples if triples else NAN


def leading_vector(multiply: Callable[[np.ndarray], np.ndarray], n: int, basis: int = 24, restarts: int = 40, tolerance: float = 1e-8) -> np.ndarray:
    """The eigenvector of the largest eigenvalue of a symmetric matrix without negative
    entries, by restarted Lanczos steps from a vector of ones; the largest entry is 1.
    Raises ``NotConverged`` if the residual doesn't get below ``tolerance``."""
    start = np.ones(n) / np.sqrt(max(n, 1))
    for _ in range(restarts):
        q, along = [start], []
        beta = []
        for k in range(min(basis, n)):
            w = multiply(q[k])
            along.append(float(q[k] @ w))
            for v in q:  # twice is enough
                w = w - (v @ w) * v
            for v in q:
                w = w - (v @ w) * v
            size = float(np.linalg.norm(w))
            if size < 1e-12:
                break
            beta.append(size)
            q.append(w / size)
        m = len(along)
        values, vectors = np.linalg.eigh(np.diag(along) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
        start = np.abs(np.array(q[:m]).T @ vectors[:, -1])  # the leading one has no two signs
        start /= np.linalg.norm(start)
        if np.linalg.norm(multiply(start) - values[-1] * start) <= tolerance * max(abs(values[-1]), 1e-300):
            return start / start.max()
    raise NotConverged(f"the leading eigenvector wasn't found in {restarts} rounds of {basis} products")


@measure("complexity", supervised=True)
def hubs(data: Data, metric: str = "gower", p: float = 2.0, radius_frac: float = 0.15):
    """Per row, one less its hub score in the neighbour graph: the leading eigenvector of
    the adjacency's bits, whose products with a vector are one job each (a score for each
    row is sent out and comes back, so rows are bounded)."""
    if data.n > 5_000_000:
        raise TooLarge("hubs sends a score for each row to every task; at most 5,000,000 rows")
    edges = _edges(data, metric, p, radius_frac)
    ids = np.array(sorted(r["_id"] for r in data.source.select("_id").collect()), np.int64)

    def multiply(score: np.ndarray) -> np.ndarray:
        held = data.spark.sparkContext.broadcast((ids, score))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, values = held.value
            for batch in batches:
                for k in range(batch.num_rows):
                    u, v, packed = _bits(*[batch.column(c)[k].as_py() for c in ("u", "v", "bits")])
                    own = values[np.searchsorted(names, v)]
                    parts = [np.unpackbits(packed[at : at + 512], axis=1, count=len(v)) @ own for at in range(0, len(u), 512)]
                    yield pa.RecordBatch.from_pydict({"u": u, "s": np.concatenate(parts)})

        out = np.zeros(len(ids))
        for r in edges.select("u", "v", "bits").mapInArrow(step, "u long, s double").groupBy("u").agg(F.sum("s").alias("s")).collect():
            out[np.searchsorted(ids, r["u"])] = r["s"]
        held.destroy()
        return out

    score = leading_vector(multiply, len(ids)) if _degrees(edges).filter("n > 0").limit(1).count() else np.zeros(len(ids))
    return data.spark.createDataFrame([(str(i), float(1 - s)) for i, s in zip(ids, score, strict=True)], "key string, value double")
