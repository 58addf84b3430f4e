"""All-pairs distances in blocks.

Rows become blocks of some hundred, in id order; every pair of blocks is one unit of
work for an Arrow kernel that reduces distances to statistics per row and class at once.
No distance matrix and no row per pair is ever made. The work is quadratic by the
measures' definition; it spreads over the cells of a grid of blocks. Measures of the same
distances share one pass. Statistics of a dataset with itself measure each pair once, by
matrix products (what these can't tell apart is measured again) or by a bound in 16-bit
steps, within which alone exact distances are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.plans.data import Data
from facetry.session import settled, ship

ROWS = 512
#: Bytes of the left blocks of a cell, and those that are worth a cell of their own.
CELL, LEAST = 64 << 20, 1 << 18
#: Bytes of a side of a cell that adds up what it finds, and rows of its tiles.
HELD, TILE = 32 << 20, 512
#: Parts of the rows that each meet all rows, so copies of these.
STRIPS = 32
METRICS = ("euclidean", "gower", "cityblock", "chebyshev", "minkowski", "sqeuclidean")


def distances(a: np.ndarray, b: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Distances of all rows of two matrices, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 20) // max(1, b.size))
    for k in range(0, len(a), step):
        gap = np.abs(a[k : k + step, None, :] - b[None, :, :])
        if metric in ("euclidean", "sqeuclidean"):
            out[k : k + step] = np.einsum("ijk,ijk->ij", gap, gap)
        elif metric == "gower":
            out[k : k + step] = gap.mean(-1)
        elif metric == "cityblock":
            out[k : k + step] = gap.sum(-1)
        elif metric == "chebyshev":
            out[k : k + step] = gap.max(-1)
        elif metric == "minkowski":
            out[k : k + step] = (gap**p).sum(-1) ** (1 / p)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return np.sqrt(out) if metric == "euclidean" else out


def scaling(data: Data, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shift and scale of min-max scaling (or none)."""
    if not scaled:
        return np.zeros(data.d), np.ones(data.d)
    low = np.array([m["min"] for m in data.moments.values()])
    span = np.array([m["max"] for m in data.moments.values()]) - low
    return low, np.where(span == 0, 1.0, span)


def blocks(data: Data, scaled: bool, frame: DataFrame | None = None, extra: str | None = None) -> DataFrame:
    """``b, ids, ys, xs, es``: blocks of rows as binary columns (int64, int32, float64,
    float64). Classes are numbered as the dataset lists them; ``extra`` is one more
    double column of ``frame``."""
    data.needs_id()
    ship(data.spark)
    shift, scale = scaling(data, scaled)
    names = {c: k for k, (c, _) in enumerate(data.classes)} if data.target else {}
    frame = data.matrix if frame is None else frame
    parts = max(1, int(data.spark.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(extra).cast("double") if extra else F.lit(0.0)
    dealt = frame.select("_id", "_y", "x", value.alias("e")).repartitionByRange(parts, "_id").sortWithinPartitions("_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("_id").to_numpy()
                ys = np.array([names.get(y, -1) for y in part.column("_y").to_pylist()], np.int32)
                x = (part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) - shift) / scale
                e = part.column("e").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"b": pa.array([ids[0]]), "ids": [ids.astype("<i8").tobytes()], "ys": [ys.tobytes()], "xs": [x.astype("<f8").tobytes()], "es": [e.astype("<f8").tobytes()]})

    return settled(dealt.mapInArrow(pack, "b long, ids binary, ys binary, xs binary, es binary"))


class Block:
    def __init__(self, ids: bytes, ys: bytes, xs: bytes, es: bytes) -> None:
        self.ids, self.ys = np.frombuffer(ids, "<i8"), np.frombuffer(ys, np.int32)
        self.x, self.e = np.frombuffer(xs, "<f8").reshape(len(self.ids), -1), np.frombuffer(es, "<f8")


def block_pairs(left: DataFrame, right: DataFrame, kernel: Callable[[Block, Block], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``kernel`` on every pair of a left and a right block.

    Blocks are dealt to the rows (left) and columns (right) of a square grid; a cell is a
    task's work: it holds its left blocks, some ``CELL`` bytes, and streams its right ones
    past them. So a block is sent once for each row or column of the grid, and not once
    for each other block."""
    weight = F.sum(F.length("xs") + F.length("ids"))
    size = max(left.agg(weight).first()[0] or 0, right.agg(weight).first()[0] or 0)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at least a cell for each task, as long as there are blocks for them
    grid = max(1, -(-size // CELL), min(int(np.ceil(np.sqrt(tasks))), -(-size // LEAST)))
    place = lambda salt: F.pmod(F.xxhash64("b", F.lit(salt)), F.lit(grid))
    every = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    rows = left.select(place(1).cast("int").alias("i"), every.alias("j"), F.lit(0).alias("side"), "b", "ids", "ys", "xs", "es")
    columns = right.select(every.alias("i"), place(2).cast("int").alias("j"), F.lit(1).alias("side"), "b", "ids", "ys", "xs", "es")
    cell = (F.col("i") * grid + F.col("j")).cast("int")
    dealt = rows.unionByName(columns).withColumn("cell", cell).repartitionById(grid * grid, "cell").sortWithinPartitions("side", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(*[batch.column(c)[k].as_py() for c in ("ids", "ys", "xs", "es")])
                if batch.column("side")[k].as_py() == 0:
                    held.append(block)
                    continue
                for other in held:
                    found = kernel(other, block)
                    if found and len(next(iter(found.values()))):
                        yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in found.items()})

    return dealt.mapInArrow(work, schema)


class Rows:
    """One side of a cell: rows by class and id, with the tiles of each class."""

    def __init__(self, held: list[Block]) -> None:
        self.ids, self.ys, self.x, self.e = (np.concatenate([getattr(z, c) for z in held]) for c in ("ids", "ys", "x", "e"))
        order = np.lexsort((self.ids, self.ys))
        self.ids, self.ys, self.x, self.e = self.ids[order], self.ys[order], self.x[order], self.e[order]
        self.classes, self.sizes = np.unique(self.ys, return_counts=True)
        ends = np.cumsum(self.sizes)
        self.tiles = [(c, slice(at, min(at + TILE, end))) for c, (end, n) in enumerate(zip(ends, self.sizes, strict=True)) for at in range(end - n, end, TILE)]


def cells(left: DataFrame, work: Callable[[Rows, Rows | None], Iterator[dict[str, np.ndarray]]], schema: str, right: DataFrame | None = None) -> DataFrame:
    """``work`` on the rows of every cell of a grid, which gives columns. Without ``right``,
    the rows of ``left`` meet each other: each pair of groups once, and a group itself
    with None as the other one. What a cell finds is added up there, so a row leaves it
    once for each class and not once for each block that it met."""
    ship(left.sparkSession)
    grid = _grid(left, right)
    place = lambda salt: F.pmod(F.xxhash64("b", F.lit(salt)), F.lit(grid)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    columns = ("b", "ids", "ys", "xs", "es")
    if right is None:
        own = left.select(place(1).alias("g"), every.alias("h"), *columns)
        low, high = F.least("g", "h"), F.greatest("g", "h")
        dealt = own.select((high * (high + 1) / 2 + low).cast("int").alias("cell"), (F.col("g") == high).cast("int").alias("side"), *columns)
        parts = grid * (grid + 1) // 2
    else:
        one = left.select(place(1).alias("g"), every.alias("h"), F.lit(0).alias("side"), *columns)
        two = right.select(every.alias("g"), place(2).alias("h"), F.lit(1).alias("side"), *columns)
        dealt, parts = one.unionByName(two).select((F.col("g") * grid + F.col("h")).cast("int").alias("cell"), "side", *columns), grid * grid
    alone = right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[Block]] = [[], []]
        for batch in batches:
            for k in range(batch.num_rows):
                held[batch.column("side")[k].as_py()].append(Block(*[batch.column(c)[k].as_py() for c in columns[1:]]))
        if alone and held[1] and not held[0]:  # a group with itself, or one that meets an empty one
            held = [held[1], []]
        if not held[0] or not (alone or held[1]):
            return
        a, b = Rows(held[0]), Rows(held[1]) if held[1] else None
        held.clear()
        for found in work(a, b):
            size = len(next(iter(found.values())))
            for at in range(0, size, 65536):
                yield pa.RecordBatch.from_pydict({c: pa.array(v[at : at + 65536]) for c, v in found.items()})

    if alone:
        # of a group that meets an empty one, only the cell on the diagonal counts
        dealt = dealt.withColumn("own", F.col("cell").isin([k * (k + 3) // 2 for k in range(grid)]))
        plain = run

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, own = [], False
            for batch in batches:
                own = own or batch.num_rows > 0 and batch.column("own")[0].as_py()
                kept.append(batch)
            sides = {v for batch in kept for v in batch.column("side").to_pylist()}
            if own or len(sides) == 2:
                yield from plain(iter(kept))

    return dealt.repartitionById(parts, "cell").mapInArrow(run, schema)


def _grid(left: DataFrame, right: DataFrame | None) -> int:
    weight = F.sum(F.length("xs") + F.length("ids"))
    size = max(0 if x is None else x.agg(weight).first()[0] or 0 for x in (left, right))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // HELD), min(int(np.ceil(np.sqrt(tasks))), -(-size // LEAST)))


def met(a: Rows, b: Rows | None) -> Iterator[tuple[tuple[int, slice], tuple[int, slice], bool]]:
    """The pairs of tiles of a cell, each once, and whether it is a tile with itself."""
    for k, one in enumerate(a.tiles):
        for two in a.tiles[k:] if b is None else b.tiles:
            yield one, two, b is None and one is two


def exact(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of rows to the rows at their side."""
    out = np.empty(len(a))
    for k in range(0, len(a), 8192):
        gap = np.abs(a[k : k + 8192] - b[k : k + 8192])
        if metric in ("euclidean", "sqeuclidean"):
            out[k : k + 8192] = np.einsum("ij,ij->i", gap, gap)
        elif metric == "minkowski":
            out[k : k + 8192] = (gap**p).sum(-1) ** (1 / p)
        else:
            out[k : k + 8192] = {"gower": gap.mean, "cityblock": gap.sum, "chebyshev": gap.max}[metric](-1)
    return np.sqrt(out) if metric == "euclidean" else out


class Rough:
    """Cheap values of the distances of a cell's tiles, in a unit of their own, that are
    off by ``slack`` at most: squares from a matrix product, sums of 16-bit steps, or
    else the distances themselves."""

    def __init__(self, a: Rows, b: Rows | None, metric: str, p: float) -> None:
        self.metric, self.p, self.slack, self.a, self.b = metric, p, 0.0, a, b or a
        d = max(1, a.x.shape[1])
        self.kind = "square" if metric in ("euclidean", "sqeuclidean") else "steps" if metric in ("gower", "cityblock") and d <= 4096 else "plain"
        if not (np.isfinite(a.x).all() and np.isfinite(self.b.x).all()):
            self.kind = "plain"
        if self.kind == "square":
            centre = a.x.mean(0)
            self.u, self.v = a.x - centre, self.b.x - centre
            self.uu, self.vv = (self.u * self.u).sum(1), (self.v * self.v).sum(1)
            self.u *= -2
            self.slack = 1e-12 * (self.uu.max() + self.vv.max())
        elif self.kind == "steps":
            low = np.minimum(a.x.min(0), self.b.x.min(0))
            span = max(float((np.maximum(a.x.max(0), self.b.x.max(0)) - low).max()), 1e-300)
            steps = 65535 // d
            self.unit, self.slack = steps / span * (d if metric == "gower" else 1), float(d + 1)
            self.u, self.v = (np.ascontiguousarray(np.rint((x - low) * (steps / span)).astype(np.uint16).T) for x in (a.x, self.b.x))
            self.uu, self.vv = (x.sum(0, dtype=np.uint16) for x in (self.u, self.v))

    def of(self, value: np.ndarray) -> np.ndarray:
        return value * self.unit if self.kind == "steps" else value * value if self.metric == "euclidean" else value

    def tile(self, i: slice, j: slice) -> np.ndarray:
        if self.kind == "plain":
            return distances(self.a.x[i], self.b.x[j], self.metric, self.p)
        if self.kind == "square":
            out = self.u[i] @ self.v[j].T
            out += self.uu[i, None]
            out += self.vv[None, j]
            return np.maximum(out, 0, out=out)
        u, v = self.u[:, i], np.ascontiguousarray(self.v[:, j])
        out = np.zeros((u.shape[1], v.shape[1]), np.uint16)
        for at in range(0, len(out), 64):
            # the difference is twice the greater less the sum, modulo 2^16; the result is below that
            part, own = out[at : at + 64], u[:, at : at + 64]
            more = np.empty_like(part)
            for k in range(len(u)):
                np.maximum(own[k][:, None], v[k][None, :], out=more)
                np.add(part, more, out=part)
        out *= np.uint16(2)
        out -= self.uu[i, None]
        out -= self.vv[None, j]
        return out

    def distances(self, i: slice, j: slice) -> np.ndarray:
        """The distances of a tile to some 12 digits."""
        if self.kind != "square":
            return distances(self.a.x[i], self.b.x[j], self.metric, self.p)
        out = self.tile(i, j)
        row, column = np.nonzero(out < 1e-3 * (self.uu[i].max() + self.vv[j].max()))
        np.sqrt(out, out=out) if self.metric == "euclidean" else None
        if len(row):
            out[row, column] = exact(self.a.x[i][row], self.b.x[j][column], self.metric, self.p)
        return out

    def limits(self, value: np.ndarray, sign: int, like: np.ndarray) -> np.ndarray:
        """Values of the unit, moved by the slack, in the type of a tile."""
        moved = value + sign * self.slack
        return np.clip(np.floor(moved) if sign > 0 else np.ceil(moved), 0, 65535).astype(np.uint16) if like.dtype == np.uint16 else moved


def _better(lo: np.ndarray, at: np.ndarray, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Put nearer rows (the least id of equals) into ``lo`` and ``at``."""
    order = np.lexsort((ids, d, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    k, d, ids = row[first], d[first], ids[first]
    ok = (d < lo[k]) | (d == lo[k]) & (ids < at[k])
    lo[k[ok]], at[k[ok]] = d[ok], ids[ok]


#: What row_statistics finds: numbers that each part adds to ``i, y, c, n``.
PARTS = {"sums": ("s", "q", "lo", "hi"), "near": ("lo", "at"), "weights": ("w", "wd", "e")}


def shared_statistics(data: Data, metric: str = "euclidean", p: float = 2.0, scaled: bool = False, alphas: tuple[float, float, float] | None = None, part: str = "near") -> DataFrame:
    """``row_statistics`` of a dataset with itself, computed once for all measures that ask
    for the same part and distances."""
    store = data.__dict__.setdefault("_statistics", {})
    own = store.setdefault((metric, p, scaled, alphas), {})
    if part not in own:
        own[part] = settled(row_statistics(data, metric, p, shared_blocks(data, scaled), None, alphas, part))
    return own[part]


def shared_blocks(data: Data, scaled: bool) -> DataFrame:
    """The dataset's own blocks, packed once."""
    store = data.__dict__.setdefault("_blocks", {})
    if scaled not in store:
        store[scaled] = blocks(data, scaled)
    return store[scaled]


def row_statistics(data: Data, metric: str, p: float, left: DataFrame, right: DataFrame | None = None, alphas: tuple[float, float, float] | None = None, part: str = "near") -> DataFrame:
    """Per row ``i`` (class ``y``) of ``left`` and class ``c`` of the other rows (or of
    ``right``): their number ``n``, and of a part, sum ``s``, sum of squares ``q``, least
    and largest ``lo, hi`` of distances, the least one and its id ``lo, at`` (least id of
    equals), or the weighted sums of the concept measures (``w, wd, e``)."""
    root, names = np.sqrt(data.d), PARTS[part]
    alpha, beta, least = alphas or (0.0, 0.0, 0.0)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    start, both = {"lo": np.inf, "hi": -np.inf}, right is None

    def work(a: Rows, b: Rows | None) -> Iterator[dict[str, np.ndarray]]:
        rough, other = Rough(a, b, metric, p), a if b is None else b
        sides = [(a, other)] + ([(b, a)] if b is not None and both else [])
        kept = [{k: np.full((len(z.classes), len(x.ids)), start.get(k, 0), np.int64 if k == "at" else np.float64) for k in names} for x, z in sides]
        for (ca, i), (cb, j), same in met(a, b):
            # the tile's rows, and its columns as rows of the other side (or of this one)
            ways = [({k: v[cb] for k, v in kept[0].items()}, i, 1)]
            if both and not same:
                ways.append(({k: v[ca] for k, v in kept[-1].items()}, j, 0))
            if part == "near":
                tile = rough.tile(i, j)
                near = np.zeros(tile.shape, bool)
                for own, at, axis in ways:
                    some = tile if not same else np.where(np.eye(len(tile), dtype=bool), np.iinfo(np.uint16).max if tile.dtype == np.uint16 else np.inf, tile)
                    limit = rough.limits(np.minimum(some.min(axis) + rough.slack, rough.of(own["lo"][at])), 1, tile)
                    near |= tile <= (limit[:, None] if axis else limit[None, :])
                if same:
                    np.fill_diagonal(near, False)
                row, column = np.nonzero(near)
                d = exact(a.x[i][row], other.x[j][column], metric, p)
                for (own, at, axis), (mine, theirs) in zip(ways, ((row, other.ids[j][column]), (column, a.ids[i][row])), strict=False):
                    _better(own["lo"][at], own["at"][at], mine, d, theirs)
                continue
            d = rough.distances(i, j)
            if same:
                np.fill_diagonal(d, 0)
            if part == "sums":
                found = {"s": d, "q": d * d}
            else:
                room = root - d
                room[room <= 0] = least
                np.divide(d, room, out=room)
                room *= -alpha
                w = np.exp2(room, out=room)
                if same:
                    np.fill_diagonal(w, 0)
                found = {"w": w, "wd": w * d}
                # distances in reach of rounding of a whole number are measured exactly
                whole = np.rint(d)
                row, column = np.nonzero(np.abs(d - whole) < 1e-9)
                if len(row):
                    d[row, column] = exact(a.x[i][row], other.x[j][column], metric, p)
                up = np.ceil(d).astype(np.int64)
                e = np.exp2(-beta * np.maximum(1, np.arange(up.max() + 1 if up.size else 1)))[up] if up.max() < 1 << 16 else np.exp2(-beta * np.maximum(1, up))
                if same:
                    np.fill_diagonal(e, 0)
                found["e"] = e
            for own, at, axis in ways:
                for k, v in found.items():
                    own[k][at] += v.sum(axis)
                if part == "sums":
                    own["hi"][at] = np.maximum(own["hi"][at], d.max(axis))
                    if same:
                        np.fill_diagonal(d, np.inf)
                    own["lo"][at] = np.minimum(own["lo"][at], d.min(axis))
        for (x, z), found in zip(sides, kept, strict=True):
            for c, (name, size) in enumerate(zip(z.classes, z.sizes, strict=True)):
                n = size - ((x.ys == name) if x is z else np.zeros(len(x.ys), np.int64))
                ok = n > 0
                yield {"i": x.ids[ok], "y": x.ys[ok], "c": np.full(int(ok.sum()), name, np.int32), "n": n[ok].astype(np.int64)} | {k: v[c][ok] for k, v in found.items()}

    found = cells(left, work, "i long, y int, c int, n long, " + ", ".join(f"{k} {'long' if k == 'at' else 'double'}" for k in names), right)
    how = {"lo": F.min("lo"), "hi": F.max("hi"), "at": F.min_by("at", F.struct("lo", "at"))}
    return found.groupBy("i", "y", "c").agg(F.sum("n").alias("n"), *[how.get(k, F.sum(k)).alias(k) for k in names])


def nearest(stats: DataFrame, enemy: bool) -> DataFrame:
    """``i, y, d, at, c`` of the nearest row of another class, or of the own one."""
    some = stats.filter("c != y" if enemy else "c = y")
    return some.groupBy("i", "y").agg(F.min("lo").alias("d"), F.min_by(F.struct("at", "c"), F.struct("lo", "at")).alias("b")).select("i", "y", "d", "b.at", "b.c")


def reach(data: Data, k: int, metric: str, p: float, scaled: bool = True) -> DataFrame:
    """``_id, d, j``: distance and id of the ``k``-th nearest other row of each row (the
    lesser id is nearer of equals), the last one if there are fewer.

    A task keeps some rows and all others' rough distances to a few of them at a time;
    only those within the bound of the ``k``-th are measured exactly."""
    packed = shared_blocks(data, scaled)
    strips = min(STRIPS, max(1, data.n // ROWS))
    every = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))
    columns = ("b", "ids", "ys", "xs", "es")
    own = packed.select(F.pmod(F.xxhash64("b"), F.lit(strips)).cast("int").alias("strip"), F.lit(0).alias("side"), *columns)
    others = packed.select(every.alias("strip"), F.lit(1).alias("side"), *columns)
    dealt = own.unionByName(others).repartitionById(strips, "strip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[Block]] = [[], []]
        for batch in batches:
            for at in range(batch.num_rows):
                held[batch.column("side")[at].as_py()].append(Block(*[batch.column(c)[at].as_py() for c in columns[1:]]))
        if not held[0]:
            return
        a, b = Rows(held[0]), Rows(held[1])
        rough, size = Rough(a, b, metric, p), len(b.ids)
        place, step = min(k, size - 1) - 1, max(1, min(64, (32 << 20) // (8 * max(1, size))))
        if place < 0:
            return
        for low in range(0, len(a.ids), step):
            i = slice(low, min(low + step, len(a.ids)))
            tile = np.concatenate([rough.tile(i, slice(at, min(at + TILE, size))) for at in range(0, size, TILE)], axis=1).astype(np.float64)
            tile[a.ids[i, None] == b.ids[None, :]] = np.inf
            middle = np.partition(tile, place, axis=1)[:, place]
            found: tuple[list, list] = ([], [])
            for row, (own, centre) in enumerate(zip(tile, middle, strict=True)):
                # values that the bound can't part from the k-th one
                below = int((own < centre - 2 * rough.slack).sum())
                near = np.flatnonzero((own >= centre - 2 * rough.slack) & (own <= centre + 2 * rough.slack))
                d = exact(np.broadcast_to(a.x[low + row], (len(near), a.x.shape[1])), b.x[near], metric, p)
                at = np.lexsort((b.ids[near], d))[place - below]
                found[0].append(d[at])
                found[1].append(b.ids[near[at]])
            yield pa.RecordBatch.from_pydict({"_id": pa.array(a.ids[i]), "d": pa.array(found[0], pa.float64()), "j": pa.array(found[1], pa.int64())})

    return dealt.mapInArrow(run, "_id long, d double, j long")
