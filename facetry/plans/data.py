"""A dataset bound to column roles, with the shared intermediates of all measures.

Every intermediate is a lazily made, memoised result of one Spark job whose size depends
on the number of columns, classes or levels and not on the number of rows; row-sized
intermediates stay DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.session import settled, ship

NAN = float("nan")
#: The arguments of each rescaling.
RESCALE_ARGS = {"standard": ("with_mean", "with_std"), "min-max": ("feature_range",), "robust": ("with_centering", "with_scaling", "quantile_range")}
#: Levels of a categorical column that may become columns of their own.
MAX_LEVELS = 10_000
#: Rows of a key that the last pass of a selection counts whole, different values of a key
#: and task that its first pass does, and codes of a pass in between.
BRACKET, FEW, CODES = 200_000, 1024, 1 << 18


class Data:
    """``df`` with a target (or none), attributes and a row id.

    ``categorical`` is ``"auto"`` (by type), a list of names, or empty for none;
    ``encode`` one of gray, one-hot, one-hot-full and None; ``rescale`` one of standard,
    min-max, robust and None, with ``rescale_args``: ``feature_range`` of min-max,
    ``with_mean`` and ``with_std`` of standard, ``with_centering``, ``with_scaling`` and
    ``quantile_range`` (in per cent) of robust. ``tree`` are the model-based group's
    hyper-parameters. The row id must be unique; it orders rows."""

    def __init__(
        self,
        df: DataFrame,
        target: str | None = None,
        attributes: list[str] | None = None,
        row_id: str | None = None,
        categorical="auto",
        encode: str | None = "gray",
        discretise: bool = True,
        rescale: str | None = None,
        check_bool: bool = False,
        seed: int | None = None,
        rescale_args: dict | None = None,
        tree: dict | None = None,
    ) -> None:
        if encode not in ("gray", "one-hot", "one-hot-full", None):
            raise ValueError(f"unknown encoding {encode!r}")
        if rescale not in ("standard", "min-max", "robust", None):
            raise ValueError(f"unknown rescaling {rescale!r}")
        self.df, self.target, self.row_id = df, target, row_id
        self.encode, self.discretise, self.rescale, self.seed = encode, discretise, rescale, seed
        self.rescale_args, self.tree = dict(rescale_args or {}), dict(tree or {})
        if unknown := set(self.rescale_args) - set(RESCALE_ARGS.get(rescale, ())):
            raise ValueError(f"rescale {rescale!r} has no arguments {', '.join(sorted(unknown))}")
        self.attributes = attributes or [c for c in df.columns if c not in (target, row_id)]
        kinds = {f.name: f.dataType for f in df.schema}
        for c in self.attributes:
            if not isinstance(kinds[c], (T.NumericType, T.BooleanType, T.StringType)):
                raise ValueError(f"{c} is neither a number nor a string; expand or leave it out")
        if categorical == "auto":
            self.categorical = [c for c in self.attributes if isinstance(kinds[c], T.StringType)]
        elif isinstance(categorical, (list, tuple)) or not categorical:
            self.categorical = [c for c in self.attributes if c in (categorical or ())]
        else:
            raise ValueError("categorical is 'auto', a list of names, or empty")
        if check_bool:
            two = {k for k, n in self.distinct.items() if n == 2}
            self.categorical = [c for c in self.attributes if c in self.categorical or c in two]
        self.numeric = [c for c in self.attributes if c not in self.categorical]

    # ---- frames

    @property
    def spark(self):
        return self.df.sparkSession

    def derive(self, df: DataFrame, **changed) -> Data:
        """Another dataset of the same roles and options."""
        own = {k: getattr(self, k) for k in ("target", "attributes", "row_id", "categorical", "encode", "discretise", "rescale", "seed", "rescale_args", "tree")}
        return Data(df, **(own | changed))

    def subsample(self, share: float) -> Data:
        """The dataset of ``share`` of the rows, those with the least seeded hashes of their
        ids. The hash that parts them is found by counting, not by a sort."""
        self.needs_id()
        size = int(share * self.n)
        if size >= self.n:
            return self
        # 53 bits are exact in a double
        code = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed or 0), F.col(self.row_id)), 11).cast("double")
        if size < 1:
            return self.derive(self.df.limit(0))
        middle = order_statistics(self.df, {"h": code}, [(size - 0.5) / (self.n - 1)])["h"][0]
        return self.derive(self.df.filter(code <= middle))

    @cached_property
    def source(self) -> DataFrame:
        """``_id, _y`` and the attributes; the id is null without a row id."""
        rid = F.col(self.row_id) if self.row_id else F.lit(None)
        y = F.col(self.target).cast("string") if self.target else F.lit(None).cast("string")
        return self.df.select(rid.cast("long").alias("_id"), y.alias("_y"), *self.attributes)

    def needs_id(self) -> None:
        """Raise unless rows have ids."""
        if not self.row_id:
            raise ValueError("this measure depends on rows; name a row id")

    @cached_property
    def n(self) -> int:
        return self.df.count()

    @cached_property
    def d(self) -> int:
        return len(self.numeric_names)

    @cached_property
    def classes(self) -> list[tuple[str, int]]:
        """Classes with their rows, sorted as the target's own type sorts."""
        if self.target is None:
            raise ValueError("a target is needed")
        found = self.df.groupBy(F.col(self.target).alias("y")).agg(F.count("*").alias("n")).orderBy("y").collect()
        return [(str(r["y"]) if not isinstance(r["y"], bool) else str(r["y"]).lower(), r["n"]) for r in found if r["y"] is not None]

    @cached_property
    def levels(self) -> dict[str, list[str]]:
        """Sorted levels of the categorical columns."""
        if not self.categorical:
            return {}
        long = self.long({c: F.col(c).cast("string") for c in self.categorical}, self.df)
        found = long.groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("levels"), F.count_if(F.col("v").isNull()).alias("missing")).collect()
        for r in found:
            if r["missing"]:
                raise ValueError(f"{r['key']} has missing values; categorical attributes can't be encoded then")
            if len(r["levels"]) > MAX_LEVELS:
                raise ValueError(f"{r['key']} has more than {MAX_LEVELS} levels")
        return {r["key"]: r["levels"] for r in found}

    @cached_property
    def encoded(self) -> dict[str, Column]:
        """Numeric columns, then those of the encoded categorical ones, before rescaling."""
        out = {c: F.col(c).cast("double") for c in self.numeric}
        if self.encode:
            for k, c in enumerate(self.categorical):
                some = self.levels[c]
                if self.encode == "one-hot" and len(some) < 2:
                    raise ValueError(f"{c} has fewer than two levels")
                if self.encode == "one-hot" or self.encode == "gray" and k:
                    some = some[1:]
                for level in some:
                    out[f"{c}={level}"] = (F.col(c).cast("string") == level).cast("double")
        return out

    @cached_property
    def numeric_columns(self) -> dict[str, Column]:
        if not self.rescale:
            return self.encoded
        plain, given = self.derive(self.df, rescale=None, rescale_args=None), self.rescale_args
        moments = plain.moments
        lower, upper = given.get("quantile_range", (25.0, 75.0))
        quarters = plain.quantiles((lower / 100, 0.5, upper / 100)) if self.rescale == "robust" else {}
        low, high = given.get("feature_range", (0.0, 1.0))
        if not low < high or not 0 <= lower < upper <= 100:
            raise ValueError("ranges go from a lower to a higher value")
        out = {}
        for name, x in self.encoded.items():
            m = moments[name]
            if self.rescale == "standard":
                shift = m["mean"] if given.get("with_mean", True) else 0.0
                scale = math.sqrt(m["var"]) if given.get("with_std", True) else 1.0
            elif self.rescale == "min-max":
                shift, scale = m["min"], m["max"] - m["min"]
            else:
                shift = quarters[name][1] if given.get("with_centering", True) else 0.0
                scale = quarters[name][2] - quarters[name][0] if given.get("with_scaling", True) else 1.0
            out[name] = (x - F.lit(float(shift))) / F.lit(float(scale) or 1.0)
            if self.rescale == "min-max" and (low, high) != (0.0, 1.0):
                out[name] = out[name] * F.lit(float(high - low)) + F.lit(float(low))
        return out

    @cached_property
    def numeric_names(self) -> list[str]:
        return list(self.numeric_columns)

    @cached_property
    def N(self) -> DataFrame:
        """``_id, _y, x0, x1, ...``: the numeric matrix."""
        return self.source.select("_id", "_y", *[x.alias(f"x{k}") for k, x in enumerate(self.numeric_columns.values())])

    @cached_property
    def matrix(self) -> DataFrame:
        """``_id, _y, x`` with one array a row."""
        return self.source.select("_id", "_y", F.array(*self.numeric_columns.values()).alias("x"))

    @cached_property
    def cuts(self) -> dict[str, list[float]]:
        """Cut points of equal-frequency discretisation."""
        bins = int(self.n ** (1 / 3))
        if not self.numeric or bins < 1:
            return {c: [] for c in self.numeric}
        found = order_statistics(self.source, {c: F.col(c).cast("double") for c in self.numeric}, [k / bins for k in range(1, bins + 1)])
        out = {}
        for c, values in found.items():
            kept = [values[0]]
            for v in values[1:]:
                if abs(v - kept[-1]) > 1e-8:
                    kept.append(v)
            out[c] = kept
        return out

    @cached_property
    def categories(self) -> dict[str, Column]:
        """Categorical columns, then discretised numeric ones, as strings."""
        out = {c: F.col(c).cast("string") for c in self.categorical}
        if self.discretise:
            for c in self.numeric:
                # one constant array a column; a chain of comparisons outgrows generated code
                code = _passed(F.col(c).cast("double"), F.array(*[F.lit(v) for v in self.cuts[c]]).cast("array<double>"))
                out[c] = code.cast("string")
        return out

    def long(self, columns: dict[str, Column], df: DataFrame | None = None, *keep: str) -> DataFrame:
        """``key, v`` of each column and row (and ``keep``)."""
        pairs = [F.struct(F.lit(k).alias("key"), x.alias("v")) for k, x in columns.items()]
        return (self.source if df is None else df).select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.key", "_p.v")

    # ---- shared jobs

    @cached_property
    def distinct(self) -> dict[str, int]:
        """Distinct values of every attribute, by one grouping of the long frame."""
        long = self.long({c: F.col(c).cast("string") for c in self.attributes}, self.df)
        return {r["key"]: r["k"] for r in long.groupBy("key", "v").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("k")).collect()}

    def _column_sums(self, parts) -> dict[str | None, np.ndarray]:
        """By class, ``parts(x, class)`` (statistics x columns) of all rows of each task,
        merged as ``parts.how`` says: sums, minima or maxima. Wide tables would make
        thousands of aggregate expressions; a kernel makes one pass of arrays."""
        ship(self.spark)
        d = self.d

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str | None, np.ndarray] = {}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                codes = batch.column("_y").dictionary_encode()
                names, index = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for k in np.unique(index):
                    name = names[k] if k >= 0 else None
                    with np.errstate(all="ignore"):
                        own = parts(x[index == k], name)
                    if name in total:
                        for i, how in enumerate(parts.how):
                            how(total[name][i], own[i], out=total[name][i])
                    else:
                        total[name] = own
            for name, rows in total.items():
                yield pa.RecordBatch.from_pydict({"y": pa.array([name] * rows.size, pa.string()), "place": pa.array(range(rows.size), pa.int32()), "v": pa.array(rows.ravel())})

        found = self.matrix.select("_y", "x").mapInArrow(work, "y string, place int, v double").groupBy("y", "place").agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        out: dict[str | None, np.ndarray] = {}
        kinds = ["s" if how is np.add else "lo" if how is np.minimum else "hi" for how in parts.how]
        for r in found.collect():
            rows = out.setdefault(r["y"], np.zeros((len(kinds), d)))
            rows[r["place"] // d, r["place"] % d] = r[kinds[r["place"] // d]]
        return out

    @cached_property
    def _first_pass(self) -> dict[str | None, np.ndarray]:
        def parts(x: np.ndarray, _) -> np.ndarray:
            ok = ~np.isnan(x)
            return np.array([ok.sum(0), np.where(ok, x, 0).sum(0), np.where(ok, x, np.inf).min(0), np.where(ok, x, -np.inf).max(0), np.where(x > 0, np.log(x), 0).sum(0), (x > 0).sum(0), np.where(ok & (x != 0), 1 / x, 0).sum(0)])

        parts.how = [np.add, np.add, np.minimum, np.maximum, np.add, np.add, np.add]
        return self._column_sums(parts)

    @cached_property
    def _second_pass(self) -> dict[str | None, np.ndarray]:
        """Squared deviations from the class means, and powers of those from the means."""
        own = {y: v[1] / np.maximum(v[0], 1) for y, v in self._first_pass.items()}
        n = np.maximum(sum(v[0] for v in self._first_pass.values()), 1)
        mean = sum(v[1] for v in self._first_pass.values()) / n

        def parts(x: np.ndarray, y) -> np.ndarray:
            away = np.nan_to_num(x - mean)
            return np.array([np.nan_to_num((x - own[y]) ** 2).sum(0), (away**2).sum(0), (away**3).sum(0), (away**4).sum(0)])

        parts.how = [np.add] * 4
        return self._column_sums(parts)

    @cached_property
    def moments(self) -> dict[str, dict[str, float]]:
        """Moments and extremes of all numeric columns; two passes, the second about the
        means, so large offsets cost no digits."""
        if not self.d:
            return {}
        one, two = list(self._first_pass.values()), sum(self._second_pass.values())
        n, total, logs, above, inverse = (sum(v[k] for v in one) for k in (0, 1, 4, 5, 6))
        with np.errstate(all="ignore"):
            mean, var = total / n, two[1] / n
            stats = {"n": n, "mean": mean, "var": var, "min": np.min([v[2] for v in one], 0), "max": np.max([v[3] for v in one], 0), "skew": two[2] / n / var**1.5, "kurt": two[3] / n / var**2 - 3, "log": logs / above, "inverse": inverse}
        return {name: {m: float(v[k]) for m, v in stats.items()} for k, name in enumerate(self.numeric_names)}

    def quantiles(self, shares: tuple[float, ...]) -> dict[str, list[float]]:
        return order_statistics(self.source, self.numeric_columns, list(shares))

    @cached_property
    def by_class(self) -> dict[str, list[dict[str, float]]]:
        """Per class and numeric column: n, mean, population variance, min, max."""
        out = {}
        for c, _ in self.classes:
            one, two = self._first_pass[c], self._second_pass[c]
            out[c] = [{"n": float(one[0, k]), "mean": float(one[1, k] / one[0, k]), "var": float(two[0, k] / one[0, k]), "min": float(one[2, k]), "max": float(one[3, k])} for k in range(self.d)]
        return out

    def grams(self, frame: DataFrame, keys: list[str]) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
        """By ``keys``: rows, sums and cross products of ``x``, centred by the overall
        means. Each task adds up its part; only sums are shuffled."""
        ship(self.spark)
        centre = np.array([self.moments[c]["mean"] for c in self.numeric_names])
        d, kinds = self.d, [frame.schema[k].dataType.simpleString() for k in keys]
        schema = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + ", place int, v double"

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            types: dict[str, pa.DataType] = {}
            for batch in batches:
                types = {k: batch.column(k).type for k in keys}
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - centre
                code = np.zeros(batch.num_rows, np.int64)
                for k in keys:
                    found = batch.column(k).dictionary_encode()
                    code = code * (len(found.dictionary) + 1) + found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
                for at in np.unique(code, return_index=True)[1].tolist():
                    name = tuple(batch.column(k)[at].as_py() for k in keys)
                    own = x[code == code[at]]
                    part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                    total[name] = total.get(name, 0) + part
            for name, part in total.items():
                yield pa.RecordBatch.from_pydict({**{k: pa.array([v] * len(part), types[k]) for k, v in zip(keys, name, strict=True)}, "place": pa.array(range(len(part)), pa.int32()), "v": pa.array(part)})

        out: dict[tuple, np.ndarray] = {}
        summed = frame.select(*keys, "x").mapInArrow(add, schema).groupBy(*keys, "place").agg(F.sum("v").alias("v"))
        for r in summed.collect():
            out.setdefault(tuple(r[k] for k in keys), np.zeros(1 + d + d * d))[r["place"]] = r["v"]
        return {k: (round(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}

    @cached_property
    def gram(self) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
        return {k[0]: v for k, v in self.grams(self.matrix, ["_y"]).items()}

    @cached_property
    def scatter(self) -> np.ndarray:
        """Sum of squared deviations from the overall means."""
        total = sum(n for n, _, _ in self.gram.values())
        sums = sum(s for _, s, _ in self.gram.values())
        return sum(g for _, _, g in self.gram.values()) - np.outer(sums, sums) / total

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / (self.n - ddof) if self.n > ddof else np.full((self.d, self.d), NAN)

    @cached_property
    def counts(self) -> DataFrame:
        """``key, v, y, n``: the contingency of every category column with the target."""
        found = self.contingency([(c, None) for c in self.categories])
        return settled(found.select(F.col("a").alias("key"), F.col("x").alias("v"), "y", "n"))

    def contingency(self, pairs: list[tuple[str, str | None]]) -> DataFrame:
        """``a, b, x, y, n``: how often the values of two category columns meet; a second
        one of None is the target. Each task codes its rows once (a numeric column by its
        cuts) and counts all pairs by arrays, so only counts are shuffled."""
        ship(self.spark)
        used = [c for c in self.categories if any(c in p for p in pairs)]
        numbers = [c for c in used if c not in self.categorical]
        cuts = {c: np.array(self.cuts[c], np.float64) for c in numbers}
        columns = [F.col(c).cast("double" if c in cuts else "string").alias(f"c{k}") for k, c in enumerate(used)]
        place = {c: k for k, c in enumerate(used)} | {None: len(used)}

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # levels by order of appearance in the task, the null first; codes of numbers are fixed
            levels: list[dict] = [{None: 0} for _ in range(len(used) + 1)]
            total: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                codes = []
                for k, c in enumerate([*used, None]):
                    own = batch.column(k)
                    if c in cuts:
                        v = own.to_numpy(zero_copy_only=False).astype(np.float64)
                        code = np.searchsorted(cuts[c], v, side="left")
                        codes.append(np.where(own.is_null().to_numpy(zero_copy_only=False), 0, code))
                    else:
                        found = own.dictionary_encode()
                        known = np.array([levels[k].setdefault(x, len(levels[k])) for x in found.dictionary.to_pylist()] + [0], np.int64)
                        codes.append(known[found.indices.fill_null(-1).to_numpy(zero_copy_only=False)])
                for a, b in pairs:
                    i, j = place[a], place[b]
                    met = np.unique(codes[i].astype(np.int64) << 32 | codes[j], return_counts=True)
                    parts = total.setdefault((i, j), [])
                    parts.append(met)
                    if sum(len(x) for x, _ in parts) > 1 << 18:
                        total[i, j] = [_added(parts)]
            names = [None if k < len(used) and used[k] in cuts else list(x) for k, x in enumerate(levels)]
            for (i, j), parts in total.items():
                codes, n = _added(parts)
                for at in range(0, len(codes), 65536):
                    left, right = (codes[at : at + 65536] >> 32).tolist(), (codes[at : at + 65536] & (1 << 32) - 1).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "i": pa.array([i] * len(left), pa.int32()),
                            "j": pa.array([j] * len(left), pa.int32()),
                            "x": pa.array([str(v) if names[i] is None else names[i][v] for v in left], pa.string()),
                            "y": pa.array([str(v) if names[j] is None else names[j][v] for v in right], pa.string()),
                            "n": pa.array(n[at : at + 65536], pa.int64()),
                        }
                    )

        counted = self.source.select(*columns, F.col("_y")).mapInArrow(work, "i int, j int, x string, y string, n long")
        name = F.array(*[F.lit(c) for c in used], F.lit(None).cast("string"))
        return counted.groupBy("i", "j", "x", "y").agg(F.sum("n").alias("n")).select(F.get(name, "i").alias("a"), F.get(name, "j").alias("b"), "x", "y", "n")

    def ranked(self, by: str | None = None, mixed: bool = False) -> DataFrame:
        """The row ids with ``rank`` (from 0) by id (or ``mixed``, by a seeded hash of it),
        within ``by`` (``_y``) if given, and ``_y``. Ranks are made by ranges and a prefix
        sum of their counts, so no class or table is sorted in one task."""
        self.needs_id()
        place = F.xxhash64(F.lit(self.seed or 0), "_id") if mixed else F.lit(0).cast("long")
        keys = ([by] if by else []) + ["_place", "_id"]
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = settled(self.source.select("_id", "_y", place.alias("_place")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
        group = ["_part"] + ([by] if by else [])
        sizes = dealt.groupBy(*group).agg(F.count("*").alias("rows"))
        over = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy("_part")
        before = sizes.withColumn("before", F.sum("rows").over(over) - F.col("rows")).drop("rows")
        own = dealt.withColumn("within", F.row_number().over(Window.partitionBy(*group).orderBy("_place", "_id")) - 1)
        joined = own.join(before, group)
        return joined.select("_id", "_y", (F.col("within") + F.col("before")).alias("rank"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their counts over all parts."""
    codes, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _passed(x: Column, cuts: Column) -> Column:
    """Number of cuts below ``x``."""
    return F.size(F.filter(cuts, lambda cut: cut < x))


def _sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order (no NaN, one zero)."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _unsortable(code: int) -> float:
    bits = code & ~(1 << 63) if code >> 63 else ~code & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles (linear between neighbours) of every column, nulls and NaN left out."""
    names, d = list(columns), len(columns)
    if not names:
        return {}
    frame = df.select(F.array(*[x.cast("double") for x in columns.values()]).alias("x"))

    def split(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        for k, name in enumerate(names):
            yield name, flat[:, k]

    def places(size: int) -> list[int]:
        return [rank for share in shares for rank in (math.floor(share * (size - 1)), math.ceil(share * (size - 1)))]

    found, out = selected(frame, split, places), {}
    for name in names:
        size, value = found.get(name, (0, {}))
        got = []
        for share in shares:
            at = share * (size - 1)
            low, high = (value[math.floor(at)], value[math.ceil(at)]) if size else (NAN, NAN)
            got.append(low + (high - low) * (at - math.floor(at)) if size else NAN)
        out[name] = got
    return out


def selected(frame: DataFrame, split: Callable[[pa.RecordBatch], Iterable[tuple[str, np.ndarray]]], places: Callable[[int], list[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """By key, the number of values (NaN left out) and those of the ranks that ``places``
    names for so many; ``split`` gives the keys and doubles of a batch.

    Radix selection on the bits of the values: a pass counts some bits of those values
    that share their higher bits with a wanted rank, 16 at first and then so many that
    all codes of a pass are about ``CODES``, whatever the ranks and the values' number.
    Tasks count first and only counts are shuffled; they reach the driver as packed
    arrays. Keys with few different values are done by the first pass, others once few
    rows are left under their ranks."""
    ship(frame.sparkSession)

    def counted(wanted: dict[str, tuple[np.ndarray, int, int]] | None) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
        """By key, a shift, the codes from it on and their rows: under the prefixes of
        ``wanted`` (with the bits that they and the codes start from), or of all values."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            short: set[str] = set()
            for batch in batches:
                for key, v in split(batch):
                    if wanted is not None and key not in wanted:
                        continue
                    u = _sortable(v[~np.isnan(v)])
                    if wanted is not None:
                        prefixes, above, shift = wanted[key]
                        high = u >> np.uint64(above)
                        place = np.minimum(np.searchsorted(prefixes, high), len(prefixes) - 1)
                        u = u[prefixes[place] == high] >> np.uint64(shift)
                    elif key in short:
                        u = u >> np.uint64(48)
                    if not len(u):
                        continue
                    parts = total.setdefault(key, [])
                    parts.append(np.unique(u, return_counts=True))
                    if wanted is None and key not in short and sum(len(x) for x, _ in parts) > FEW:
                        total[key] = parts = [_added(parts)]
                        if len(parts[0][0]) > FEW:
                            short.add(key)
                            total[key] = [_added([(parts[0][0] >> np.uint64(48), parts[0][1])])]
                    elif sum(len(x) for x, _ in parts) > 1 << 18:
                        total[key] = [_added(parts)]
            for key, parts in total.items():
                codes, n = _added(parts)
                shift = wanted[key][2] if wanted is not None else 48 if key in short else 0
                for at in range(0, len(codes), 65536):
                    own = codes[at : at + 65536]
                    yield pa.RecordBatch.from_pydict({"k": pa.array([key] * len(own), pa.string()), "shift": pa.array([shift] * len(own), pa.int32()), "code": pa.array(own.view(np.int64)), "n": pa.array(n[at : at + 65536])})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("k").dictionary_encode()
                shift, code, n = (batch.column(c).to_numpy() for c in ("shift", "code", "n"))
                place = keys.indices.to_numpy()
                for k, key in enumerate(keys.dictionary.to_pylist()):
                    for low in np.unique(shift[place == k]).tolist():
                        own = (place == k) & (shift == low)
                        yield pa.RecordBatch.from_pydict({"k": [key], "shift": pa.array([low], pa.int32()), "codes": [code[own].tobytes()], "n": [n[own].tobytes()]})

        summed = frame.mapInArrow(count, "k string, shift int, code long, n long").groupBy("k", "shift", "code").agg(F.sum("n").alias("n"))
        got: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for r in summed.mapInArrow(pack, "k string, shift int, codes binary, n binary").toLocalIterator():
            got.setdefault(r["k"], []).append((r["shift"], np.frombuffer(r["codes"], np.uint64), np.frombuffer(r["n"], np.int64)))
        out = {}
        for key, parts in got.items():
            # a key that has many values in some task is counted by high bits in all
            shift = max(p[0] for p in parts)
            out[key] = shift, *_added([(codes >> np.uint64(shift - own), n) for own, codes, n in parts])
        return out

    table = counted(None)
    sizes = {key: int(n.sum()) for key, (_, _, n) in table.items()}
    ranks = {key: np.array(sorted(set(places(size))), np.int64) for key, size in sizes.items()}
    # by key, the code of each rank, its place among the rows of that code, and the code's first bit
    state = {key: (np.zeros(len(r), np.uint64), r, 64) for key, r in ranks.items() if len(r)}
    done: dict[str, np.ndarray] = {}
    while state:
        wanted, left = {}, {}
        for key, (prefix, place, above) in state.items():
            shift, codes, n = table[key]
            upto = np.cumsum(n)
            # codes of one prefix follow each other
            start = np.searchsorted(codes >> np.uint64(above - shift), prefix) if above < 64 else np.zeros(len(place), np.int64)
            before = np.where(start > 0, upto[start - 1], 0)
            j = np.searchsorted(upto, before + place, side="right")
            place = place - (np.where(j > 0, upto[j - 1], 0) - before)
            if shift == 0:
                done[key] = codes[j]
                continue
            state[key] = codes[j], place, shift
            wanted[key], left[key] = np.unique(codes[j]), int(n[np.unique(j)].sum())
        state = {key: state[key] for key in wanted}
        if not state:
            break
        bits = max(1, min(16, int(math.log2(CODES / sum(len(x) for x in wanted.values()))) if sum(len(x) for x in wanted.values()) < CODES else 1))
        table = counted({key: (x, state[key][2], 0 if left[key] <= BRACKET else max(0, state[key][2] - bits)) for key, x in wanted.items()})
    return {key: (size, {r: _unsortable(int(c)) for r, c in zip(ranks[key].tolist(), done.get(key, []), strict=True)}) for key, size in sizes.items()}
