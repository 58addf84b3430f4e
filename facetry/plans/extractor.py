"""Extraction: a selection of groups, measures and summaries over a dataset.

    Extractor(groups="all", summary=["mean", "sd"]).fit(df, target="y", row_id="id").extract()

gives a DataFrame ``name, value`` (or a tuple, dict or pandas frame). Measures share the
jobs of their dataset; all vectors are summarised by one aggregation. A measure that fails
has no value, but a dataset beyond a measure's documented bound (``TooLarge``) and an
iteration without result (``NotConverged``) end the extraction: they are no missing
values."""

from __future__ import annotations

import time
import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import facetry.operators.clustering
import facetry.operators.complexity
import facetry.operators.concept
import facetry.operators.general
import facetry.operators.infotheo
import facetry.operators.itemset
import facetry.operators.landmarking
import facetry.operators.modelbased
import facetry.operators.statistical  # noqa: F401
from facetry.functions import summaries as S
from facetry.functions.scoring import SCORES, score_table
from facetry.operators.concept import ALPHAS
from facetry.operators.modelbased import OPTIONS, Nodes, nodes, nodes_of
from facetry.operators.pairwise import shared_statistics
from facetry.operators.relative import relative
from facetry.plans.data import NAN, Data
from facetry.plans.registry import DEFAULT_GROUPS, GROUPS, MEASURES, NEEDS, Measure
from facetry.session import settled

VALUES = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType())])
#: What a measure may fail with; it then has no values (or NaN if it is a number).
FAILURES = (TypeError, ValueError, ZeroDivisionError, MemoryError, ArithmeticError, AttributeError)


def valid_groups() -> tuple[str, ...]:
    """All groups."""
    return GROUPS


def valid_summary() -> tuple[str, ...]:
    """All summaries."""
    return S.SUMMARIES


def check_groups(groups) -> tuple[str, ...]:
    """The groups of a selection with those they need; ``all`` and ``default`` are known."""
    names = [groups] if isinstance(groups, str) else list(groups or ())
    out: list[str] = []
    for g in names:
        for x in GROUPS if g == "all" else DEFAULT_GROUPS if g == "default" else (g,):
            if x not in GROUPS:
                raise ValueError(f"unknown group {x!r}; known: {', '.join(GROUPS)}")
            out += [*NEEDS.get(x, ()), x]
    if not out:
        raise ValueError("no groups are chosen")
    return tuple(dict.fromkeys(out))


def valid_metafeatures(groups="all") -> tuple[str, ...]:
    """The measures of the groups."""
    chosen = check_groups(groups)
    return tuple(sorted({m.name for (g, _), m in MEASURES.items() if g in chosen}))


def metafeature_description(groups="all", sort_by_group: bool = False, sort_by_mtf: bool = False) -> list[tuple[str, str, str]]:
    """``(group, measure, description)`` of the groups' measures."""
    for flag in (sort_by_group, sort_by_mtf):
        if not isinstance(flag, bool):
            raise TypeError("the sorting flags are booleans")
    chosen = check_groups(groups)
    rows = [(m.group, m.name, m.about) for m in MEASURES.values() if m.group in chosen]
    if sort_by_mtf:
        rows.sort(key=lambda r: r[1])
    if sort_by_group:
        rows.sort(key=lambda r: r[0])
    return rows


def parse_by_group(groups, names: Iterable[str]) -> list[str]:
    """Those of extracted names that belong to the groups."""
    own = set(valid_metafeatures(groups))
    return [x for x in names if x.split(".", 1)[0] in own]


def as_frame(spark, values) -> DataFrame:
    """A measure's result as ``key, value``."""
    if isinstance(values, DataFrame):
        return values
    rows = values if isinstance(values, list) else [("", values)]
    return spark.createDataFrame([(str(k), None if v is None else float(v)) for k, v in rows], VALUES)


#: What the measures of a group share.
SHARED = {
    "general": lambda data: data.distinct,
    "statistical": lambda data: (data.moments, data.gram if data.target else None),
    "info-theory": lambda data: data.counts,
    "itemset": lambda data: data.counts,
    "model-based": nodes,
    "landmarking": lambda data: data.moments,
    "clustering": lambda data: shared_statistics(data, "euclidean", part="sums"),
    "concept": lambda data: shared_statistics(data, "euclidean", scaled=True, alphas=ALPHAS, part="weights"),
    "complexity": lambda data: shared_statistics(data, "gower", 2, scaled=True),
}
#: Groups whose shared part needs no target.
UNSUPERVISED = ("general", "statistical", "info-theory", "itemset", "concept")
#: How times are given.
TIMES = ("avg", "avg_summ", "total", "total_summ")


def check_out_type(out_type) -> None:
    import pandas as pd

    if out_type not in (DataFrame, tuple, dict, pd.DataFrame):
        raise TypeError("out_type is Spark's or pandas' DataFrame, tuple or dict")


def formatted(found: DataFrame, out_type):
    """The rows of an extraction in the form asked for."""
    if out_type is DataFrame:
        return found
    rows = found.collect()  # a row for each value
    lists = {c: [r[c] for r in rows] for c in found.columns}
    if out_type is dict:
        return lists
    if out_type is tuple:
        return tuple(lists.values())
    import pandas as pd

    wide = [c for c in found.columns if c not in ("name", "confidence")]
    return pd.DataFrame([lists[c] for c in wide], columns=lists["name"], index=wide if len(wide) > 1 else None)


class Extractor:
    """See the module. ``features`` and ``groups`` are ``"all"``, a name or names;
    an empty ``summary`` gives the values themselves. ``hypparam_model_dt`` are options of
    the model-based group's tree. ``measure_time`` (True is ``total``) adds seconds: of the
    measure's own jobs (``total``), also over its values (``avg``), and either with the
    measure's share of the summaries' job (``total_summ``, ``avg_summ``)."""

    def __init__(
        self,
        groups="default",
        features="all",
        summary=S.DEFAULT_SUMMARIES,
        score: str = "accuracy",
        num_cv_folds: int = 10,
        shuffle_cv_folds: bool = False,
        lm_sample_frac: float = 1.0,
        measure_time: bool | str | None = False,
        random_state: int | None = None,
        suppress_warnings: bool = False,
        hypparam_model_dt: dict | None = None,
    ) -> None:
        self.groups = check_groups(groups)
        self.asked = {groups} if isinstance(groups, str) else set(groups)
        self.summary = S.check(summary)
        names = [features] if isinstance(features, str) else list(features or ())
        known = {m.name for (g, _), m in MEASURES.items() if g in self.groups}
        if unknown := [x for x in names if x not in known and x != "all"]:
            if not suppress_warnings:
                warnings.warn(f"unknown measures: {', '.join(unknown)}", UserWarning, stacklevel=2)
        self.measures: list[Measure] = sorted((m for (g, _), m in MEASURES.items() if g in self.groups and ("all" in names or m.name in names)), key=lambda m: (m.name, m.group))
        if score not in (*SCORES, "kappa", "auc"):
            raise ValueError(f"unknown score {score!r}")
        if score not in SCORES:
            score_table({("", ""): 1}, score)
        if not isinstance(num_cv_folds, int) or num_cv_folds < 2:
            raise ValueError("num_cv_folds is a whole number from 2")
        if not 0.5 <= lm_sample_frac <= 1:
            raise ValueError("lm_sample_frac is from 0.5 to 1")
        if random_state is not None and not isinstance(random_state, int):
            raise ValueError("random_state is a whole number or None")
        self.folds = {"score": score, "num_cv_folds": num_cv_folds, "shuffle_cv_folds": shuffle_cv_folds, "lm_sample_frac": lm_sample_frac}
        self.measure_time = {True: "total", False: None}.get(measure_time, measure_time) if isinstance(measure_time, bool) else measure_time or None
        if self.measure_time not in (None, *TIMES):
            raise ValueError(f"unknown time {measure_time!r}; known: {', '.join(TIMES)}")
        if unknown := set(hypparam_model_dt or {}) - set(OPTIONS):
            raise ValueError(f"unknown options of the tree: {', '.join(sorted(unknown))}")
        self.tree = dict(hypparam_model_dt or {})
        self.random_state, self.quiet = random_state, suppress_warnings
        self.data: Data | None = None
        self.times: dict[str, float] = {}
        #: Seconds of the last fit's shared jobs, of the last extraction's own, and of both.
        self.time_precomp = self.time_extract = self.time_total = -1.0

    def fit(self, df: DataFrame, target: str | None = None, precomp_groups=None, **roles) -> Extractor:
        """Bind a dataset; ``roles`` as of :class:`~facetry.plans.data.Data`. What measures
        share is computed when the first one asks for it; ``precomp_groups`` (names, or
        ``"all"`` of the extractor's groups) computes that of some groups now."""
        self.data = Data(df, target, seed=self.random_state, **({"tree": self.tree} | roles))
        began = time.perf_counter()
        for g in check_groups(precomp_groups) if precomp_groups else ():
            if g in SHARED and g in self.groups and (target is not None or g in UNSUPERVISED):
                try:
                    SHARED[g](self.data)
                except FAILURES as failure:  # the measures meet it again
                    if not self.quiet:
                        warnings.warn(f"{g} can't be computed ahead: {failure!r}", RuntimeWarning, stacklevel=2)
        self.time_precomp = time.perf_counter() - began
        return self

    def values(self, m: Measure, arguments: dict | None = None):
        """What a measure gives; failures become no values, or NaN for numbers."""
        assert self.data is not None
        given = {k: v for k, v in self.folds.items() if k in m.hyper} | {k: v for k, v in (arguments or {}).items() if k in m.hyper}
        if not self.quiet and (extra := [k for k in arguments or {} if k not in m.hyper]):
            warnings.warn(f"{m.name} has no arguments {', '.join(extra)}", UserWarning, stacklevel=2)
        began = time.perf_counter()
        try:
            out = m.function(self.data, **given)
        except FAILURES as failure:
            if not self.quiet:
                warnings.warn(f"{m.name} failed: {failure!r}", RuntimeWarning, stacklevel=2)
            out = NAN if m.scalar else []
        self.times[m.name] = time.perf_counter() - began
        return out

    def extract(self, arguments: dict[str, dict] | None = None, out_type=DataFrame, verbose: int = 0):
        """``name, value``, sorted by name (and ``time``, if it is measured). ``arguments``
        are hyper-parameters by measure or summary. ``out_type`` is Spark's DataFrame,
        ``tuple`` (lists of names, values and times), ``dict`` (the same by ``name``,
        ``value`` and ``time``) or pandas' DataFrame (one row); ``verbose`` 1 prints how far
        the extraction is, 2 also each measure."""
        check_out_type(out_type)
        began = time.perf_counter()
        found = formatted(self._extracted(arguments, verbose), out_type)
        self.time_extract = time.perf_counter() - began
        self.time_total = max(self.time_precomp, 0.0) + self.time_extract
        return found

    def _extracted(self, arguments: dict[str, dict] | None = None, verbose: int = 0) -> DataFrame:
        if self.data is None:
            raise TypeError("fit a dataset first")
        spark, arguments = self.data.spark, arguments or {}
        single, small, frames, names = [], [], [], []
        for done, m in enumerate(self.measures, 1):
            if m.supervised and self.data.target is None:
                continue
            if verbose >= 2:
                print(f"{m.group}.{m.name}: {m.about}", flush=True)
            if verbose >= 1:
                print(f"{100 * done // len(self.measures)} % ({done} of {len(self.measures)})", flush=True)
            found = self.values(m, arguments.get(m.name))
            if m.scalar:
                single.append((m.name, float(found)))
                continue
            names.append(m.name)
            if isinstance(found, DataFrame):
                frames.append(found.select(F.lit(m.name).alias("name"), "key", F.col("value").alias("v")))
            else:
                small += [(m.name, str(k), None if v is None else float(v)) for k, v in found]
        long = spark.createDataFrame(small, "name string, key string, v double")
        for f in frames:
            long = long.unionByName(f)
        scalars = spark.createDataFrame(single, "name string, value double")
        if self.summary:
            held = spark.createDataFrame([(x, None, None) for x in names], "name string, key string, v double")
            vectors = S.summarise(long.unionByName(held), self.summary, {k: v for k, v in arguments.items() if k in S.SUMMARIES})
        else:
            vectors = long.select(F.concat_ws(".", "name", "key").alias("name"), F.col("v").alias("value"))
        summing = 0.0
        if self.measure_time and self.measure_time.endswith("_summ"):
            began = time.perf_counter()
            vectors = settled(vectors)
            summing = (time.perf_counter() - began) / max(1, len(names))
        out = scalars.unionByName(vectors)
        if "relative" in self.groups:
            out = settled(out)
            own = {m.name for m in self.measures if m.group == "landmarking"}
            marks = out.filter(F.split("name", r"\.")[0].isin(list(own)))
            ranks = relative(marks)
            kept = out if "landmarking" in self.asked or self.asked & {"all", "default"} else out.join(marks.select("name"), "name", "left_anti")
            out = kept.unionByName(ranks)
        if self.measure_time:
            each = [(x, t + (summing if x in names else 0.0)) for x, t in self.times.items()]
            times = spark.createDataFrame(each, "m string, time double")
            out = out.withColumn("m", F.split("name", r"\.")[0])
            if self.measure_time.startswith("avg"):
                values = F.broadcast(out.groupBy("m").agg(F.count("*").alias("values")))  # a row for each measure
                out = out.join(values, "m")
                times = times.withColumnRenamed("time", "whole")
                out = out.join(F.broadcast(times), "m", "left").withColumn("time", F.col("whole") / F.col("values")).drop("whole", "values")
            else:
                out = out.join(F.broadcast(times), "m", "left")
            out = out.select("name", "value", "time")
        return out.orderBy("name")

    def extract_metafeature_names(self, supervised: bool = True) -> list[str]:
        """The names that ``extract`` would give, without running it (one-valued and
        ``histogram``/``quantiles`` summaries of their default sizes)."""
        wide = {"histogram": 10, "quantiles": 5}
        out = []
        for m in self.measures:
            if m.supervised and not supervised:
                continue
            if m.scalar or not self.summary:
                out.append(m.name)
                continue
            for s in self.summary:
                k = wide.get(s.removeprefix("nan"), 1)
                out += [f"{m.name}.{s}"] if k == 1 else [f"{m.name}.{s}.{i}" for i in range(k)]
        if "relative" in self.groups:
            marks = {m.name for m in self.measures if m.group == "landmarking"}
            out += [f"{x}.relative" for x in out if x.split(".")[0] in marks]
        return sorted(out)

    def extract_from_model(self, model, df: DataFrame | None = None, arguments: dict | None = None, out_type=DataFrame, verbose: int = 0):
        """The model-based measures of a fitted ``DecisionTreeClassificationModel``."""
        if "model-based" not in self.groups:
            raise ValueError("the group model-based is needed")
        if not hasattr(model, "toDebugString") or not hasattr(model, "numFeatures"):
            raise TypeError("a fitted decision tree is needed")
        tree: Nodes = nodes_of(model)
        base = df if df is not None else model_frame(model)
        inner = Extractor("model-based", [m.name for m in self.measures if m.group == "model-based"], self.summary, measure_time=self.measure_time, suppress_warnings=True)
        inner.data = _ModelData(base, tree)
        return inner.extract(arguments, out_type, verbose)

    def extract_with_confidence(self, sample_num: int = 128, confidence=0.95, arguments: dict | None = None, out_type=DataFrame, verbose: int = 0):
        """Measures with basic bootstrap intervals; see :mod:`facetry.plans.bootstrap`."""
        from facetry.plans.bootstrap import with_confidence

        check_out_type(out_type)
        return formatted(with_confidence(self, sample_num, confidence, arguments, verbose), out_type)


def model_frame(model) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([(0, 0.0)], "id long, x double")


class _ModelData(Data):
    """A dataset whose tree is given."""

    def __init__(self, df: DataFrame, tree: Nodes) -> None:
        super().__init__(df.limit(1), None, None, None)
        self.target = "_model"
        self.__dict__["classes"] = [(str(k), 0) for k in range(max(tree.predicted) + 1)]
        self.__dict__["n"] = tree.samples[0]
        self.__dict__["_tree"] = tree
