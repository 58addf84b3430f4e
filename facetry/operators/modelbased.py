"""Measures of a decision tree.

The tree is an exact one, grown by one Arrow task and not by the driver, from the
different rows with their numbers, ``MAX_EXACT_ROWS`` of them at most; more raise
``TooLarge``. Who wants a tree of more different rows asks
for it: ``kind="binned"`` among the dataset's ``tree`` options gives Spark's own, with 256
bins a column, at any size. Either becomes a small table of nodes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from facetry.functions.kernels import Tree
from facetry.plans.data import NAN, Data
from facetry.plans.registry import TooLarge, measure
from facetry.session import settled, ship

MAX_EXACT_ROWS = 1_000_000


@dataclass
class Nodes:
    """The nodes of a tree: split column (-1 for leaves), depth, rows, predicted class."""

    feature: list[int]
    depth: list[int]
    samples: list[int]
    predicted: list[int]
    importances: list[float]
    n_features: int

    @property
    def leaf_depths(self) -> list[int]:
        return [d for f, d in zip(self.feature, self.depth, strict=True) if f < 0]


#: Options of the tree: its kind and limits.
OPTIONS = ("kind", "max_depth", "min_samples_split", "min_samples_leaf", "min_impurity_decrease")


def nodes(data: Data) -> Nodes:
    """The tree of a dataset, fitted once, by the dataset's ``tree`` options."""
    if "_tree" not in data.__dict__:
        limits = {k: v for k, v in data.tree.items() if v is not None}
        if unknown := set(limits) - set(OPTIONS):
            raise ValueError(f"unknown options of the tree: {', '.join(sorted(unknown))}")
        kind = limits.pop("kind", "exact")
        if kind not in ("exact", "binned"):
            raise ValueError("a tree is exact or binned")
        data.__dict__["_tree"] = _exact(data, limits) if kind == "exact" else _binned(data, limits)
    return data.__dict__["_tree"]


def _exact(data: Data, limits: dict) -> Nodes:
    different = settled(data.matrix.groupBy("_y", "x").agg(F.count("*").alias("n")))
    if different.count() > MAX_EXACT_ROWS:
        raise TooLarge(f"an exact tree is grown by one task, of at most {MAX_EXACT_ROWS} different rows; ask for kind='binned'")
    ship(data.spark)
    names = {c: k for k, (c, _) in enumerate(data.classes)}

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        tree = Tree(x, np.array([names[y] for y in table.column("_y").to_pylist()]), len(names), **limits, weight=table.column("n").to_numpy())
        yield pa.RecordBatch.from_pydict({"feature": [tree.feature], "depth": [tree.depth], "samples": [tree.samples], "predicted": [[int(c.argmax()) for c in tree.counts]], "importances": [tree.importances().tolist()]})

    schema = "feature array<long>, depth array<long>, samples array<long>, predicted array<long>, importances array<double>"
    r = different.coalesce(1).mapInArrow(grow, schema).first()  # at most MAX_EXACT_ROWS rows
    return Nodes(*[list(v) for v in r], data.d)


def _binned(data: Data, limits: dict) -> Nodes:
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    names = F.create_map(*[z for k, (c, _) in enumerate(data.classes) for z in (F.lit(c), F.lit(float(k)))])
    rows = data.matrix.select(array_to_vector("x").alias("features"), F.element_at(names, F.col("_y")).alias("label"))
    if "min_samples_split" in limits:
        raise ValueError("a binned tree has no min_samples_split")
    learner = DecisionTreeClassifier(maxDepth=limits.get("max_depth", 30), maxBins=256, minInstancesPerNode=limits.get("min_samples_leaf", 1), minInfoGain=limits.get("min_impurity_decrease", 0.0), seed=data.seed or 0)
    return nodes_of(learner.fit(rows))


def nodes_of(model) -> Nodes:
    """The nodes of a fitted ``DecisionTreeClassificationModel``."""
    feature, depth, samples, predicted = [], [], [], []
    todo = [(model._java_obj.rootNode(), 0)]
    while todo:
        node, at = todo.pop()
        inner = node.getClass().getSimpleName() == "InternalNode"
        feature.append(node.split().featureIndex() if inner else -1)
        depth.append(at)
        samples.append(int(node.impurityStats().count()))
        predicted.append(int(node.prediction()))
        if inner:
            todo += [(node.rightChild(), at + 1), (node.leftChild(), at + 1)]
    return Nodes(feature, depth, samples, predicted, model.featureImportances.toArray().tolist(), model.numFeatures)


def _numbered(values) -> list[tuple[str, float]]:
    return [(str(k), float(v)) for k, v in enumerate(values)]


@measure("model-based", scalar=True, supervised=True)
def leaves(data: Data):
    """Number of leaves."""
    return len(nodes(data).leaf_depths)


@measure("model-based", supervised=True)
def tree_depth(data: Data):
    """Depth of every node."""
    return _numbered(nodes(data).depth)


@measure("model-based", supervised=True)
def leaves_branch(data: Data):
    """Depth of each leaf."""
    return _numbered(nodes(data).leaf_depths)


@measure("model-based", supervised=True)
def leaves_corrob(data: Data):
    """Share of rows in each leaf."""
    t = nodes(data)
    return _numbered(n / t.samples[0] for f, n in zip(t.feature, t.samples, strict=True) if f < 0)


@measure("model-based", supervised=True)
def tree_shape(data: Data):
    """Entropy term of reaching each leaf."""
    return _numbered(d * 2.0**-d for d in nodes(data).leaf_depths)


@measure("model-based", supervised=True)
def leaves_homo(data: Data):
    """Leaves over the shape of each leaf."""
    depths = nodes(data).leaf_depths
    return _numbered(len(depths) / (d * 2.0**-d) if d else math.inf for d in depths)


@measure("model-based", supervised=True)
def leaves_per_class(data: Data):
    """Share of leaves of each predicted class."""
    t = nodes(data)
    own = Counter(p for f, p in zip(t.feature, t.predicted, strict=True) if f < 0)
    return [(data.classes[c][0] if data.target else str(c), n / len(t.leaf_depths)) for c, n in sorted(own.items())]


@measure("model-based", "nodes", scalar=True, supervised=True)
def nodes_(data: Data):
    """Number of nodes that split."""
    return sum(f >= 0 for f in nodes(data).feature)


@measure("model-based", scalar=True, supervised=True)
def nodes_per_attr(data: Data):
    """Splitting nodes per column."""
    return nodes_(data) / nodes(data).n_features


@measure("model-based", scalar=True, supervised=True)
def nodes_per_inst(data: Data):
    """Splitting nodes per row."""
    return nodes_(data) / nodes(data).samples[0]


@measure("model-based", supervised=True)
def nodes_per_level(data: Data):
    """Splitting nodes of each level."""
    t = nodes(data)
    own = Counter(d for f, d in zip(t.feature, t.depth, strict=True) if f >= 0)
    return [(str(k), float(n)) for k, n in sorted(own.items())]


@measure("model-based", supervised=True)
def nodes_repeated(data: Data):
    """Splitting nodes of each column that splits."""
    own = Counter(f for f in nodes(data).feature if f >= 0)
    return [(str(k), float(n)) for k, n in sorted(own.items())]


@measure("model-based", supervised=True)
def var_importance(data: Data):
    """Share of each column in the fall of impurity."""
    return _numbered(nodes(data).importances)


@measure("model-based", supervised=True)
def tree_imbalance(data: Data):
    """Entropy term of the leaves of each depth."""
    out = []
    for d, n in sorted(Counter(nodes(data).leaf_depths).items(), reverse=True):
        p = 2.0 ** (-(2.0**-d) * n)
        out.append((str(d), -p * math.log2(p) if p else NAN))
    return out
