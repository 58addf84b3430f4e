"""Scores of predictions from their table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORES = ("accuracy", "balanced-accuracy", "f1")


def score_table(table: dict[tuple[str, str], int], score: str = "accuracy") -> float:
    """The score of ``{(true, predicted): rows}``."""
    total = sum(table.values())
    true: dict[str, int] = {}
    said: dict[str, int] = {}
    for (y, p), n in table.items():
        true[y] = true.get(y, 0) + n
        said[p] = said.get(p, 0) + n
    if score == "accuracy":
        return sum(n for (y, p), n in table.items() if y == p) / total
    if score == "balanced-accuracy":
        return sum(table.get((y, y), 0) / n for y, n in true.items()) / len(true)
    if score == "f1":  # weighted by the rows of each class
        return sum(n * 2 * table.get((y, y), 0) / (n + said.get(y, 0)) for y, n in true.items()) / total
    if score in ("kappa", "auc"):
        raise NotImplementedError(f"{score} is not available")
    raise ValueError(f"unknown score {score!r}")


def score_frame(df: DataFrame, truth: str, predicted: str, score: str = "accuracy") -> float:
    """The score of two columns."""
    rows = df.groupBy(F.col(truth).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n")).collect()
    return score_table({(r["y"], r["p"]): r["n"] for r in rows}, score)
