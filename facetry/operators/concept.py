"""Concept measures: how classes vary around each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.pairwise import shared_statistics
from facetry.plans.data import Data
from facetry.plans.registry import measure


#: Default weights of distances, and the least room that is left.
ALPHAS = (2.0, 1.0, 1e-9)


def _rows(data: Data, metric: str, alpha: float = ALPHAS[0], beta: float = ALPHAS[1], least: float = ALPHAS[2]) -> DataFrame:
    stats = shared_statistics(data, metric, scaled=True, alphas=(alpha, beta, least), part="weights")
    other = F.col("c") != F.col("y")
    return stats.groupBy("i").agg(F.sum("w").alias("w"), F.sum("wd").alias("wd"), F.sum("e").alias("e"), F.sum(F.when(other, F.col("w")).otherwise(0.0)).alias("wo"), F.sum(F.when(other, F.col("e")).otherwise(0.0)).alias("eo"))


def _out(rows: DataFrame, value) -> DataFrame:
    return rows.select(F.col("i").cast("string").alias("key"), F.coalesce(value, F.lit(float("nan"))).alias("value"))


@measure("concept", supervised=True)
def conceptvar(data: Data, conceptvar_alpha: float = 2.0, concept_dist_metric: str = "euclidean", concept_minimum: float = 1e-9):
    """Weighted share of rows of other classes around each row."""
    return _out(_rows(data, concept_dist_metric, alpha=conceptvar_alpha, least=concept_minimum), F.try_divide("wo", "w"))


@measure("concept")
def wg_dist(data: Data, wg_dist_alpha: float = 2.0, concept_dist_metric: str = "euclidean", concept_minimum: float = 1e-9):
    """Weighted mean distance to all other rows."""
    return _out(_rows(data, concept_dist_metric, alpha=wg_dist_alpha, least=concept_minimum), F.try_divide("wd", "w"))


@measure("concept", supervised=True)
def impconceptvar(data: Data, impconceptvar_alpha: float = 1.0, concept_dist_metric: str = "euclidean"):
    """Rows of other classes around each row, halved per unit of distance."""
    return _out(_rows(data, concept_dist_metric, beta=impconceptvar_alpha), F.col("eo"))


@measure("concept")
def cohesiveness(data: Data, cohesiveness_alpha: float = 1.0, concept_dist_metric: str = "euclidean"):
    """Rows around each row, halved per unit of distance."""
    return _out(_rows(data, concept_dist_metric, beta=cohesiveness_alpha), F.col("e"))
