"""Top-k per query, padding, merging and recall.

Results are long tables (query_id, rank, external_id, distance): rank counts from 1, ties go to
the lesser external_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.metrics import MAX_FLOAT32, NO_ID, Metric, as_metric

RESULT = ["query_id", "rank", "external_id", "distance"]


def top_k(scored: DataFrame, k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES) -> DataFrame:
    """The k nearest per query of (query_id, external_id, distance); Spark limits each partition before the shuffle."""
    d = F.col("distance").desc() if as_metric(metric).descending else F.col("distance").asc()
    w = Window.partitionBy("query_id").orderBy(d, F.col("external_id").asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*RESULT)


def merge_top_k(results: list[DataFrame], k: int, metric: Metric | int | str = Metric.SUM_OF_SQUARES, unique: bool = True) -> DataFrame:
    """The k nearest of several results together; with `unique` an id counts once per query, at its nearest."""
    both = reduce(DataFrame.unionByName, [r.select("query_id", "external_id", "distance") for r in results])
    if unique:
        nearest = F.max("distance") if as_metric(metric).descending else F.min("distance")
        both = both.groupBy("query_id", "external_id").agg(nearest.alias("distance"))
    return top_k(both, k, metric)


def pad_missing(result: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """Exactly k rows per query: ranks without a result have the greatest distance and the id that stands for none."""
    grid = query_ids.select("query_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    got = grid.join(result, ["query_id", "rank"], "left")
    return got.select("query_id", "rank", F.coalesce("external_id", F.lit(NO_ID)).alias("external_id"), F.coalesce("distance", F.lit(MAX_FLOAT32)).alias("distance"))


def trim(result: DataFrame, k: int | None = None) -> DataFrame:
    """result without padding, and without ranks beyond k."""
    r = result.where((F.col("external_id") != NO_ID) | (F.col("distance") < MAX_FLOAT32))
    return r if k is None else r.where(F.col("rank") <= k)


def counted(scored: DataFrame, name: str = "distances") -> tuple[DataFrame, Observation]:
    """(scored, observation): after an action on it, observation.get["evaluated"] is the number of distances that were computed."""
    o = Observation(name)
    return scored.observe(o, F.count(F.lit(1)).alias("evaluated")), o


def intersections(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hits): how many of the true neighbours the result has."""
    a = result.select("query_id", "external_id").distinct()
    b = truth.select("query_id", "external_id").distinct()
    hits = a.join(b, ["query_id", "external_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return b.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (hits, recall): the part of the k true neighbours of all queries that was found."""
    n = intersections(result, truth.where(F.col("rank") <= k))
    return n.agg(F.sum("hits").cast("long").alias("hits"), (F.sum("hits") / (F.count(F.lit(1)) * k)).alias("recall"))


def validate_top_k(result: DataFrame, truth: DataFrame) -> bool:
    """Whether every query has the same set of neighbours in both."""
    a, b = (x.select("query_id", "external_id").distinct() for x in (result, truth))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
