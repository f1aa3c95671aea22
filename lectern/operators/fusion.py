"""Ranked lists in one: reciprocal ranks, distribution-based scores, weighted sub-queries, graph boosts.

Lists are rows of list, id, score, rank; a score and a rank is all that a method uses.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion.
RRF_K = 60


def rrf(lists: DataFrame, n: int, k: int = RRF_K, list_weights: Mapping[str, float] | None = None, per_row: bool = False) -> DataFrame:
    """id, score, rank, found_in: the sum over lists of weight / (k + rank).

    An id counts once per list, by its best rank; with per_row every row of it counts. found_in names the lists,
    sorted. Scores are rounded to 6 places and ties go to the lower id.
    """
    rows = lists if per_row else lists.groupBy("list", "id").agg(F.min("rank").alias("rank"))
    weight = F.lit(1.0)
    for name, w in (list_weights or {}).items():
        weight = F.when(F.col("list") == name, w).otherwise(weight)
    sums = rows.groupBy("id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("found_in"))
    return _top(sums, n)


def dbsf(lists: DataFrame, n: int) -> DataFrame:
    """id, score, rank, found_in by distribution-based score fusion.

    As public vector-database documentation describes it: a list's scores are scaled so that its mean less three
    sample deviations is 0 and its mean plus three is 1, clipped, and summed by id; without spread each is 0.5.
    """
    one = lists.groupBy("list", "id").agg(F.max("score").alias("score"))
    over = Window.partitionBy("list")
    low = F.avg("score").over(over) - 3 * F.stddev_samp("score").over(over)
    span = 6 * F.stddev_samp("score").over(over)
    part = F.when(F.coalesce(span, F.lit(0.0)) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - low) / span)))
    sums = one.select("list", "id", part.alias("part")).groupBy("id")
    return _top(sums.agg(F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("found_in")), n)


def decomposed(lists: DataFrame, importance: DataFrame, n: int) -> DataFrame:
    """id, score, rank, best_list: sum over sub-queries (list, importance) of score x importance / rank, to 4 places."""
    joined = lists.join(F.broadcast(importance), "list").withColumn("part", F.col("score") * F.col("importance") / F.col("rank"))
    sums = joined.groupBy("id").agg(F.round(F.sum("part"), 4).alias("score"), F.max_by("list", F.struct("part", "list")).alias("best_list"))
    return _top(sums, n)


def decomposed_by_query(lists: DataFrame, n: int) -> DataFrame:
    """query, id, score, rank: decomposed() for lists of many requests (query, id, score, rank, importance)."""
    part = F.col("score") * F.col("importance") / F.col("rank")
    sums = lists.groupBy("query", "id").agg(F.round(F.sum(part), 4).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return sums.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def graph_boost(hits: DataFrame, related: DataFrame, weight: float = 0.7, most: int = 5) -> DataFrame:
    """id, score, rank: similarity x weight + min(related / 10, 0.3) x (1 - weight); related: id, n (at most `most` count)."""
    joined = hits.join(related, "id", "left")
    boost = F.least(F.least(F.coalesce("n", F.lit(0)), F.lit(most)) / 10, F.lit(0.3))
    scored = joined.groupBy("id").agg(F.max(F.round(F.col("score") * weight + boost * (1 - weight), 4)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def _top(sums: DataFrame, n: int) -> DataFrame:
    top = sums.orderBy(F.desc("score"), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
