"""What is said of a list of hits: quality, duplicates, provenance, the item behind each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_quality(hits: DataFrame, score: str = "score") -> DataFrame:
    """One row: n, mean, low, high, deviation (sample; 0 for one), share of scores from 0.75 on, and confidence by the lowest."""
    found = hits.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"),
        F.round(F.coalesce(F.stddev_samp(score), F.lit(0.0)), 6).alias("deviation"), F.round(F.avg((F.col(score) >= 0.75).cast("double")), 6).alias("share_high"),
    )
    return found.withColumn("confidence", F.when(F.col("low") >= 0.65, "high").when(F.col("low") >= 0.45, "medium").otherwise("low"))


def coverage_quality(hits: DataFrame, score: str = "score") -> DataFrame:
    """One row: n, top, confidence by both, coverage (n of 10, at most 1) and whether to ask more backends."""
    found = hits.agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("top"))
    high, medium = (F.col("n") >= 10) & (F.col("top") >= 0.7), (F.col("n") >= 5) & (F.col("top") >= 0.6)
    found = found.withColumn("confidence", F.when(high, "high").when(medium, "medium").otherwise("low"))
    return found.withColumn("coverage", F.least(F.lit(1.0), F.col("n") / 10)).withColumn("escalate", F.col("confidence") == "low")


def weak_queries(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """The requests (query, ...) whose rows (query, score) have low confidence by coverage_quality()'s rule; those without a row have."""
    found = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    return requests.join(found.where((F.col("n") >= 5) & (F.col("top") >= 0.6)), "query", "left_anti")


def distinct_items(hits: DataFrame, item: str = "item_key", rank: str = "rank") -> DataFrame:
    """The best-ranked row of each item; rows without an item go."""
    order = Window.partitionBy(item).orderBy(rank)
    return hits.where(F.col(item).isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def distinct_texts(hits: DataFrame, text: str = "text", rank: list[str] | None = None) -> DataFrame:
    """The best-ranked row of each text, compared without outer blanks and case; blank texts go."""
    key = F.md5(F.lower(F.trim(F.col(text))))
    order = Window.partitionBy("__key").orderBy(*(rank or ["rank"]))
    rows = hits.where(F.length(F.trim(F.col(text))) > 0).withColumn("__key", key)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__key")


def provenance(lists: DataFrame) -> DataFrame:
    """id, backends (sorted), n_backends."""
    found = lists.groupBy("id").agg(F.array_sort(F.collect_set("list")).alias("names"))
    return found.select("id", F.array_join("names", ",").alias("backends"), F.size("names").cast("long").alias("n_backends"))


def enriched(hits: DataFrame, items: DataFrame, fallback: DataFrame | None = None, key: str = "item_key") -> DataFrame:
    """hits with their items' columns; where items has none, fallback's."""
    found = hits.join(items, key, "left")
    if fallback is None:
        return found
    other = fallback.select(key, *[F.col(c).alias(f"__{c}") for c in items.columns if c != key])
    joined = found.join(other, key, "left")
    return joined.select(*hits.columns, *[F.coalesce(c, f"__{c}").alias(c) for c in items.columns if c != key])
