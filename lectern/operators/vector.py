"""Nearest neighbours by cosine, over float and over 8-bit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def clamped(similarity: Column) -> Column:
    """At most 1; negative similarities stay."""
    return F.least(F.lit(1.0), similarity)


def nearest(vectors: DataFrame, query: DataFrame, n: int, where: Column | None = None, drop_self: bool = True, places: int = 6) -> DataFrame:
    """id, similarity, rank of the n rows of vectors (id, vector, ...) nearest to query's (id, vector), by query.

    The filter comes before the scoring. query is broadcast: a stated set of few rows. Ties go to the lower id.
    With one query the result is a global top n, with more a top n each, which Spark limits before it shuffles.
    """
    from pyspark.sql import Window

    rows = vectors if where is None else vectors.where(where)
    asked = F.broadcast(query.select(F.col("id").alias("query"), F.col("vector").alias("__q")))
    scored = rows.crossJoin(asked)
    if drop_self:
        scored = scored.where("id <> query")
    scored = scored.select("query", "id", F.round(clamped(cosine(F.col("vector"), F.col("__q"))), places).alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def quantized(vectors: DataFrame, quantile: float = 0.99) -> DataFrame:
    """vectors with codes, an array of bytes: values over the corpus's symmetric quantile bound, to -127..127."""
    values = vectors.select(F.explode("vector").alias("v"))
    bound = values.agg(F.percentile_approx(F.abs(F.col("v")), F.lit(quantile), F.lit(10_000)).alias("__bound"))
    code = lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / F.col("__bound"))) * 127).cast("tinyint")
    return vectors.crossJoin(F.broadcast(bound)).withColumn("codes", F.transform("vector", code)).drop("__bound")


def nearest_quantized(vectors: DataFrame, query_id: int, n: int, oversampling: int = 3) -> DataFrame:
    """nearest() for one stored row: 8-bit scores choose oversampling x n rows, float scores order them."""
    coded = quantized(vectors)
    one = F.broadcast(coded.where(F.col("id") == query_id).select(F.col("codes").alias("__q")))
    rough = coded.where(F.col("id") != query_id).crossJoin(one).withColumn("__s", dot(F.col("codes"), F.col("__q")) / F.sqrt(dot(F.col("codes"), F.col("codes"))))
    chosen = rough.orderBy(F.desc("__s"), "id").limit(oversampling * n).select("id", "vector")
    return nearest(chosen, vectors.where(F.col("id") == query_id), n)
