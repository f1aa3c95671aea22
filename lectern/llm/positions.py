"""Gapless positions and running sums within a key, with no key in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: list[str], order: list[str], units: Column, size: str | None = None) -> DataFrame:
    """Add `position` (long, gapless from 0 within key) and, given size, `before` (its sum over earlier rows).

    A key's rows are dealt by a hash of the order columns to `units` parts (a positive integer column, constant
    within a key); parts follow each other, and rows within a part follow the order columns. So the order
    within a key is by part first: fixed by the rows alone, but not sorted. Each task sorts one part. Rows that
    tie in all order columns share a part and are numbered one after the other. Null keys form a key of their
    own. Extra columns are carried through; the names __part, __rows, __sum, __start, __ahead are taken.
    """
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*order), units).cast("int"))
    at = [*key, "__part"]
    sums = [F.count(F.lit(1)).alias("__rows")] + ([F.sum(size).alias("__sum")] if size else [])
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*at).agg(*sums).withColumn("__start", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    if size:
        parts = parts.withColumn("__ahead", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"__at_{i}") for i, c in enumerate(at)], "__start", *(["__ahead"] if size else []))
    same = [F.col(c).eqNullSafe(F.col(f"__at_{i}")) for i, c in enumerate(at)]
    found = dealt.join(parts, same, "left")
    inside = Window.partitionBy(*at).orderBy(*order)
    found = found.withColumn("position", F.col("__start") + F.row_number().over(inside) - 1)
    if size:
        upto = inside.rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.col("__ahead") + F.coalesce(F.sum(size).over(upto), F.lit(0)))
    return found.drop("__part", "__start", "__ahead", *[f"__at_{i}" for i in range(len(at))])
