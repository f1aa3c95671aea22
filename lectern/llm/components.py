"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import discard, small, stored

#: Bytes that a row of a node and its least neighbour takes once it is broadcast.
WIDTH = 64


def _stars(links: DataFrame, large: bool, n: int) -> DataFrame:
    """The n links (a > b) with each node's links bent to the least node near it: from its larger ends, or its smaller ones."""
    if large:
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        bent = links.select(F.col("b").alias("a"), F.col("a").alias("far")).join(small(stored(least), n, WIDTH), "a")
        return bent.select(F.col("far").alias("a"), F.col("m").alias("b")).distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    bent = links.join(small(stored(least), n, WIDTH), "a")
    again = bent.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return again.union(bent.select("a", F.col("m").alias("b"))).distinct()


def _shape(links: DataFrame) -> tuple[int, bool]:
    """How many links (distinct, a > b) there are, and whether they are stars: every a has one link, and no b is an a."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    n, bad = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)"))).first()
    return n, bad == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b: long); stored.

    Links point either way, may repeat and may join a node to itself; null ends are left out. Each round is a
    few joins and aggregates that combine before they shuffle, and is written to shared storage; the number of
    rounds grows with the logarithm of a component's size, and links that are stars need none. No component is held
    by one task. No links: empty.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    known = links.where("a IS NOT NULL AND b IS NOT NULL")
    alone = known.where("a = b").select(F.col("a").alias("node"))
    now = stored(known.where("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    n, stars = _shape(now)
    while not stars:
        before = now
        half = stored(_stars(now, True, 2 * n))
        now = stored(_stars(half, False, n))
        discard(before)
        discard(half)
        n, stars = _shape(now)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    selves = now.select(F.col("b").alias("node")).union(alone).select("node", F.col("node").alias("component"))
    return stored(ends.union(selves).groupBy("node").agg(F.min("component").alias("component")))
