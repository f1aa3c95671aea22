"""Walks and aggregates on a typed graph: relatedness, citation chains, collaboration, influence, trends.

Edges are rows of src and dst, one relation each. Each hop is a join; a bounded start
set keeps its side small enough for Spark to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import discard, stored

#: Hops that are one plan; further ones are stored, each before the next.
PLANNED_HOPS = 3


def examples(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """key, examples: the lowest `most` distinct values of each key, joined; Spark limits each key before it shuffles."""
    order = Window.partitionBy(key).orderBy(value)
    few = rows.select(key, value).distinct().withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= most)
    return few.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("examples"))


def related(edges: DataFrame, start: int, n: int) -> DataFrame:
    """id, shared, examples: other sources that share targets with start; most shared first."""
    own = edges.where(F.col("src") == start).select("dst")
    found = edges.join(own, "dst").where(F.col("src") != start).select(F.col("src").alias("id"), "dst")
    top = found.groupBy("id").agg(F.countDistinct("dst").alias("shared")).orderBy(F.desc("shared"), "id").limit(n)
    return top.join(examples(found.join(top.select("id"), "id"), "id", "dst", 5), "id")


def chain(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """id, hops: what can be reached over edges in either direction in at most `hops` steps, by the fewest."""
    both = edges.union(edges.select("dst", "src")).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "id long, hops int")
    edge = seen
    for hop in range(1, hops + 1):
        step = both.join(edge.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        edge = step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        edge = stored(edge) if hops > PLANNED_HOPS else edge
        seen = seen.union(edge)
    return seen.where("hops > 0")


def paths(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """id, hops, path of what can be reached over edges in either direction in at most `hops` steps: the nodes of a shortest path, start first.

    Breadth first: a node keeps the least of its neighbours one level nearer, and paths are put together backwards from
    these, a join per hop. Each level is stored before the next.
    """
    both = edges.union(edges.select("dst", "src")).distinct()
    level = edges.sparkSession.createDataFrame([(start, None, 0)], "id long, via long, hops int")
    seen = level
    for hop in range(1, hops + 1):
        step = both.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        level = stored(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(level)
    back = seen.select(F.col("id").alias("at"), F.col("via").alias("next"))
    rows = seen.where("hops > 0").select("id", "hops", F.array("id").alias("path"), F.col("via").alias("at"))
    for _ in range(hops):
        rows = rows.join(back, "at", "left").select("id", "hops", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")).alias("path"), F.col("next").alias("at"))
    return rows.select("id", "hops", "path")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their place from 1 in an order; ranges are sorted apart and numbered by the sizes of those before, so that no task has all rows."""
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))  # a row a range
    inside = Window.partitionBy("__part").orderBy(*order)
    return parts.join(F.broadcast(ahead), "__part").withColumn("place", F.col("__ahead") + F.row_number().over(inside)).drop("__part", "__ahead")


def titled(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found (id, hops, path) with year and titles, those of the path's nodes (id, title, year) in order; nodes without a title are named by id."""
    name = F.coalesce("title", F.concat(F.lit("paper "), "node"))
    steps = found.select("id", "hops", F.posexplode("path").alias("at", "node")).join(nodes.withColumnRenamed("id", "node"), "node", "left")
    order = F.array_sort(F.collect_list(F.struct("at", name.alias("title"))))
    whole = steps.groupBy("id", "hops").agg(F.transform(order, lambda x: x["title"]).alias("titles"), F.max(F.when(F.col("node") == F.col("id"), F.col("year"))).alias("year"))
    return found.join(whole, ["id", "hops"])


def neighbours(edges: DataFrame, start: int, hops: int, n: int) -> DataFrame:
    """id, hops, papers: targets that share a source with start (hop 1), with those (hop 2), ...; papers in common.

    edges go from papers to targets (concepts, people). papers counts the sources shared with the nearer targets.
    """
    edge = edges.sparkSession.createDataFrame([(start,)], "id long")
    seen, found = edge, None
    for hop in range(1, hops + 1):
        papers = edges.join(edge.select(F.col("id").alias("dst")), "dst").select("src").distinct()
        step = edges.join(papers, "src").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("papers"))
        step = step.join(seen, "id", "left_anti")
        step = stored(step) if hops > PLANNED_HOPS else step
        edge = step.select("id")
        seen = seen.union(edge)
        rows = step.select("id", F.lit(hop).alias("hops"), "papers")
        found = rows if found is None else found.union(rows)
    return found.orderBy("hops", F.desc("papers"), "id").limit(n)


def in_degree(edges: DataFrame, papers: DataFrame, n: int, drop_zero: bool = False) -> DataFrame:
    """paper, citations: most cited first."""
    cited = edges.groupBy(F.col("dst").alias("paper")).agg(F.count(F.lit(1)).alias("citations"))
    rows = papers.select("paper").join(cited, "paper", "inner" if drop_zero else "left")
    return rows.select("paper", F.coalesce("citations", F.lit(0)).alias("citations")).orderBy(F.desc("citations"), "paper").limit(n)


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, damping: float = 0.85, reverse: bool = False, cut: int = 5) -> DataFrame:
    """id, score after so many rounds: cited papers gain; reverse rewards citing ones.

    Every node starts with 1 / n and gets (1 - damping) / n a round; what nodes without edges hold is not dealt out. A
    round reads the scores once and shuffles what is sent, summed before, with a zero for every node; links, dealt by source,
    are shuffled once a plan. The state is written to shared storage every `cut` rounds, so that plans and lineage stay short.
    """
    links = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    ids = nodes.select("id")
    links = stored(links.join(degree, "src").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "degree"))
    n = max(1, ids.count())
    now, before = ids.select("id", F.lit(1 / n).alias("score")), None
    for i in range(1, rounds + 1):
        sent = links.join(now.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("score") / F.col("degree")).alias("got"))
        everyone = ids.select("id", F.lit(0.0).alias("got"))
        now = sent.unionByName(everyone).groupBy("id").agg(((1 - damping) / n + damping * F.sum("got")).alias("score"))
        if i % cut == 0 and i < rounds:
            now = stored(now)
            if before is not None:
                discard(before)
            before = now
    return now


def yearly(edges: DataFrame, papers: DataFrame, concept: int, first: int, last: int) -> DataFrame:
    """year, papers, examples of a concept in a span of years."""
    rows = edges.where(F.col("dst") == concept).join(papers, F.col("src") == F.col("paper")).where(F.col("year").between(first, last))
    return rows.groupBy("year").agg(F.countDistinct("paper").alias("papers")).join(examples(rows, "year", "paper", 3), "year")


def co_occurring(edges: DataFrame, papers: DataFrame, concept: int, first: int, last: int, n: int) -> DataFrame:
    """id, papers, first_year of other concepts in the concept's papers of a span of years."""
    own = edges.where(F.col("dst") == concept).join(papers, F.col("src") == F.col("paper")).where(F.col("year").between(first, last)).select("src", "year")
    rows = edges.where(F.col("dst") != concept).join(own, "src").groupBy(F.col("dst").alias("id"))
    return rows.agg(F.countDistinct("src").alias("papers"), F.min("year").alias("first_year")).orderBy(F.desc("papers"), "id").limit(n)


def trend(years: DataFrame) -> DataFrame:
    """One row: n_years, early, late, trend of yearly(): with 3 years or more, the later half over 1.5 or under 0.67 of the earlier."""
    order = Window.orderBy("year")
    numbered = years.select("papers", F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    half = F.floor(F.col("n") / 2)  # one row a year: few, in one task
    sums = numbered.agg(F.count(F.lit(1)).alias("n_years"), F.coalesce(F.sum(F.when(F.col("i") <= half, F.col("papers"))), F.lit(0)).alias("early"), F.coalesce(F.sum(F.when(F.col("i") > half, F.col("papers"))), F.lit(0)).alias("late"))
    grown = F.when(F.col("n_years") < 3, "insufficient").when(F.col("late") > 1.5 * F.col("early"), "increasing").when(F.col("late") < 0.67 * F.col("early"), "decreasing")
    return sums.withColumn("trend", grown.otherwise("stable"))


def venues(papers: DataFrame, n: int, field: str | None = None) -> DataFrame:
    """venue, papers, examples: venues with most papers, of one field if named."""
    rows = papers if field is None else papers.where(F.col("field") == field)
    top = rows.groupBy("venue").agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("papers"), "venue").limit(n)
    return top.join(examples(rows.join(F.broadcast(top.select("venue")), "venue"), "venue", "paper", 3), "venue")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: nodes by label, edges by relation."""
    a = nodes.groupBy("label").count().select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.col("count").alias("n"))
    b = edges.groupBy("rel").count().select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), F.col("count").alias("n"))
    return a.union(b)


def entities_of(chunks: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """chunk, n, entities: up to `most` entities of each chunk, by name; chunks without any stay."""
    order = Window.partitionBy("chunk").orderBy("entity")
    listed = mentions.select("chunk", "entity").distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    sums = listed.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entities"))
    return chunks.join(sums, "chunk", "left").select("chunk", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("entities", F.lit("")).alias("entities"))


def propagated(has_chunk: DataFrame, from_chunk: DataFrame, relations: dict[str, str]) -> DataFrame:
    """src, rel, dst: entities of a paper's chunks (chunk, entity, label) as the paper's own, by label's relation and as MENTIONS."""
    lifted = has_chunk.join(from_chunk, "chunk").select(F.col("paper").alias("src"), F.col("entity").alias("dst"), "label").distinct()
    typed = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    rel = F.explode(F.array_compact(F.array(F.lit("MENTIONS"), F.try_element_at(typed, F.col("label")))))
    return lifted.select("src", rel.alias("rel"), "dst").distinct()


def found_entities(nodes: DataFrame, query: str, labels: list[str] | None = None, n: int = 10) -> DataFrame:
    """Nodes whose name or description holds query, in any case; of some labels only, if named."""
    q = query.lower()
    rows = nodes.where(F.lower("name").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q))
    rows = rows.where(F.col("label").isin(labels)) if labels else rows
    return rows.orderBy("name", "node").limit(n)


def available(nodes: DataFrame) -> DataFrame:
    """One row: whether the graph has a node."""
    return nodes.limit(1).agg((F.count(F.lit(1)) > 0).alias("available"))


def without(papers: DataFrame, has_chunk: DataFrame) -> DataFrame:
    """Papers that have no chunk."""
    return papers.join(has_chunk, "paper", "left_anti")


def linked(papers: DataFrame, listed: DataFrame) -> DataFrame:
    """paper, chunk: one edge per chunk named in listed (paper, chunks array) whose paper exists."""
    rows = listed.select("paper", F.explode("chunks").alias("chunk")).dropDuplicates()
    return rows.join(papers.select("paper"), "paper", "left_semi")


def matched_chunks(stored_chunks: DataFrame, texts: DataFrame, short: int = 100, long: int = 200) -> DataFrame:
    """text_id, chunk: which stored chunk (chunk, paper, position, body) each text (text_id, paper, position, text) is.

    First equal texts; then the chunk of the same position that holds the text's first `short` characters; then, of
    the paper's chunks that hold its first `long`, the one with most words in common, over half of them.
    """
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    at = stored_chunks.withColumnRenamed("position", "__at")
    same = texts.join(at, (texts["paper"] == at["paper"]) & (F.md5(texts["text"]) == F.md5(at["body"]))).where("text = body")
    same = same.groupBy("text_id").agg(F.min("chunk").alias("chunk")).withColumn("tier", F.lit(1))
    left = texts.join(same, "text_id", "left_anti")
    there = left.join(at, (left["paper"] == at["paper"]) & (left["position"] == at["__at"])).where(F.col("body").contains(F.substring("text", 1, short)))
    there = there.groupBy("text_id").agg(F.min("chunk").alias("chunk")).withColumn("tier", F.lit(2))
    rest = left.join(there, "text_id", "left_anti").join(stored_chunks.select("paper", "chunk", "body"), "paper")
    share = F.size(F.array_intersect(words(F.col("text")), words(F.col("body")))) / F.greatest(F.size(words(F.col("text"))), F.lit(1))
    rest = rest.where(F.col("body").contains(F.substring("text", 1, long))).withColumn("share", share).where("share > 0.5")
    best = rest.groupBy("text_id").agg(F.min(F.struct(-F.col("share"), "chunk")).alias("b")).select("text_id", "b.chunk", F.lit(3).alias("tier"))
    return same.unionByName(there).unionByName(best)
