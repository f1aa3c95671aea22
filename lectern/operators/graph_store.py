"""A property graph in keyed tables: nodes and edges are merged by key, property by property, the last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.keyed_store import BUCKETS, Batch, KeyedStore
from lectern.storage import passing

PROPS = "props map<string, struct<stamp: bigint, value: string>>"
TABLES = {
    "nodes": (f"label string, key string, {PROPS}", ("label", "key")),
    "edges": (f"rel string, src string, dst string, {PROPS}", ("rel", "src", "dst")),
}


def plain(props: Column) -> Column:
    """Names to values, without the stamps."""
    return F.transform_values(props, lambda k, v: v["value"])


def _stamped(batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row a key: each property's last value in the batch (props: names to values; stamp); of equal stamps the greatest value. Null keys and values are left out."""
    rows = batch.select(*[F.col(k).cast("string").alias(k) for k in key], "props", "stamp").dropna(subset=list(key))
    entries = rows.select(*key, "stamp", F.explode_outer("props").alias("name", "value"))
    last = entries.groupBy(*key, "name").agg(F.max(F.when(F.col("value").isNotNull(), F.struct("stamp", "value"))).alias("last"))
    listed = F.filter(F.collect_list(F.struct("name", "last")), lambda e: e["name"].isNotNull() & e["last"].isNotNull())
    return last.groupBy(*key).agg(F.map_from_entries(listed).alias("props"))


def _merged(old: Column, new: Column) -> Column:
    return F.map_zip_with(old, new, lambda k, a, b: F.greatest(a, b))  # null is skipped, stamps come first


def _sorted(props: Column) -> Column:
    return F.array_sort(F.map_entries(props))


class GraphStore:
    """nodes (label, key, props) and edges (rel, src, dst, props) under root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.store = KeyedStore(spark, root, TABLES, buckets)

    def nodes(self) -> DataFrame:
        rows = self.store.read("nodes")
        return rows.select("label", "key", plain(F.col("props")).alias("props"))

    def edges(self) -> DataFrame:
        rows = self.store.read("edges")
        return rows.select("rel", "src", "dst", plain(F.col("props")).alias("props"))

    def merge(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> dict[str, int]:
        """Merge nodes (label, key, props, stamp) and edges (rel, src, dst, props, stamp); counts of created, updated and unchanged ones."""
        batch = self.store.begin()
        counts = merged(batch, nodes, edges)
        batch.commit(**counts)
        return counts


def merged(batch: Batch, nodes: DataFrame | None, edges: DataFrame | None) -> dict[str, int]:
    """GraphStore.merge() within a batch of a store that has TABLES. Only buckets with a change are written: to merge a batch again writes nothing."""
    counts = {}
    for name, rows in (("nodes", nodes), ("edges", edges)):
        if rows is None:
            continue
        key = list(TABLES[name][1])
        with passing() as keep:
            new = keep(_stamped(rows, TABLES[name][1]))
            old = batch.store.read(name, batch.touched(name, new), batch.before).withColumnRenamed("props", "__old")
            both = new.join(old, key, "left").withColumn("__now", F.when(F.col("__old").isNull(), F.col("props")).otherwise(_merged(F.col("__old"), F.col("props"))))
            told = F.when(F.col("__old").isNull(), "created").when(_sorted(F.col("__old")) == _sorted(F.col("__now")), "unchanged").otherwise("updated")
            found = keep(both.select(*key, F.col("__now").alias("props"), told.alias("told")))
            counts |= {f"{name}_{told}": 0 for told in ("created", "updated", "unchanged")} | {f"{name}_{r.told}": r["count"] for r in found.groupBy("told").count().collect()}
            batch.put(name, found.where("told <> 'unchanged'").drop("told"))
    return counts


def of_mentions(mentions: DataFrame, relations: dict[str, str], stamp: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to merge, of paper, chunk, entity, label rows: papers, chunks and entities; which chunk a paper has, what it mentions, and what the paper has by label's relation."""
    props = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v.cast("string"))])
    node = lambda label, key, p: F.struct(label.alias("label"), F.col(key).cast("string").alias("key"), p.alias("props"))
    nodes = F.array(node(F.lit("Paper"), "paper", props(id=F.col("paper"))), node(F.lit("Chunk"), "chunk", props(id=F.col("chunk"), paper=F.col("paper"))), node(F.col("label"), "entity", props(name=F.col("entity"))))
    edge = lambda rel, src, dst: F.struct(rel.alias("rel"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
    typed = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    edges = F.array(edge(F.lit("HAS_CHUNK"), "paper", "chunk"), edge(F.lit("MENTIONS"), "chunk", "entity"), edge(F.try_element_at(typed, F.col("label")), "paper", "entity"))
    rows = mentions.withColumn("__stamp", stamp)
    none = F.lit(None).cast("map<string, string>")
    made = rows.select(F.explode(nodes).alias("n"), "__stamp").select("n.*", F.col("__stamp").alias("stamp"))
    linked = rows.select(F.explode(edges).alias("e"), "__stamp").where("e.rel IS NOT NULL").select("e.*", none.alias("props"), F.col("__stamp").alias("stamp"))
    return made, linked
