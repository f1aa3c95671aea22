"""The update driver: a stream of items into items, chunks, vectors and a graph, which change together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import models
from lectern.functions.text import slices
from lectern.operators import graph_store
from lectern.operators.indexing import last_rows
from lectern.operators.keyed_store import BUCKETS, Batch, KeyedStore
from lectern.session import ship
from lectern.storage import discard, passing, released, small

TABLES = {
    "items": ("item_key long, title string, body string, stamp long, digest string", ("item_key",)),
    "chunks": ("item_key long, chunk_id int, chunk string", ("item_key",)),
    "vectors": ("item_key long, chunk_id int, vector array<float>", ("item_key",)),
    **graph_store.TABLES,
}
TOLD = ("added", "updated", "skipped", "failed")
WIDTH = 2000
#: Of a key in a broadcast table.
KEY_BYTES = 32
RELATIONS = {"Concept": "DISCUSSES_CONCEPT", "Person": "AUTHORED_BY"}


class Updates:
    """A library under root that a stream of items (item_key, title, body, stamp) keeps up to date.

    Each micro-batch tells its items apart: failed (a body without text; what the library has of it stays), added, updated
    (other text than the library's), skipped. Only added and updated items are chunked, embedded and searched for
    entities. All tables and the counters of a batch become visible by one commit, the batch's number being its marker:
    a batch that fails half way changes nothing, one that is repeated is passed over. Of several rows of an item the
    last by stamp counts, rows without a key are left out. Texts are stored once while a batch runs, and dealt to buckets
    once for each table that holds them; what is told of the items is narrow. Nothing else stays when the batch ends.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, embed: Callable = models.embedded, extract: Callable = models.extracted_entities) -> None:
        self.store, self.embed, self.extract = KeyedStore(spark, root, TABLES, buckets), embed, extract

    def counters(self) -> dict[int, dict[str, int]]:
        """added, updated, skipped, failed of each batch so far."""
        return {int(n): told for n, told in self.store.version()["counters"].get("batches", {}).items()}

    def apply(self, rows: DataFrame, number: int | None = None) -> dict[str, int] | None:
        """One batch; its counters, or None if it was applied before."""
        ship(rows.sparkSession)
        batch = self.store.begin(number)
        if batch is None:
            return None
        with passing() as keep:
            return self._applied(rows, batch, keep)

    def _applied(self, rows: DataFrame, batch: Batch, keep: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        arrived = keep(rows.where("item_key IS NOT NULL").select("item_key", "title", "body", "stamp", F.md5(F.col("body").cast("binary")).alias("digest")))
        several = keep(arrived.groupBy("item_key").count().where("count > 1").select("item_key"))
        new, n = arrived, several.count()
        if n:
            again = small(several, n, KEY_BYTES)
            new = arrived.join(again, "item_key", "left_anti").unionByName(last_rows(arrived.join(again, "item_key", "left_semi"), "item_key", ["stamp", "body"]))
        known = self.store.read("items", batch.touched("items", new), batch.before).select("item_key", F.col("digest").alias("__was"))
        blank = (F.trim(F.coalesce("body", F.lit(""))) == "").alias("__blank")
        told = F.when(F.col("__blank"), "failed").when(F.col("__was").isNull(), "added").when(F.col("__was") != F.col("digest"), "updated").otherwise("skipped")
        judged = keep(new.select("item_key", "digest", blank).join(known, "item_key", "left").select("item_key", told.alias("told")))
        counts = {t: 0 for t in TOLD} | {r.told: r["count"] for r in judged.groupBy("told").count().collect()}
        passed = F.col("told").isin("added", "updated")
        taken = counts["added"] + counts["updated"]
        if taken <= counts["skipped"] + counts["failed"]:
            fresh = new.join(small(judged.where(passed).select("item_key"), taken, KEY_BYTES), "item_key", "left_semi")
        else:
            fresh = new.join(small(judged.where(~passed).select("item_key"), counts["skipped"] + counts["failed"], KEY_BYTES), "item_key", "left_anti")
        fresh = keep(fresh)
        discard(arrived)
        keys = keep(fresh.select("item_key"))
        chunks = fresh.select("item_key", F.posexplode(slices(F.col("body"), WIDTH)).alias("chunk_id", "chunk"))
        named = chunks.withColumn("name", F.concat_ws("-", "item_key", "chunk_id"))
        found = self.extract(named, "name", "chunk").join(named.select("name", "item_key"), "name")
        mentions = keep(found.select(F.col("item_key").alias("paper"), F.col("name").alias("chunk"), "entity", "label"))
        nodes, edges = graph_store.of_mentions(mentions, RELATIONS, F.lit(batch.number).cast("long"))
        papers = fresh.select(F.lit("Paper").alias("label"), F.col("item_key").cast("string").alias("key"), F.create_map(F.lit("title"), F.col("title"), F.lit("id"), F.col("item_key").cast("string")).alias("props"), F.lit(batch.number).cast("long").alias("stamp"))
        vectors = keep(chunks.select("item_key", "chunk_id", self.embed(F.col("chunk")).alias("vector")))
        for name, held in (("items", fresh), ("chunks", chunks), ("vectors", vectors)):
            released(self.store.spark)
            batch.replace(name, keys, held)
        released(self.store.spark)
        graph = graph_store.merged(batch, papers.unionByName(nodes), edges)
        batches = batch.before["counters"].get("batches", {})
        batch.commit(batches=batches | {str(batch.number): counts}, graph=graph)
        return counts

    def run(self, items: DataFrame, state: str) -> None:
        """Apply what has arrived, micro-batch by micro-batch, and return."""
        items.writeStream.foreachBatch(lambda rows, number: self.apply(rows, number) and None).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
