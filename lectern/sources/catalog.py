"""The tables of a library: items, chunks, vectors, tags, children and the citation graph, read from Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import slices, stripped_html
from lectern.operators import lexical, lexical_index, vector_index
from lectern.storage import version


def source_of(fulltext: bool, local: bool) -> str:
    """Which source items come from: the local database if full text is wanted and it is at hand, else the paged API."""
    return "database" if fulltext and local else "api"


@dataclass(frozen=True)
class Catalog:
    """A folder of Parquet tables as a library: documents are items, orders papers, suppliers people, parts concepts."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def items(self) -> DataFrame:
        """item_key, item_type, title, publication, body, date, author: documents with the order of their number."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
        people = self.table("customer").select("c_custkey", F.col("c_name").alias("author"))
        docs = self.table("documents").select(
            F.col("doc_id").alias("item_key"), F.col("lang").alias("item_type"), F.substring_index("text", "\n", 1).alias("title"),
            F.col("source").alias("publication"), F.col("text").alias("body"),
        )
        dated = docs.join(orders, docs["item_key"] == orders["o_orderkey"], "left").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        return dated.select("item_key", "item_type", "title", "publication", "body", "date", "author")

    def chunks(self, width: int = 2000) -> DataFrame:
        """item_key, chunk_id, chunk: documents in slices of width characters."""
        return self.table("documents").select(F.col("doc_id").alias("item_key"), F.posexplode(slices(F.col("text"), width)).alias("chunk_id", "chunk"))

    def lexical_index(self, table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> lexical.Index:
        """Postings, lengths and vocabulary of a table, brought up to its present files."""
        return lexical_index.followed(self.spark, f"{self.path}/{table}.parquet", id_col, text_col)

    def vector_index(self) -> vector_index.VectorIndex:
        path = f"{self.path}/embeddings.parquet"
        return vector_index.indexed(self.vectors(), path, version(self.spark, path))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")

    def item_tags(self) -> DataFrame:
        """item_key, tag: language and source of a document, and its labels."""
        docs = self.table("documents").select(F.col("doc_id").alias("item_key"), F.explode(F.array("lang", "source")).alias("tag"))
        flags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("Good")).otherwise(F.lit("Poor")), F.when(F.col("toxic") == 1, F.lit("Toxic"))))
        labels = self.table("labels").select(F.col("doc_id").alias("item_key"), F.explode(flags).alias("tag"))
        return docs.unionByName(labels).where("tag IS NOT NULL")

    def children(self) -> DataFrame:
        """key, parent_key, item_type, body: the turns of a conversation as its notes."""
        turns = self.table("conversations")
        return turns.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").alias("parent_key"), F.col("role").alias("item_type"), F.col("text").alias("body"))

    def page_texts(self) -> DataFrame:
        return self.table("pages").select("page_id", stripped_html(F.col("html")).alias("text"))

    def papers(self) -> DataFrame:
        """paper, year, venue, field."""
        regions = (
            self.table("customer").join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("field"))
        )
        orders = self.table("orders").join(regions, F.col("o_custkey") == F.col("c_custkey"), "left")
        return orders.select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"), "field")

    def edges(self, rel: str) -> DataFrame:
        """src, dst of one relation: AUTHORED_BY, DISCUSSES_CONCEPT (paper to person, concept) or CITES (paper to paper)."""
        lines = self.table("lineitem")
        if rel == "AUTHORED_BY":
            return lines.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
        if rel == "DISCUSSES_CONCEPT":
            return lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
        if rel == "CITES":
            before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
            return self.table("orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(before).alias("dst")).where("dst IS NOT NULL")
        raise ValueError(f"no relation {rel}")
