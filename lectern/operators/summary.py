"""Summaries of items at four depths, compact hits, and counts that audit a library and its graph."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.library import equals, top_passages

#: Tokens per word, for estimates.
TOKENS_PER_WORD = 1.3
#: What a comprehensive summary asks of an item.
QUESTIONS = {
    "topic": ("research", "question", "aim", "topic", "problem"), "method": ("method", "data", "sample", "design", "procedure"),
    "result": ("result", "finding", "effect", "show", "found"), "conclusion": ("conclusion", "limitation", "future", "implication", "discuss"),
}


def parsed_filter(given: Mapping[str, object] | str | None) -> Column:
    """A metadata filter from a mapping or its JSON text; anything else is refused."""
    if isinstance(given, str):
        given = json.loads(given)
    if given is not None and not isinstance(given, Mapping):
        raise ValueError("a filter is a mapping of columns to values")
    return equals(given or {})


def tokens_of(text: Column) -> Column:
    """Estimated tokens: words x TOKENS_PER_WORD."""
    return F.round(F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")) * TOKENS_PER_WORD).cast("long")


def quick(items: DataFrame, key: object) -> DataFrame:
    """Metadata of one item and the beginning of its text."""
    found = items.where(F.col("item_key") == key)
    return found.select("item_key", "item_type", "title", "author", "date", "publication", F.substring("body", 1, 1000).alias("abstract"), tokens_of(F.substring("body", 1, 1000)).alias("tokens"))


def targeted(chunks: DataFrame, key: object, question: str, n: int = 5) -> DataFrame:
    """The n chunks of one item that share most words with a question."""
    own = chunks.where(F.col("item_key") == key)
    words = sorted({w for w in question.lower().split() if len(w) > 2})
    asked = chunks.sparkSession.createDataFrame([(question, words)], "question string, words array<string>")
    return top_passages(own, asked, n).join(own, ["item_key", "chunk_id"])


def comprehensive(chunks: DataFrame, key: object, n: int = 3) -> DataFrame:
    """n chunks of one item for each of the fixed questions."""
    own = chunks.where(F.col("item_key") == key)
    asked = chunks.sparkSession.createDataFrame([(q, list(w)) for q, w in QUESTIONS.items()], "question string, words array<string>")
    return top_passages(own, asked, n).join(own, ["item_key", "chunk_id"])


def full(items: DataFrame, key: object) -> DataFrame:
    return items.where(F.col("item_key") == key).select("item_key", "title", F.col("body").alias("text"), tokens_of(F.col("body")).alias("tokens"))


def compact(hits: DataFrame, columns: list[str]) -> DataFrame:
    """A JSON object per hit, in order of rank."""
    return hits.orderBy("rank").select(F.to_json(F.struct(*columns)).alias("value"))


def top_counts(rows: DataFrame, by: str, n: int) -> DataFrame:
    """by, n: the most frequent values, ties by value."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def grouped_children(children: DataFrame) -> DataFrame:
    """parent_key, item_type, n, keys: an item's children by type, all of their keys."""
    keys = F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys")
    return children.groupBy("parent_key", "item_type").agg(F.count(F.lit(1)).alias("n"), keys)


def migration_counts(papers: DataFrame, has_chunk: DataFrame, from_chunk: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n: papers, papers with chunks, chunk links, chunks with entities, links from papers to entities."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    linked = papers.join(has_chunk, "paper", "left_semi")
    rows = [one("papers", papers), one("papers with chunks", linked), one("chunk links", has_chunk), one("chunks with entities", from_chunk.select("chunk").distinct()), one("paper entity links", edges.where("rel <> 'CITES'"))]
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out


def audit(items: DataFrame, deleted: DataFrame, n: int = 10) -> DataFrame:
    """item_type, n of items that are not deleted; a null key counts as not deleted."""
    return top_counts(items.join(deleted.select("item_key"), "item_key", "left_anti"), "item_type", n)
