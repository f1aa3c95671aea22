"""Incremental indexing: what is new, what a preprint duplicates, where a chunk belongs, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normal_key


def without_published_preprints(items: DataFrame, key: str = "item_key", kind: str = "item_type", published: str = "journalArticle", preprint: str = "preprint") -> DataFrame:
    """items without preprints that share a DOI or a title with a published item.

    DOIs and titles are compared in lower case without white space; blank ones match nothing. Each is an equi-join
    against the published items' distinct keys, so that a hot title is a row.
    """
    out = items
    for column in ("doi", "title"):
        form = F.nullif(normal_key(F.col(column)), F.lit(""))
        there = items.where(F.col(kind) == published).select(form.alias("__form")).where("__form IS NOT NULL").distinct()
        gone = items.where(F.col(kind) == preprint).select(key, form.alias("__form")).join(there, "__form").select(key).distinct()
        out = out.join(gone, key, "left_anti")
    return out


def new_rows(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key the index does not have."""
    return rows.join(index.select(key), key, "left_anti")


def with_text(rows: DataFrame, text: str, least: int = 1) -> DataFrame:
    return rows.where(F.length(F.trim(F.col(text))) >= least)


def last_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def merged(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """old with new's rows put in by key; of several new rows of a key the last in `order` stays."""
    new = last_rows(new, key, order) if order else new
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def resolved_parents(children: DataFrame, items: DataFrame, key: str = "key", parent: str = "parent_key") -> DataFrame:
    """key, parent: the parent if items has it, else the child's own key without its chunk suffix."""
    known = items.select(F.col("item_key").cast("string").alias("__item")).distinct()
    joined = children.join(known, F.col(parent).cast("string") == F.col("__item"), "left")
    return joined.select(key, F.coalesce("__item", F.substring_index(F.col(key), "-", 1)).alias("parent"), F.col("__item").isNotNull().alias("known"))


def changed_parents(payload: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """key, parent of the rows whose stored parent differs from the right one: the updates that a repair writes."""
    joined = payload.select(key, F.col("parent").alias("__was")).join(right.select(key, "parent"), key)
    return joined.where(~F.col("__was").eqNullSafe(F.col("parent"))).select(key, "parent")


def chunks_or_text(items: DataFrame, chunks: DataFrame, key: str = "item_key") -> DataFrame:
    """Rows to index: an item's chunks if it has any, else its text as chunk 0; blank ones go."""
    whole = items.join(chunks.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("chunk_id"), F.col("body").alias("chunk"))
    return with_text(chunks.select(key, F.col("chunk_id").cast("int").alias("chunk_id"), "chunk").unionByName(whole), "chunk")


def rebuilt_texts(chunks: DataFrame, key: str = "item_key", sep: str = "") -> DataFrame:
    """key, text: an item's chunks in order of their number. An item's own text is what one row has to hold."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "chunk")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), sep).alias("text"))


def kept_versions(versions: DataFrame, n: int, by: str = "created") -> DataFrame:
    """The last n versions, newest first: what a retention rule keeps."""
    return versions.orderBy(F.desc(by)).limit(n)


def valid_cache(cache: DataFrame, files: DataFrame, key: str = "item_key") -> DataFrame:
    """Cached rows whose MD5 is that of the file's present content."""
    return cache.join(files.select(key, F.md5("content").alias("__md5")), key).where(F.col("pdf_md5") == F.col("__md5")).drop("__md5")


def cache_put(cache: DataFrame, rows: DataFrame, key: str = "item_key", made: str = "made") -> DataFrame:
    """cache with rows put in by key, the latest of a key's."""
    return merged(cache, rows, key, [made])


def cache_cleared(cache: DataFrame, before: Column, made: str = "made") -> DataFrame:
    """cache without rows made before a moment; rows of unknown age go too."""
    return cache.where(F.col(made) >= before)


def due(mode: str, last: str | None, now: str, days: int = 1) -> bool:
    """Whether an index update is due: never by hand, always at start, else by the days since the last one."""
    from datetime import datetime

    if mode in ("manual", "startup") or last is None:
        return mode != "manual"
    passed = (datetime.fromisoformat(now) - datetime.fromisoformat(last)).days
    return passed >= (1 if mode == "daily" else days)
