"""Tags, collections, children and inspection of a library, as pure functions of its tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import stored

#: Levels of a collection tree that are planned before they are stored.
STORED_LEVELS = 4


def equals(columns: Mapping[str, object]) -> Column:
    """All of the given equalities; a filter on stored columns that reaches the scan."""
    met = F.lit(True)
    for name, value in columns.items():
        met = met & (F.col({"itemType": "item_type"}.get(name, name)) == value)
    return met


def since(years_back: int, current_year: int, column: str = "year") -> Column:
    return F.col(column) >= current_year - years_back


def searched(items: DataFrame, query: str, fields: list[str], n: int) -> DataFrame:
    """Items whose fields together hold all words of query, in any case; lowest keys first."""
    text = F.lower(F.concat_ws(" ", *fields))
    met = F.lit(True)
    for word in query.lower().split():
        met = met & text.contains(word)
    return items.where(met).orderBy("item_key").limit(n)


def tag_counts(tags: DataFrame) -> DataFrame:
    """tag, items, letter: tags by name in lower case, with the items that have them."""
    sums = tags.groupBy("tag").agg(F.countDistinct("item_key").alias("items"))
    return sums.withColumn("letter", F.upper(F.substring("tag", 1, 1))).orderBy(F.lower("tag"), "tag")


def tagged(tags: DataFrame, expressions: list[str]) -> DataFrame:
    """item_key of the items that meet all expressions; 'a || b' needs one of them, '-a' none of a."""
    one = tags.select("item_key").distinct()
    for expression in expressions:
        parts = [p.strip() for p in expression.split("||")]
        has, lacks = [p for p in parts if not p.startswith("-")], [p[1:] for p in parts if p.startswith("-")]
        met = one.join(tags.where(F.col("tag").isin(has)).select("item_key"), "item_key", "left_semi") if has else None
        for tag in lacks:
            free = one.join(tags.where(F.col("tag") == tag).select("item_key"), "item_key", "left_anti")
            met = free if met is None else met.union(free).distinct()
        one = met
    return one


def collection_tree(collections: DataFrame) -> DataFrame:
    """key, path, level of collections (key, name, parent_key) to any depth; a missing parent makes a root.

    A level is a join with the one above; every STORED_LEVELS levels are written, and the last one that has rows ends
    the walk. Collections that no root reaches, which lie on a cycle or below one, are returned with a null path and level.
    """
    known = collections.select(F.col("key").alias("__key"))
    roots = collections.join(known, F.col("parent_key") == F.col("__key"), "left").where("__key IS NULL")
    found = level = roots.select("key", F.col("name").alias("path"), F.lit(0).alias("level"))
    depth = 0
    while True:
        for _ in range(STORED_LEVELS):
            depth += 1
            above = level.select(F.col("key").alias("parent_key"), F.col("path").alias("__path"))
            level = collections.join(above, "parent_key").select("key", F.concat_ws("/", "__path", "name").alias("path"), F.lit(depth).alias("level"))
            found = found.union(level)
        found = stored(found)
        level = found.where(F.col("level") == depth)
        if level.isEmpty():
            break
    lost = collections.join(found.select("key"), "key", "left_anti")
    return found.unionByName(lost.select("key", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("level")))


def collection_items(links: DataFrame, items: DataFrame, authors: DataFrame, collection: object, n: int | None = None) -> DataFrame:
    """item_key, title, authors, year of a collection's items (links: collection_key, item_key), by key; n at most if given.

    authors (item_key, author): the first three by name, then et al.
    """
    own = links.where(F.col("collection_key") == collection).select("item_key").distinct()
    names = F.array_sort(F.collect_set("author"))
    listed = authors.join(own, "item_key", "left_semi").groupBy("item_key").agg(names.alias("names"))
    few = F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(F.size("names") > 3, F.lit(" et al.")).otherwise(F.lit("")))
    found = items.join(own, "item_key", "left_semi").join(listed.select("item_key", few.alias("authors")), "item_key", "left")
    found = found.select("item_key", "title", F.coalesce("authors", F.lit("")).alias("authors"), F.substring("date", 1, 4).alias("year"))
    return found.orderBy("item_key").limit(n) if n is not None else found


def retagged(tags: DataFrame, chosen: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    """tags (item_key, tag) after removing and then adding tags of the chosen items (item_key), in any case."""
    low = F.lower("tag")
    kept = tags.join(tags.where(low.isin([t.lower() for t in remove])).join(chosen, "item_key", "left_semi"), ["item_key", "tag"], "left_anti")
    new = chosen.select("item_key").distinct().withColumn("tag", F.explode(F.array(*[F.lit(t) for t in add]).cast("array<string>")))
    has = kept.select("item_key", low.alias("__low")).distinct()
    return kept.unionByName(new.join(has, (new["item_key"] == has["item_key"]) & (F.lower(new["tag"]) == has["__low"]), "left_anti"))


def retag_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """action, tag, n: items to which a tag was added and from which it was removed."""
    one = lambda name, x, y: x.join(y, ["item_key", "tag"], "left_anti").groupBy("tag").agg(F.countDistinct("item_key").alias("n")).select(F.lit(name).alias("action"), "tag", "n")
    return one("added", after, before).unionByName(one("removed", before, after))


def chunks_of(chunks: DataFrame, key: object) -> DataFrame:
    """Chunks of one paper: those that carry its key as their own or as their parent's."""
    return chunks.where((F.col("item_key") == key) | (F.col("parent_item_key") == key))


def text_keys(chunks: DataFrame) -> DataFrame:
    """item_key of papers with full text, in order: the parents of chunks that have it."""
    return chunks.where("has_fulltext").select(F.coalesce("parent_item_key", "item_key").alias("item_key")).distinct().orderBy("item_key")


def index_status(vectors: DataFrame) -> DataFrame:
    """One row: n rows of an index, dims of its vectors (the least and the greatest number of values)."""
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least_dims"), F.max(F.size("vector")).alias("most_dims"))


def collection_match(collections: DataFrame, text: str) -> DataFrame:
    """The collection of this name in any case, else the first that holds the text."""
    score = F.when(F.lower("name") == text.lower(), 2).when(F.lower("name").contains(text.lower()), 1).otherwise(0)
    return collections.withColumn("__s", score).where("__s > 0").orderBy(F.desc("__s"), "key").limit(1).drop("__s")


def recent(items: DataFrame, limit: object, by: str = "date") -> DataFrame:
    """The newest items; the limit is cut to 1..100, anything but a number is 10."""
    n = min(100, max(1, int(limit))) if str(limit).lstrip("-").isdigit() else 10
    return items.where(F.col(by).isNotNull()).orderBy(F.desc(by), "item_key").limit(n)


def members_added(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new).distinct()


def members_removed(links: DataFrame, old: DataFrame) -> DataFrame:
    return links.join(old, links.columns, "left_anti")


def preferred(attachments: DataFrame, parent: str = "parent", kind: str = "content_type", key: str = "key") -> DataFrame:
    """One attachment per parent: a PDF before HTML before others, the lowest key of those."""
    order = F.when(F.col(kind) == "application/pdf", 0).when(F.col(kind) == "text/html", 1).otherwise(2)
    best = Window.partitionBy(parent).orderBy(order, key)
    return attachments.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def with_fallback(items: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """items and those of other whose key items does not have."""
    return items.unionByName(other.join(items.select(key), key, "left_anti"))


def types(items: DataFrame, n: int = 20) -> DataFrame:
    sums = items.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"))
    return sums.orderBy(F.desc("n"), "item_type").limit(n)


def text_coverage(items: DataFrame, least: int = 100) -> DataFrame:
    """item_type, n, with_text, share: items with a text of at least `least` characters."""
    has = F.when(F.length("body") >= least, 1).otherwise(0)
    sums = items.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"), F.sum(has).alias("with_text"))
    return sums.withColumn("share", F.round(F.col("with_text") / F.col("n"), 4))


def repeated_titles(items: DataFrame, n: int = 10) -> DataFrame:
    sums = items.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sums.orderBy(F.desc("n"), "title").limit(n)


def cache_statistics(cache: DataFrame, text: str, made: str) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.min(made).alias("first"), F.max(made).alias("last"))


def top_passages(chunks: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """question, item_key, chunk_id, rank: the n chunks that share most distinct words with each question's.

    questions (question, words array) is a stated set of few rows; its words are broadcast.
    """
    asked = F.broadcast(questions.select("question", F.explode("words").alias("word")))
    words = chunks.select("item_key", "chunk_id", F.explode(F.array_distinct(F.split(F.lower("chunk"), r"[^\p{L}\p{N}]+"))).alias("word"))
    score = words.join(asked, "word").groupBy("question", "item_key", "chunk_id").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "item_key", "chunk_id")
    return score.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
