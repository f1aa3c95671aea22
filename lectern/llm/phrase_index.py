"""Benchmark decontamination by a positional inverted index: lists of the rarest terms, intersected at their offsets."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import small, stored

#: Words are runs of digits, a-z and characters beyond ASCII, after A-Z are lowered.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and lists that are intersected for one.
WINDOW, LISTS = 10, 3
#: Words that an item's rarest terms lie within to be near.
NEAR = 20
#: Bytes of a term or of a row of numbers, for the size of a broadcast.
TERM_BYTES, ROW_BYTES = 48, 64


def words_of(text: Column) -> Column:
    """The words of a text, none of a null one."""
    whole = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lowered, GAPS), "")


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, n_words, words of each row; stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    return stored(rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words"))


def frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """term, freq: how often each of terms (distinct) occurs in all of tokens; stored. Terms that never do are left out."""
    held = tokens.select(F.explode("words").alias("term")).join(small(terms, terms.count(), TERM_BYTES), "term", "left_semi")
    return stored(held.groupBy("term").agg(F.count(F.lit(1)).alias("freq")))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, row, pos of every token, or of those of some terms (distinct); stored in shards of documents, each in order of term, so that nothing is shuffled and a scan skips what it is not asked for."""
    every = tokens.select("row", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        every = every.join(small(terms, terms.count(), TERM_BYTES), "term", "left_semi")
    return stored(every.select("term", "row", "pos").sortWithinPartitions("term", "row", "pos"))


@dataclass(frozen=True)
class Phrases:
    """items: phrase, ids, words of distinct word sequences; grams: windows (start, width) with their rarest terms t0, t1, ... at offsets o0, o1, ... from the first of these, which is word `at` of the phrase; near: phrase, term, n of the rarest terms of a phrase."""

    items: DataFrame
    grams: DataFrame
    near: DataFrame
    freq: DataFrame


def phrases(items: DataFrame, tokens: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, lists: int = LISTS) -> Phrases:
    """What to look for, rarest terms first. Items of equal words are one phrase; items without a word are none; windows with a term that tokens lack cannot occur and are left out."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    known = stored(rows.groupBy("words").agg(F.collect_set("id").alias("ids")).select(F.monotonically_increasing_id().alias("phrase"), "ids", "words"))
    places = known.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("pos", "term"))
    freq = frequencies(tokens, places.select("term").distinct())
    found = stored(places.join(freq, "term"))
    width = F.least("size", F.lit(window))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - width + 1), F.least(F.col("pos"), F.col("size") - width)))
    slots = found.select("phrase", width.alias("width"), starts.alias("start"), F.struct("freq", "pos", "term").alias("slot"))
    whole = slots.groupBy("phrase", "start", "width").agg(F.array_sort(F.collect_list("slot")).alias("slots")).where("size(slots) = width")
    # the rarest terms of a window; one with fewer words than lists repeats its last
    rare = [F.get("slots", F.least(F.lit(i), F.size("slots") - 1)) for i in range(lists)]
    keyed = whole.select("phrase", "start", "width", rare[0]["pos"].alias("at"), *[x for i, r in enumerate(rare) for x in (r["term"].alias(f"t{i}"), (r["pos"] - rare[0]["pos"]).alias(f"o{i}"))])
    grams = stored(keyed)
    rarest = Window.partitionBy("phrase").orderBy("freq", "term")
    near = found.select("phrase", "term", "freq").distinct().withColumn("n", F.row_number().over(rarest)).where(F.col("n") <= lists)
    return Phrases(known, grams, stored(near.select("phrase", "term", "n")), freq)


def candidates(index: DataFrame, grams: DataFrame, lists: int = LISTS) -> DataFrame:
    """row, phrase, start, width, first: where the rarest terms of a phrase's window (from its word `start`) stand at their distances in a row, whose word `first` would be the window's first.

    The list of the rarest term comes first; each further list is joined at its offset, so that only places both hold go on.
    """
    gram = [f"{x}{i}" for i in range(lists) for x in "to"]
    distinct, size = grams.select(*gram).distinct(), grams.count()
    at = index.join(small(distinct.withColumnRenamed("t0", "term"), size, lists * TERM_BYTES), "term").withColumnRenamed("term", "t0").withColumnRenamed("pos", "base")
    for i in range(1, lists):
        there = index.select(F.col("term").alias(f"t{i}"), "row", F.col("pos").alias("__at"))
        at = at.withColumn("__at", F.col("base") + F.col(f"o{i}")).join(there, [f"t{i}", "row", "__at"], "left_semi").drop("__at")
    held = at.join(small(grams, size, lists * TERM_BYTES + ROW_BYTES), gram)
    return held.select("row", "phrase", "start", "width", (F.col("base") - F.col("at") + F.col("start")).alias("first"))


def verified(found: DataFrame, tokens: DataFrame, items: DataFrame) -> DataFrame:
    """row, phrase, start, stop of the candidates whose words all equal their window's."""
    words = items.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    texts = items.select("phrase", F.col("words").alias("asked"))
    spots = stored(found.where("first >= 0"))
    rows = small(spots, spots.count(), ROW_BYTES).join(tokens.select("row", "words"), "row").join(small(texts, words, TERM_BYTES), "phrase")
    same = F.slice("words", F.col("first") + 1, F.col("width")) == F.slice("asked", F.col("start") + 1, F.col("width"))
    return rows.where(same).select("row", "phrase", F.col("first").alias("start"), (F.col("first") + F.col("width")).alias("stop"))


def nearby(index: DataFrame, near: DataFrame, within: int = NEAR) -> DataFrame:
    """row, phrase, span of rows where all of a phrase's rarest terms, two at least, stand within so many words: the fewest words that hold them."""
    sizes = near.groupBy("phrase").agg(F.max("n").alias("terms")).where("terms > 1")
    asked = near.join(sizes, "phrase")
    rows = index.join(small(asked, asked.count(), TERM_BYTES + ROW_BYTES), "term")
    upto = Window.partitionBy("row", "phrase").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda i: F.max(F.when(F.col("n") == i, F.col("pos"))).over(upto)
    behind = F.least(*[F.when(F.col("terms") >= i, F.coalesce(last(i), F.lit(-(1 << 40)))).otherwise(F.col("pos")) for i in range(1, LISTS + 1)])
    spans = rows.select("row", "phrase", (F.col("pos") - behind + 1).alias("span")).where(F.col("span") <= within)
    return spans.groupBy("row", "phrase").agg(F.min("span").alias("span"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of each row of docs, against items (item_id, text).

    n_hit: words inside an occurrence of `window` words in a row of an item (all of a shorter item). n_items: item ids
    with occurrences; their digest is of the ids as text, sorted, comma-joined. n_near: item ids whose LISTS rarest
    terms that docs hold stand within NEAR words somewhere, in any order.

    Terms are counted over all docs; lists are stored for the terms that some window or item is looked up by. Exact
    matches come from the lists' intersection, then a comparison of words. Each row has its own number, so that
    repeated ids and equal rows stay apart. Null texts and texts without a word have zeros; a null item id is an
    empty one; rows of items that repeat an id count as one item. Extra columns are left out.
    """
    tokens = tokenized(docs, id_col, text_col)
    asked = phrases(items, tokens, window=window)
    terms = asked.near.select("term")
    for i in range(LISTS):
        terms = terms.union(asked.grams.select(f"t{i}"))
    index = postings(tokens, terms.distinct())
    hits = stored(verified(candidates(index, asked.grams), tokens, asked.items))
    earlier = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0))))
    covered = hits.select("row", "start", "stop").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    ids = F.array_distinct(F.flatten(F.collect_set("ids")))
    size = asked.items.agg(F.sum(F.size("ids")).alias("n")).first().n or 0
    named = small(asked.items.select("phrase", "ids"), size, TERM_BYTES)
    exact = hits.select("row", "phrase").distinct().join(named, "phrase").groupBy("row").agg(ids.alias("ids"))
    close = nearby(index, asked.near).join(named, "phrase").groupBy("row").agg(F.size(ids).cast("long").alias("n_near"))
    rows = tokens.select("row", "doc_id", "n_words").join(covered, "row", "left").join(exact, "row", "left").join(close, "row", "left")
    found = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found), ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT coalesce(item_id::VARCHAR, '') AS id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT id, width, array_to_string(w[s + 1 : s + width], ' ') AS gram FROM (SELECT id, w, least(len(w), {WINDOW}) AS width, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM b WHERE len(w) > 0)),
o AS MATERIALIZED (SELECT r, s, g.id, g.width FROM (SELECT r, width, s, array_to_string(w[s + 1 : s + width], ' ') AS gram FROM (SELECT r, w, width, unnest(range(len(w) - width + 1)) AS s FROM d, (SELECT DISTINCT width FROM g) WHERE len(w) >= width)) x JOIN g USING (width, gram)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + width)) AS p FROM o) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT id)) AS ids FROM o GROUP BY r),
t AS MATERIALIZED (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
n AS MATERIALIZED (SELECT id, w, term, row_number() OVER (PARTITION BY id, w ORDER BY c, term) AS n, least(count(*) OVER (PARTITION BY id, w), {LISTS}) AS terms FROM (SELECT DISTINCT id, w, unnest(w) AS term FROM b) JOIN (SELECT term, count(*) AS c FROM t GROUP BY term) USING (term)),
e AS (SELECT r, id, w, n, terms, pos, max(CASE WHEN n = 1 THEN pos END) OVER q AS p1, max(CASE WHEN n = 2 THEN pos END) OVER q AS p2, max(CASE WHEN n = 3 THEN pos END) OVER q AS p3 FROM n JOIN t USING (term) WHERE n <= {LISTS} AND terms > 1 WINDOW q AS (PARTITION BY r, id, w ORDER BY pos)),
c AS (SELECT r, count(DISTINCT id) AS n FROM e WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND (terms = 2 OR p3 IS NOT NULL) AND pos - least(p1, p2, p3) < {NEAR} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated, coalesce(c.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN c USING (r)
"""
