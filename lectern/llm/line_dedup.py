"""Fuzzy line deduplication: MinHash bands of character shingles, exact Jaccard, one line kept per component."""

from __future__ import annotations

from fractions import Fraction
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.scratch import joined, small, stored

#: Characters of a shingle, and the Jaccard similarity of two lines' shingle sets from which they are one.
SHINGLE, SIMILARITY = 7, 0.8
#: A line of more than FEW shingles has BANDS bands of WIDTH minima; one of fewer has a prefix, which misses no pair.
BANDS, WIDTH, FEW = 12, 5, 40
#: One row in so many tells which shingles are frequent; any order finds all pairs, this one fewer others.
SAMPLED = 16
#: Lines of a band that are compared in one row; larger bands are compared tile by tile.
TILE = 256


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def comparable(line: Column) -> Column:
    """What of a line counts: lower case, without blanks and tabs at its ends."""
    return F.lower(F.btrim(line, F.lit(" \t\x0b\x0c\r")))


def hashes(line: Column) -> Column:
    """Hashes of the line's runs of SHINGLE characters, in order; of the line itself if it is shorter.

    The line in UTF-32 has four bytes a character, so that a run is a slice of bytes at a known place.
    """
    coded = F.encode(line, "UTF-32")
    starts = lambda b: F.sequence(F.lit(1), F.octet_length(b) - (4 * SHINGLE - 1), F.lit(4))
    runs = _let(coded, lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substring(b, i, 4 * SHINGLE))))
    return F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(coded))).otherwise(runs)


def shingles(line: Column) -> Column:
    """The set that stands for a line."""
    return F.array_distinct(hashes(line))


def rarity(lines: DataFrame, line: str) -> bytes:
    """A level from 0 to 127 for each value of a shingle hash's upper 16 bits: how often the short ones of lines have it."""
    some = lines.where(F.length(line) < FEW / SIMILARITY + SHINGLE)
    found = some.select(F.explode(shingles(F.col(line))).alias("h")).groupBy(F.shiftrightunsigned("h", 48).cast("int").alias("at")).count()
    levels = bytearray(1 << 16)
    for at, n in found.collect():
        levels[at] = min(127, int(8 * log2(1 + n)))
    return bytes(levels)


def prefix_size(n: Column) -> Column:
    """How many of its n shingles, the first in an order common to all lines, a line has in its prefix.

    Similar lines share SIMILARITY of the larger one's shingles at least, so their prefixes share a shingle.
    """
    return (n - F.ceil(F.round(n * SIMILARITY, 6)) + 1).cast("int")


def with_bands(rows: DataFrame, line: str, levels: bytes) -> DataFrame:
    """rows with keys, longs of which similar lines share one: a prefix's shingles, or BANDS hashes of WIDTH shingles.

    Sets of at most FEW shingles have as keys their rarest ones by `levels` (see rarity()), enough for every similar
    pair to meet; so have sets of up to FEW / SIMILARITY, to which those may be similar. Larger sets have a
    key for each of BANDS evenly spaced anchors, the hash of the WIDTH shingle hashes after it.

    The shingle that follows an anchor in the circle of hash values is a set's minimum under one permutation, and
    the next ones its next minima. So two lines share a band with about the WIDTH-th power of their similarity,
    and one sorted array gives all bands. Sorted in among the hashes, anchor i has i anchors before it, which tells
    its place in the array without them. Arrays that are used often are columns of their own: they are computed once
    and searched by compiled code. Bands are named one by one, as a slice in a lambda would copy its whole array.
    """
    anchors = [F.lit(-(1 << 63) + i * ((1 << 64) // BANDS)).cast("long") for i in range(BANDS)]
    rows = rows.withColumn("__sorted", F.sort_array(shingles(F.col(line))))
    few, some = F.size("__sorted") <= FEW, F.size("__sorted") <= int(FEW / SIMILARITY)
    rows = rows.withColumn("__circle", F.when(~few, F.sort_array(F.concat("__sorted", F.array(*anchors)))))
    rows = rows.withColumn("__longer", F.when(~few, F.concat("__sorted", F.slice("__sorted", 1, WIDTH))))
    rows = rows.withColumn("__at", F.when(~few, F.array(*[F.array_position("__circle", a).cast("int") for a in anchors])))
    level = lambda h: F.ascii(F.substring(F.lit(levels), F.shiftrightunsigned(h, 48).cast("int") + 1, F.lit(1)).cast("string"))
    place = lambda h: F.shiftleft(level(h).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    rows = rows.withColumn("__first", F.when(some, F.slice(F.sort_array(F.transform("__sorted", place)), F.lit(1), prefix_size(F.size("__sorted")))))
    bands = F.array(*[F.xxhash64(F.slice("__longer", F.get("__at", F.lit(i)) - i, F.lit(WIDTH)), F.lit(i)) for i in range(BANDS)])
    prefix = F.transform("__first", lambda h: F.xxhash64(h, F.lit(-1)))
    keys = F.when(few, prefix).when(some, F.concat(prefix, bands)).otherwise(bands)
    return rows.withColumn("keys", keys).drop("__sorted", "__circle", "__longer", "__at", "__first")


def similar(a: Column, b: Column) -> Column:
    """Whether the Jaccard similarity of two arrays of distinct shingle hashes is SIMILARITY or more; sizes too unlike decide at once.

    n common ones of both sizes' sum are similar if n / (sum - n) >= p / q; in whole numbers n is named once, and no lambda holds it.
    """
    p, q = Fraction(str(SIMILARITY)).as_integer_ratio()
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b)).cast("long")
    return (q * least.cast("long") >= p * most.cast("long")) & ((p + q) * common >= p * (F.size(a) + F.size(b)).cast("long"))


def _forest(ms: Column, near) -> Column:
    """Links a, b among the lines ms of a row that join the pairs that near() verifies: a union-find in one expression.

    A line is compared with those before it whose group it has not met yet.
    """

    def step(roots: Column, i: Column) -> Column:
        meet = lambda met, j: F.when(~F.array_contains(met, F.get(roots, j)) & near(F.get(ms, j), F.get(ms, i)), F.array_append(met, F.get(roots, j))).otherwise(met)
        groups = F.aggregate(F.sequence(F.lit(0), i - 1), F.array(F.get(roots, i)), meet)
        return _let(groups, lambda g: _let(F.array_min(g), lambda least: F.transform(roots, lambda r: F.when(F.array_contains(g, r), least).otherwise(r))))

    n = F.size(ms)
    roots = F.aggregate(F.sequence(F.lit(1), n - 1), F.sequence(F.lit(0), n - 1), step)
    ends = _let(roots, lambda rs: F.transform(rs, lambda r, i: F.struct(F.get(ms, i)["line"].alias("a"), F.get(ms, r)["line"].alias("b"))))
    return F.filter(ends, lambda e: e["a"] != e["b"])


def _verified(rows: DataFrame, sets, across: Column | None = None) -> DataFrame:
    """Links of rows of key and ms (tile, line, group, norm, keys), sets(norm) being what is compared. A pair of different groups is verified in the
    first key it shares, so that equal lines under several keys cost once; where across, only if its lines are of two tiles."""

    def near(x: Column, y: Column) -> Column:
        first = F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")
        apart = (~across | (x["tile"] != y["tile"])) if across is not None else F.lit(True)
        return apart & (x["group"] != y["group"]) & first & similar(x["g"], y["g"])

    member = lambda m: F.struct(m["tile"].alias("tile"), m["line"].alias("line"), m["group"].alias("group"), sets(m["norm"]).alias("g"), m["keys"].alias("keys"))
    return rows.select(F.explode(_let(F.transform("ms", member), lambda ms: _forest(ms, near))).alias("e")).select("e.a", "e.b")


def _small_links(held: DataFrame, sets) -> DataFrame:
    """Links among the lines of keys of up to TILE lines; of keys with the same lines the least one is compared."""
    few = held.where(F.col("n") <= TILE)
    alike = few.groupBy("key").agg(F.xxhash64(F.sort_array(F.collect_list("line"))).alias("set")).groupBy("set").agg(F.min("key").alias("key"))
    rows = few.join(alike.select("key"), "key", "left_semi").groupBy("key")
    return _verified(rows.agg(F.collect_list(F.struct(F.lit(0).alias("tile"), "line", "group", "norm", "keys")).alias("ms")), sets)


def _tiled_links(held: DataFrame, sets) -> DataFrame:
    """Links among the lines of keys of more, dealt to tiles by hash, two tiles compared in one row."""
    many = held.where(F.col("n") > TILE).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    many = many.withColumn("tile", F.pmod(F.xxhash64("line"), F.col("tiles")).cast("int"))
    paired = many.select("key", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), F.struct("tile", "line", "group", "norm", "keys").alias("m"))
    rows = paired.groupBy("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    return _verified(rows.agg(F.collect_list("m").alias("ms")).where("size(ms) > 1"), sets, F.col("lo") != F.col("hi"))


def sharing(keyed: DataFrame) -> DataFrame:
    """key, least, line of keyed's (line, key) whose key several lines share, least being the least of them; stored."""
    shared = stored(keyed.groupBy("key").agg(F.min("line").alias("least"), F.max("line").alias("most")).where("least <> most").select("key", "least"))
    return stored(keyed.join(small(shared, shared.count(), 16), "key").select("key", "least", "line").distinct())


def _stars(members: DataFrame, texts: DataFrame, sets) -> DataFrame:
    """Links of lines that are similar to the least line of one of their keys: each such pair is compared once, whatever keys it shares."""
    pairs = members.where("line <> least").select(F.col("least").alias("a"), F.col("line").alias("b")).distinct()
    of = lambda end: texts.select(F.col("line").alias(end), F.col("norm").alias(f"norm_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    # sets are columns, so that compiled code makes and compares them; a filter would be moved below them and make them again
    both = both.select("a", "b", sets(F.col("norm_a")).alias("of_a"), sets(F.col("norm_b")).alias("of_b"))
    return both.select(F.explode(F.when(similar(F.col("of_a"), F.col("of_b")), F.array(F.struct("a", "b")))).alias("e")).select("e.a", "e.b")


def similar_groups(members: DataFrame, texts: DataFrame, sets=shingles) -> DataFrame:
    """node, component of the lines that similar pairs which share a key join; stored, lines without a similar one left out.

    members: sharing(); texts: line, norm of which sets(norm) is the array of distinct hashes that is compared.
    Each line is first compared with the least line of each of its keys, which settles most keys: all copies
    of a text meet in one star. Under a key whose lines are then of several groups, the lines other than the least
    one (whose pairs are known) are compared across groups, in tiles of TILE lines, so that no task holds a key.
    """
    links = stored(_stars(members, texts, sets))
    groups = components(links)
    grouped = members.join(groups.withColumnRenamed("node", "line"), "line", "left").withColumn("group", F.coalesce("component", "line"))
    grouped = stored(grouped.select("key", "least", "line", "group"))
    others = grouped.where("line <> least").groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("n"))
    undecided = stored(others.where("lo <> hi").select("key", "n"))
    left = undecided.count()
    if not left:
        return groups
    held = grouped.where("line <> least").join(small(undecided, left, 16), "key").select("key", "n", "line", "group")
    keys = held.groupBy("line").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    held = held.join(stored(keys.join(texts, "line")), "line")
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stored(stars.union(_small_links(held, sets)).union(_tiled_links(held, sets))))


def with_row_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __r1 and __r2, 128 bits that tell rows apart by id and whole text."""
    key = [F.col(id_col).cast("long"), F.col(text_col)]
    return docs.withColumn("__r1", F.xxhash64(*key)).withColumn("__r2", F.xxhash64(*key[::-1]))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__r1, __r2 (see with_row_hashes()), line_no (from 0) of every line that repeats an earlier one, exactly or by SIMILARITY; stored.

    Lines are split at \\n and compared as comparable(); blank ones are no lines. Equal lines, then lines linked by
    similarity, form groups (connected components); the first line of a group by doc_id, row hash and line_no stays and
    is not returned; rows without an id come last. Rows that repeat an id have lines of their own; equal whole rows
    have the same ones. Texts are never shuffled for candidates: keys of 64 bits are. Null texts have no lines.
    Hot lines are one row after the first aggregate, and no task holds a key's lines.
    """
    rows = with_row_hashes(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), "__r1", "__r2", F.col(text_col).alias("__text"))

    def lines_of(some: DataFrame) -> DataFrame:
        # lines become comparable inside the array: a column of their own would be computed again by the filter
        made = F.posexplode(F.transform(F.split("__text", "\n"), comparable)).alias("line_no", "norm")
        return some.select("doc_id", "__r1", "__r2", made).where("norm <> ''")

    lines, levels = lines_of(rows), rarity(lines_of(rows.where(F.pmod("__r1", F.lit(SAMPLED)) == 0)), "norm")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__r1", "__r2", "line_no").alias("place")
    seen = stored(with_bands(lines, "norm", levels).select(place, F.xxhash64("norm").alias("line"), F.xxhash64("norm", F.lit(1)).alias("check"), "keys"))
    distinct = stored(seen.groupBy("line", "check").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))

    members = sharing(seen.select("line", F.explode("keys").alias("key")))
    wanted = members.select("line").distinct()
    firsts = distinct.join(wanted, "line", "left_semi").dropDuplicates(["line"])
    places = stored(firsts.groupBy("first.__r1", "first.__r2").agg(F.collect_list(F.struct("line", "first.line_no")).alias("at")))
    found = rows.join(small(places, firsts.count(), 32), ["__r1", "__r2"])
    found = found.select(F.split("__text", "\n").alias("__lines"), F.explode("at").alias("at"))
    texts = stored(found.select("at.line", comparable(F.get("__lines", F.col("at.line_no"))).alias("norm")).dropDuplicates(["line"]))

    groups = similar_groups(members, texts)
    grouped = distinct.join(groups, distinct["line"] == groups["node"], "left").select("line", "check", "first", "n", "component")
    grouped = stored(grouped.where("component IS NOT NULL OR n > 1"))
    firsts = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("kept"))
    kept = grouped.join(stored(firsts), "component", "left").select("line", "check", "n", F.coalesce("kept", "first").alias("kept"))
    again = joined(seen.select("place", "line", "check"), stored(kept), ["line", "check"])
    return stored(again.where(F.col("place") != F.col("kept")).select("place.__r1", "place.__r2", "place.line_no").distinct())


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with __copy: whether an equal one (by __r1 and __r2) comes before; rows that have equals are stored to be told apart."""
    several = stored(rows.groupBy("__r1", "__r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__r1", "__r2"))
    n = several.count()
    if not n:
        return rows.withColumn("__copy", F.lit(False))
    several = small(several, n, 16)
    equal = stored(rows.join(several, ["__r1", "__r2"], "left_semi").withColumn("__at", F.monotonically_increasing_id()))
    first = stored(equal.groupBy("__r1", "__r2").agg(F.min("__at").alias("__at")).select("__at", F.lit(False).alias("__copy")))
    told = equal.join(first, "__at", "left").withColumn("__copy", F.coalesce("__copy", F.lit(True))).drop("__at")
    return rows.join(several, ["__r1", "__r2"], "left_anti").withColumn("__copy", F.lit(False)).unionByName(told)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated_lines() taken out of their texts, and n_lines, n_removed (long; 0 for null texts).

    All rows and columns stay; columns of docs named n_lines or n_removed are replaced. A text all of whose lines
    repeat others becomes empty; a null text stays null. Of rows with equal ids and texts one keeps its lines.
    """
    gone = repeated_lines(docs, id_col, text_col)
    removed = gone.groupBy("__r1", "__r2").agg(F.collect_list("line_no").alias("__gone"))
    found = with_copies(with_row_hashes(docs, id_col, text_col)).join(small(removed, gone.count(), 32), ["__r1", "__r2"], "left")
    lines = F.split(text_col, "\n")
    inked = F.when(F.col("__copy"), F.filter(F.transform(lines, lambda x, i: F.when(comparable(x) != "", i)), lambda i: i.isNotNull()))
    found = found.withColumn("__gone", F.when(F.size(inked) > 0, inked).otherwise(F.col("__gone")))

    def left(all_lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(at, lambda i: F.get(all_lines, i)), "\n")

    text = F.when(F.col("__gone").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(_let(lines, left))
    found = found.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    found = found.withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    return found.withColumn(text_col, text).drop("__gone", "__copy", "__r1", "__r2")
