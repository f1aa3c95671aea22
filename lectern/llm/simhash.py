"""SimHash near-duplicates: fingerprints in blocks by the pigeonhole principle, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import components
from lectern.llm.scratch import joined, stored

BITS, DISTANCE, WORDS, SEED = 64, 4, 4, 42
#: Shingles counted together.
CHUNK = 1 << 16
#: Fingerprints of a block compared in one piece of work: two tiles of at most about this size.
TILE = 256


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, least bit first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes with these bit_counts(): bit i is 1 if over half of them have it."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(data: bytes, words: int = WORDS) -> int:
    """The fingerprint of UTF-8 bytes: bit i is 1 if set in the XXH64 of over half the shingles, repeats included.

    A-Z become lower case; words are runs without ASCII white space; a text of fewer words is one shingle; one
    of none has fingerprint zero.
    """
    found = data.lower().split()
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(found) - words + 1)
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    digest, seed, total = xxhash.xxh64_intdigest, SEED, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], "<u8")
        total += bit_counts(hashes)
    return majority(total, n)


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row's whole text; a null text is an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(find, T.StructType([T.StructField("doc_id", rows.schema[0].dataType), T.StructField("fp", T.LongType())]))


def block_masks(rows: int, distance: int = DISTANCE) -> list[int]:
    """Masks of which two fingerprints within distance agree under one at least.

    The bits fall into distance + m blocks, of which differing bits spoil at most `distance`, so m stay whole:
    one mask per choice of m blocks. m is the least for which a mask has the bits to tell so many rows apart, so
    that chance meetings per fingerprint don't grow with the table.
    """
    m = 1
    while BITS * m // (distance + m) < log2(max(2, rows)) and m < 8:
        m += 1
    edges = [BITS * i // (distance + m) for i in range(distance + m + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m)]


def _forest(fps: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids that join all fingerprints within distance of each other, one fewer than each group has."""
    root = np.arange(len(fps))
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= distance)
        if len(near):
            joined = np.unique(root[near])
            least = min(joined[0], i)
            root[i] = least
            if len(joined) > 1:
                root[: i + 1][np.isin(root[: i + 1], joined)] = least
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return ids[moved], ids[root[moved]]


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links a, b between ids of a stored table (id, fp: distinct longs) whose groups are those of all pairs within distance.

    Rows are keyed by each mask of block_masks(); keys with two rows or more are compared. A key's rows are dealt
    to tiles by hash, and two tiles at a time are compared in one piece of work, so that neither a task nor the
    output grows with the square of a group: each piece yields a spanning forest of the pairs it verified.
    """
    masks = block_masks(distinct.count(), distance)
    signed = [m - (1 << BITS) if m >> 63 else m for m in masks]
    keyed = distinct.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "key"))
    shared = stored(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    held = keyed.join(shared, ["mask", "key"]).withColumn("__tiles", tiles).withColumn("__tile", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))
    paired = held.select("mask", "key", "id", "fp", "__tile", others.alias("__other"))
    work = paired.groupBy("mask", "key", F.least("__tile", "__other").alias("lo"), F.greatest("__tile", "__other").alias("hi"))
    work = work.agg(F.collect_list("id").alias("ids"), F.collect_list("fp").alias("fps")).where("size(ids) > 1").select("ids", "fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for ids, fps in zip(batch.column(0), batch.column(1), strict=True):
                pairs.append(_forest(fps.values.to_numpy().view(np.uint64), ids.values.to_numpy(), distance))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)], ["a", "b"])

    return work.mapInArrow(verify, "a long, b long")


def rooted(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """A stored table of distinct fingerprints fp (longs) with root: the least fingerprint reachable over pairs within distance."""
    groups = components(linked(distinct.select(F.col("fp").alias("id"), "fp"), distance))
    return distinct.join(groups, distinct["fp"] == groups["node"], "left").select(*distinct.columns, F.coalesce("component", "fp").alias("root"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row: the least doc_id reachable over links.

    Rows link when their fingerprints differ in at most `distance` bits, whatever their ids: fingerprints are the nodes,
    so a row with a null id links and bridges like others, and rows that share an id are rows of their own, which the id
    does not link. A component is named by the least id of its rows that is not null; one of null ids alone has a null name.
    Equal fingerprints collapse to one node before any are compared. The id column holds whole numbers. Empty and null
    texts share fingerprint zero and link like others. Extra columns are left out; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "fp"))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = stored(rooted(distinct, distance).withColumnRenamed("n", "rows"))
    least = stored(found.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = joined(found, least, ["root"]).select("fp", F.col("rows").alias("n"), "component_id")
    found = joined(prints, stored(named), ["fp"], "left")
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
