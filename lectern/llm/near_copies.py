"""Near copies of documents: SimHash fingerprints in blocks, shingle keys for pairs that differ in more bits, links by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import simhash
from lectern.llm.line_dedup import FEW, SIMILARITY, WIDTH, sharing, similar_groups, with_copies, with_row_hashes
from lectern.llm.scratch import discard, joined, stored

#: Words of a shingle.
WORDS, SEED = 5, 42
#: Bands of WIDTH minima of sets of more than FEW shingles: pairs at SIMILARITY share one with 1 - (1 - s^5)^24, 0.9999.
BANDS = 24
ANCHORS = np.array([-(1 << 63) + i * ((1 << 64) // BANDS) for i in range(BANDS)], np.int64)


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words of UTF-8 bytes, words as in simhash(); fewer words are one run."""
    found = data.lower().split()
    runs = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs)).view(np.int64))


def keys(held: np.ndarray) -> list[int]:
    """Longs of which two sets of SIMILARITY share one: prefixes of small sets, bands of larger ones; see line_dedup.with_bands()."""
    n, made = len(held), []
    if n <= int(FEW / SIMILARITY):
        made += held[: n - int(np.ceil(round(n * SIMILARITY, 6))) + 1].tolist() if n else []
    if n > FEW:
        rows = held[(np.searchsorted(held, ANCHORS)[:, None] + np.arange(WIDTH)) % n]
        made += [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]
    return made


def fingerprint(held: np.ndarray) -> int:
    """SimHash of a shingle_set(), as a long; 0 if it is empty."""
    fp = simhash.majority(simhash.bit_counts(held), len(held))
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprint_keys(prints: DataFrame) -> DataFrame:
    """line, key of lines (line, fp: longs) whose fingerprints others reach by steps of simhash.DISTANCE bits: one key a group."""
    distinct = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    roots = stored(simhash.rooted(distinct))
    several = roots.groupBy("root").agg(F.sum("n").alias("lines")).where("lines > 1").select("root")
    return joined(prints, stored(roots.join(several, "root", "left_semi")), ["fp"]).select("line", F.xxhash64("root", F.lit(-2)).alias("key"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, __r1, __r2 (see line_dedup.with_row_hashes()), component_id, first of each row: doc_id and row hashes of its group's first row.

    Rows link when the Jaccard similarity of their sets of five-word shingles is SIMILARITY or more; a group's first row
    is that of the least doc_id (rows without one come last), then of the least hashes. Equal sets
    collapse to one row before any are compared; empty and null texts are equal. Sets meet in the groups of their
    SimHash fingerprints (see simhash.rooted()), which hold all pairs of up to simhash.DISTANCE bits. At SIMILARITY fingerprints
    differ in some 10 bits, so sets meet by shingle keys too: pairs of up to FEW shingles on either side all, larger ones
    with the bands' probability. Each link is verified on whole sets; only sets that meet others are shuffled. Ids are whole numbers; an empty table gives an empty one.
    """
    whole = with_row_hashes(docs, id_col, text_col)
    rows = whole.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), "__r1", "__r2")

    def named(data: bytes) -> tuple[int, np.ndarray]:
        held = shingle_set(data)
        return xxhash.xxh64_intdigest(held.tobytes()) - (1 << 63), held

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [named(x.as_py()) for x in batch.column(1)]
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array([p for p, _ in made], pa.int64()), pa.array([fingerprint(h) for _, h in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([keys(h) for _, h in made], pa.list_(pa.int64()))], ["doc_id", "__r1", "__r2", "line", "fp", "keys"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [named(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int64()), pa.array([h for _, h in made], pa.list_(pa.int64()))], ["line", "norm"])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc_id", "__r1", "__r2", "line", "fp")], T.StructField("keys", longs)])
    seen = stored(rows.mapInArrow(find, schema))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__r1", "__r2")
    distinct = stored(seen.groupBy("line").agg(F.min(place).alias("least"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")))
    near = fingerprint_keys(distinct.select("line", "fp"))
    members = sharing(seen.select("line", F.explode("keys").alias("key")).union(near))
    wanted = stored(distinct.join(members.select("line").distinct(), "line", "left_semi").select("least.__r1", "least.__r2").distinct())
    texts = rows.join(wanted, ["__r1", "__r2"], "left_semi").select("text")
    sets = stored(texts.mapInArrow(again, T.StructType([T.StructField("line", T.LongType()), T.StructField("norm", longs)])).dropDuplicates(["line"]))
    groups = similar_groups(members, sets, lambda held: held)
    discard(sets)
    grouped = distinct.join(groups, distinct["line"] == groups["node"], "left").select("line", "least", "n", F.coalesce("component", "line").alias("group"))
    first = stored(grouped.groupBy("group").agg(F.min("least").alias("first")))
    of_line = grouped.join(first, "group").select("line", "n", F.col("first.doc_id").alias("component_id"), F.struct("first.__r1", "first.__r2").alias("first"))
    return joined(seen.select("doc_id", "__r1", "__r2", "line"), stored(of_line), ["line"]).drop("line", "n")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each group of near_copies(), with all its columns; of equal whole rows one."""
    found = near_copies(docs, id_col, text_col)
    kept = found.where((F.col("first.__r1") == F.col("__r1")) & (F.col("first.__r2") == F.col("__r2"))).select("__r1", "__r2").distinct()
    rows = with_copies(with_row_hashes(docs, id_col, text_col)).where(~F.col("__copy"))
    return rows.join(stored(kept), ["__r1", "__r2"], "left_semi").select(*docs.columns)
