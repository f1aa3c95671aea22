"""Hierarchical packing: documents go to window tiers, each tier is packed, and shorter ones fill its gaps."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.tokens import WORD_BPE, word_tokens

#: Window lengths, powers of two: a full window of any tier needs no padding.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens packed together in a task.
GROUP_TOKENS = 1 << 20
#: Tokens of a step group: 64 of the longest windows or as many tokens of shorter ones.
STEP_TOKENS = 64 * TIERS[-1]
#: Share of a tier's tokens that may fill gaps of longer tiers; the rest makes windows of its own.
LENT = 0.5

Piece = tuple[int, int, int]  # length, document, start


def windows(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier, pieces in order) of full windows, and the pieces left over; if last, these make one short window.

    Whole longest windows are cut off first; what is left of each document is routed to the shortest tier that
    holds it. Tiers are packed from the longest one. A window is opened by its tier's longest piece; its gap takes
    the longest piece of the tier that fits, then of the shorter tiers, the nearest first, as long as these have
    lent less than LENT of their tokens. A gap that nothing fits is closed by cutting a piece of the tier, the shortest
    one, whose rest is routed anew; with none left, the shorter tiers give without bound.
    """
    full, pools = [], [[] for _ in tiers]

    def route(piece: Piece) -> None:
        insort(pools[next(t for t, size in enumerate(tiers) if size >= piece[0])], piece)

    for length, doc, start in pieces:
        while length >= tiers[-1]:
            full.append((tiers[-1], [(tiers[-1], doc, start)]))
            length, start = length - tiers[-1], start + tiers[-1]
        if length:
            route((length, doc, start))
    lent = [int(LENT * sum(p[0] for p in pool)) for pool in pools]

    def fitting(own: int, gap: int, bound: bool) -> Piece | None:
        for t in range(own, -1, -1):
            at = bisect_right(pools[t], (gap, 1 << 62, 0))
            if at and (t == own or not bound or pools[t][at - 1][0] <= lent[t]):
                lent[t] -= pools[t][at - 1][0]
                return pools[t].pop(at - 1)
        return None

    def cut(own: int, gap: int) -> Piece | None:
        for pool in pools[own::-1]:
            if pool:
                length, doc, start = pool.pop(0)
                if length > gap:
                    route((length - gap, doc, start + gap))
                return min(length, gap), doc, start
        return None

    left: list[Piece] = []
    for own in range(len(tiers) - 1, -1, -1):
        while pools[own]:
            held, gap = [pools[own].pop()], tiers[own]
            gap -= held[0][0]
            while gap:
                piece = fitting(own, gap, True) or (cut(own, gap) if pools[own] else fitting(own, gap, False) or cut(own, gap))
                if piece is None:
                    break
                held.append(piece)
                gap -= piece[0]
            if gap:
                left = held
            else:
                full.append((tiers[own], held))
    if last:
        for size in [*tiers[::-1], 0]:
            while left and sum(p[0] for p in left) >= size:
                held, gap = [], size or tiers[-1]
                while gap and left:
                    length, doc, start = left.pop(0)
                    held.append((min(length, gap), doc, start))
                    if length > gap:
                        left.insert(0, (length - gap, doc, start + gap))
                    gap -= held[-1][0]
                full.append((size or tiers[-1], held))
    return full, left


def packed(
    docs: DataFrame, path: str = WORD_BPE, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_tokens: int = GROUP_TOKENS, in_order: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, tier_window (and ids).

    A document's ids are its whole text's, then END_ID; a null text is empty and has END_ID alone. Each id is in
    one piece. Windows are full but for one per input partition, of fewer ids than the shortest tier, which is to be
    padded to the longest one. Each partition packs its own documents, group_tokens at a time, and hands over what does
    not fill a window; so a task holds group_tokens and one document, nothing is shuffled, and a repeated task gives the
    same rows. sequence_id is the partition's number x 2^32 + the window's; tier_window numbers the windows of a tier
    in a partition. Repeated rows and null ids
    are documents of their own. in_order numbers a group's windows by their first document, so that sequences follow
    the rows, group by group; else the longest windows come first. Extra columns are left out; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = pa.int64()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "tier_window"] + ["ids"] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = word_tokens(path), TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # document: id, ids
        pieces: list[Piece] = []
        count, waiting, made = 0, 0, 0
        of_tier = dict.fromkeys(tiers, 0)
        kind = id_type

        def out(last: bool) -> pa.RecordBatch:
            nonlocal pieces, made, held, waiting
            full, pieces = windows(pieces, tiers, last)
            if in_order:
                full.sort(key=lambda w: min(doc for _, doc, _ in w[1]))
            rows: list[list] = [[] for _ in names]
            for tier, parts in full:
                offset = 0
                for length, doc, start in parts:
                    key, ids = held[doc]
                    part = ids[start : start + length]
                    values = [key, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + made, offset, tier, of_tier[tier]]
                    for column, value in zip(rows, values + [part.tolist()] * with_ids, strict=True):
                        column.append(value)
                    offset += length
                of_tier[tier] += 1
                made += 1
            held = {doc: held[doc] for _, doc, _ in pieces}
            waiting = sum(p[0] for p in pieces)
            kinds = [kind, *[pa.int64()] * 6, pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column(0).type
            for key, text_ids in zip(batch.column(0), tokens.of_texts(batch.column(1)), strict=True):
                ids = np.append(text_ids, np.uint16(END_ID))
                held[count] = key.as_py(), ids
                pieces.append((len(ids), count, 0))
                count, waiting = count + 1, waiting + len(ids)
                if waiting >= group_tokens:
                    yield out(False)
        if pieces:
            yield out(True)

    longs = [T.StructField(n, T.LongType()) for n in names[1:7]]
    schema = T.StructType([T.StructField("doc_id", rows.schema[0].dataType), *longs, T.StructField("tier", T.IntegerType()), T.StructField("tier_window", T.LongType())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(pack, schema)


def with_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """pieces (of packed(), stored) with step_id: which of its tier's step groups a window belongs to, from 0.

    A tier's windows, in the order of partitions and tier_window, are dealt to as many groups as hold step_tokens
    each, rounded up, so that the groups of a tier differ by one window at most, whichever partitions they come from.
    Only one row per partition and tier is summed up over partitions. An empty table gives an empty one.
    """
    part = F.shiftright("sequence_id", 32).alias("__part")
    counts = pieces.where("offset = 0").groupBy(part, F.col("tier").alias("__tier")).agg(F.count(F.lit(1)).alias("__n"))
    tier = Window.partitionBy("__tier")
    before = tier.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__all", F.sum("__n").over(tier))
    found = pieces.join(counts, (F.shiftright("sequence_id", 32) == F.col("__part")) & (F.col("tier") == F.col("__tier")))
    step = F.expr(f"((__ahead + tier_window) * ((__all * tier + {step_tokens - 1}) div {step_tokens})) div __all")
    return found.withColumn("step_id", step).drop("__part", "__tier", "__n", "__ahead", "__all")
