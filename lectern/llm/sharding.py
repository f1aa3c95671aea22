"""Shards of near-equal bytes: minimax partition of ordered, atomic groups into contiguous runs."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.positions import numbered
from lectern.llm.scratch import stored

#: Bits of a text's key, of the ranges that are summed first, and by which ranges near a cut are split again.
KEY_BITS, FIRST_BITS, MORE_BITS = 60, 16, 12
#: Rows sorted together when slots are numbered.
PART_ROWS = 2_048


def fits(ends: list[int], capacity: int, shards: int) -> bool:
    """Whether taking as much as fits, shard by shard, uses up all groups; ends: running sums of group sizes."""
    done = 0
    for _ in range(shards):
        at = bisect_right(ends, done + capacity)
        if at == len(ends):
            return True
        done = ends[at - 1] if at else 0
    return False


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which contiguous runs of sizes fit into so many shards, by binary search."""
    ends = list(accumulate(sizes))
    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if fits(ends, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Index of the first group of shards 1, 2, ...: no shard exceeds the smallest capacity, and each takes
    what comes closest to an even share of the rest. Fewer groups than shards leave shards empty."""
    n, capacity, ends = len(sizes), smallest_capacity(sizes, shards), [0, *accumulate(sizes)]
    reach = [bisect_right(ends, ends[i] + capacity) - 1 for i in range(n)]
    needs = [0] * (n + 1)
    for i in reversed(range(n)):
        needs[i] = 1 + needs[reach[i]]
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        if at < n:
            most = reach[at]
            even = ends[at] + (ends[n] - ends[at]) / (left + 1)
            end = min(most, max(at, bisect_right(ends, even) - 1))
            if end < most and abs(ends[end + 1] - even) < abs(ends[end] - even):
                end += 1
            while needs[end] > left:
                end += 1
            at = end
        cuts.append(at)
    return cuts


Range = tuple[int, int, int]  # least key, greatest key, size


def near_cuts(found: list[Range], shards: int) -> list[tuple[int, int]]:
    """Spans of keys whose ranges of several groups may hold a cut for the smallest capacity, whatever it is.

    The capacity is the even share at least and that of whole ranges at most. Between these two, the end of the k-th
    shard lies between what the lower one surely and the upper one possibly reaches.
    """
    ends, spans = list(accumulate(r[2] for r in found)), []
    low = high = 0
    least, most = -(-ends[-1] // shards), smallest_capacity([r[2] for r in found], shards)
    for _ in range(shards - 1):
        first, last = bisect_right(ends, low + least), bisect_right(ends, high + most)
        low, high = ends[first - 1] if first else 0, high + most
        held = [r for r in found[first : last + 1] if r[0] < r[1]]
        if held:
            spans.append((held[0][0], held[-1][1]))
        if first == len(ends):
            break
    return spans


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in one shard, equal texts together.

    size is the text's UTF-8 bytes plus 1; a null text counts as an empty one (size 1, CRC 0). Groups are equal
    texts, in order of KEY_BITS of their MD5. The largest shard is as small as this order allows: sizes of
    2^FIRST_BITS ranges go to the driver, then those near a possible cut are split by MORE_BITS, again and again,
    until single groups stand there. So the driver holds 2^FIRST_BITS numbers and some 2^MORE_BITS a cut and
    split, however large the table; shards then are a comparison of the key with the cuts, without a join.
    slot numbers the rows of a shard from 0, gapless. Repeated rows and null ids stay as rows of their own.
    An empty table gives an empty one; extra columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("__key"),
    ))

    def sums(some: DataFrame, bits: int) -> list[Range]:
        grouped = some.groupBy(F.shiftright("__key", bits).alias("at")).agg(F.min("__key"), F.max("__key"), F.sum("size"))
        return [tuple(r[1:]) for r in grouped.collect()]

    bits = KEY_BITS - FIRST_BITS
    found = sorted(sums(rows, bits))
    while found and (spans := near_cuts(found, shards)):
        bits = max(0, bits - MORE_BITS)
        inside = lambda lo, hi: any(a <= lo and hi <= b for a, b in spans)  # noqa: E731, B023
        again = reduce(or_, [F.col("__key").between(a, b) for a, b in spans])
        found = sorted([r for r in found if not inside(r[0], r[1])] + sums(rows.where(again), bits))
    first = [r[0] for r in found] + [1 << KEY_BITS]
    cuts = [first[at] for at in minimax_cuts([r[2] for r in found], shards)]
    shard = sum((F.when(F.col("__key") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")
    parts = max(1, rows.count() // (shards * PART_ROWS) + 1)
    sharded = rows.withColumn("shard", shard).drop("__key")
    placed = numbered(sharded, ["shard"], ["doc_id", "size", "text_crc32"], F.lit(parts))
    return placed.withColumnRenamed("position", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
