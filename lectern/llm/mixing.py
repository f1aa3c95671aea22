"""Mixing by Pfair scheduling: each source's blocks get windows from its weight; earliest deadline goes first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.positions import numbered
from lectern.llm.scratch import small

#: Bytes of text in a block, at least; blocks are as much larger as keeps the schedule within SLOTS.
BLOCK_BYTES, SLOTS = 8_192, 1 << 22
#: Rows sorted together when a source is cut into blocks, and slots of a batch of the schedule.
PART_ROWS, BATCH = 2_048, 1 << 16


def whole_weights(weights: Mapping[int, float]) -> dict[int, int]:
    """Whole numbers in exactly the weights' proportions."""
    exact = {i: Fraction(w) for i, w in weights.items()}
    scale = lcm(*[w.denominator for w in exact.values()])
    return {i: int(w * scale) for i, w in exact.items()}


class Targets:
    """When each source should have run how much: sources share every slot by weight until their blocks are used up, and those left share what such a one had.

    With v the work done for each unit of weight, a source of n blocks and weight w has min(n, w v) of them, and the slots
    passed are the sum of these: straight lines between the v at which sources end. All numbers are exact.
    """

    def __init__(self, blocks: Mapping[int, int], weights: Mapping[int, int], start: int = 0) -> None:
        order = sorted(blocks, key=lambda i: (Fraction(blocks[i], weights[i]), i))
        self.weights, self.place = weights, {i: at for at, i in enumerate(order)}
        self.ends = [(blocks[i], weights[i]) for i in order]
        self.used = [start + n for n in accumulate((blocks[i] for i in order), initial=0)]
        total = sum(weights.values())
        self.left = [total - w for w in accumulate((weights[i] for i in order), initial=0)]

    def time(self, i: int, k: int, phase: int = 0) -> tuple[int, int, int]:
        """The time at which source i should have run k blocks, as a fraction (numerator, denominator), and the sources used up by then, `phase` at least."""
        weight, last = self.weights[i], self.place[i]
        while phase < last and k * self.ends[phase][1] >= self.ends[phase][0] * weight:
            phase += 1
        return self.used[phase] * weight + k * self.left[phase], weight, phase


def schedule(blocks: Mapping[int, int], weights: Mapping[int, float], start: int = 0) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of all blocks, slot by slot; weights are positive.

    Of the released blocks the one with the earliest deadline runs. The shares of a slot sum to one, so every window is
    met, and at any slot each source is less than one block from its target. The state is one block a source.
    """
    left = {i: n for i, n in blocks.items() if n}
    if not left:
        return
    targets = Targets(left, whole_weights({i: weights[i] for i in left}), start)
    waiting: list[tuple[int, int, int, int, int]] = []  # release, source, block, deadline, phase
    ready: list[tuple[int, int, int, int, int]] = []  # deadline, source, block, release, phase

    due = {i: targets.time(i, 0) for i in left}

    def enter(i: int, k: int) -> None:
        """A block may run from the slot in which its share begins, and must have run when its share is complete."""
        a, b, phase = due[i]
        c, d, _ = due[i] = targets.time(i, k + 1, phase)
        heapq.heappush(waiting, (a // b, i, k, -(-c // d), phase))

    for i in left:
        enter(i, 0)
    for slot in range(start, start + sum(left.values())):
        while waiting and waiting[0][0] <= slot:
            release, i, k, deadline, phase = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, k, release, phase))
        deadline, i, k, release, phase = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield i, k, phase, release, deadline, slot
        if k + 1 < left[i]:
            enter(i, k + 1)


def mixed(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    block_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, block, phase, release, deadline, slot, block_row and, as keep_*, the columns named in keep.

    A source's rows are put in an order of a hash, and each block has block_bytes of their text (UTF-8 bytes
    plus 1 each; a row belongs to the block in which it starts, a longer one spans the next). Blocks run in slots of one
    Pfair schedule: slot, then block_row, orders the whole mix; release and deadline are the block's window and phase is the
    number of sources used up when it is released. A source is less than one block from its target at any slot; when one is
    used up, those left share its slots from that moment on. weights maps sources to targets; else a source weighs its
    bytes to `power`. Sources without a positive weight run when all others are used up, evenly. Targets count exactly as
    given. A block has BLOCK_BYTES, or as many more as keep the schedule within SLOTS slots, so that one task can
    make it, batch by batch; blocks meet their slots in a join.

    A null source is a source of its own, null texts are empty, repeated rows and null ids stay; an empty table gives an
    empty one. Every row gets one place. The driver holds a row per source.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(id_col, text_col).alias("__order"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("__size"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size")).collect()
    weight = lambda r: max(0.0, float(weights.get(r.source, 0))) if weights is not None else float(r.size) ** power
    found = sorted(found, key=lambda r: (weight(r) <= 0, -r.size, r.source is not None, r.source))
    width = block_bytes or max(BLOCK_BYTES, -(-sum(r.size for r in found) // SLOTS))
    blocks = {i: (r.size - 1) // width + 1 for i, r in enumerate(found)}
    first = {i: n for i, n in blocks.items() if weight(found[i]) > 0}
    later = {i: n for i, n in blocks.items() if i not in first}
    target = {i: weight(found[i]) if i in first else 1.0 for i in blocks}

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            at, slots = sum(first.values()), []
            for row in (row for part in (schedule(first, target), schedule(later, target, at)) for row in part):
                slots.append(row)
                if len(slots) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*slots, strict=True)], names)
                    slots = []
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*slots, strict=True)], names)

    names = ["__s", "__b", "phase", "release", "deadline", "slot"]
    spark = docs.sparkSession
    table = spark.range(0, 1, 1, 1).mapInArrow(plan, ", ".join(f"{n} long" for n in names)).repartition("__s", "__b")
    sources = spark.createDataFrame([(i, r.source, r.n // PART_ROWS + 1) for i, r in enumerate(found)], "__i int, __source string, __units int")
    rows = rows.join(small(sources, len(found), 64), F.col("source").cast("string").eqNullSafe(F.col("__source"))).drop("__source")
    rows = numbered(rows, ["__i"], ["__order", "doc_id"], F.col("__units"), "__size")
    rows = rows.withColumn("block", F.expr(f"before div {width}"))
    rows = rows.join(table, (F.col("__i") == F.col("__s")) & (F.col("block") == F.col("__b")))
    return rows.select("doc_id", "source", "block", "phase", "release", "deadline", "slot", F.col("position").alias("block_row"), *[F.col(f"__keep_{c}").alias(f"keep_{c}") for c in keep])
