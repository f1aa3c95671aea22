"""Hard negatives by exact integer scores: several candidates' components in the fields of one wide integer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import stored

#: Components are whole numbers of 1 / SCALE.
SCALE = 256
#: Rows with a scaled component of this size or more are out of range: a score of up to 2,047 components fits a long.
LARGEST = 1 << 26
#: Anchors that a task holds at once, candidates compared with them in one product, and parts that the candidates of one block of anchors are dealt to at most.
ANCHORS, CANDIDATES, PARTS = 2048, 1024, 64
#: Bits of a machine word that fields are packed in, and those that thresholds need beside a score.
WORD_BITS, SPARE_BITS = 64, 8
#: Fields of one of Python's integers, where a field passes a machine word.
WIDE_FIELDS = 16
#: Rows kept of a block of anchors before they are cut to the best again.
HELD = 1 << 18
FAR = 1 << 62


def field_bits(low: int, high: int, dims: int) -> tuple[int, int]:
    """(bias, bits): what makes components of low..high unsigned, and the bits of a field that holds any biased product of so many of them."""
    bias = max(0, -low)
    return bias, max(1, (dims * (max(high, 0) + bias) ** 2).bit_length())


def fields_of(bits: int) -> int:
    """Candidates in one integer: as many fields as a machine word has, or WIDE_FIELDS of one of Python's where scores and thresholds would pass a word."""
    return WORD_BITS // bits if bits <= WORD_BITS - SPARE_BITS else WIDE_FIELDS


def packed(codes: np.ndarray, bias: int, bits: int) -> np.ndarray:
    """Integers (dims x groups): component k of candidate j, biased, stands in field j % fields of integer j // fields of row k."""
    fields = fields_of(bits)
    kind = np.uint64 if bits <= WORD_BITS - SPARE_BITS else object
    rows = -(-len(codes) // fields) * fields
    biased = np.zeros((rows, codes.shape[1]), kind)
    biased[: len(codes)] = (codes + bias).astype(kind)
    apart = biased.reshape(rows // fields, fields, codes.shape[1]).transpose(1, 2, 0)
    return sum(apart[f].T * kind(1 << (f * bits)) if kind is np.uint64 else apart[f].T * (1 << (f * bits)) for f in range(fields)).T


def scores(anchors: np.ndarray, codes: np.ndarray, bias: int, bits: int) -> np.ndarray:
    """Exact inner products (anchors x candidates): one multiplication per anchor component and integer, fields read back and freed of the bias."""
    kind = np.uint64 if bits <= WORD_BITS - SPARE_BITS else object
    whole = (anchors + bias).astype(kind) @ packed(codes, bias, bits)
    fields, mask = fields_of(bits), (1 << bits) - 1
    shift, keep = (np.uint64, np.uint64(mask)) if kind is np.uint64 else (int, mask)
    apart = np.stack([(whole >> shift(f * bits)) & keep for f in range(fields)], axis=2).reshape(len(anchors), fields * whole.shape[1])[:, : len(codes)]
    wide = np.int64 if kind is np.uint64 else object
    rest = bias * (anchors.sum(axis=1, dtype=wide)[:, None] + codes.sum(axis=1, dtype=wide)[None, :]) + codes.shape[1] * bias * bias
    return apart.astype(wide) - rest


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of lists as rows of dims numbers, short ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


class _Best:
    """The best rows of each span of each anchor in one block, cut whenever many have come together."""

    def __init__(self, rows: list[tuple], codes: np.ndarray, same_label: bool, most: int):
        self.ids, self.ties, self.labels, lows, highs = (list(x) for x in zip(*rows, strict=True))
        self.codes, self.same_label, self.most = codes, same_label, most
        spans = max(map(len, lows))
        fill = lambda x, v: np.array([[*r, *[v] * (spans - len(r))] for r in x], np.int64)
        self.lows, self.highs, self.rows, self.n = fill(lows, FAR), fill(highs, -FAR), [], 0

    def add(self, ids: np.ndarray, ties: np.ndarray, labels: np.ndarray, codes: np.ndarray, bias: int, bits: int) -> None:
        order = np.lexsort((ties, ids))  # so that a stable sort by score leaves ties to the lower id
        ids, ties = ids[order], ties[order]
        found = scores(self.codes, codes[order], bias, bits)
        own = np.array(self.ids)[:, None] == ids[None, :] if self.same_label else np.array(self.labels)[:, None] == labels[order][None, :]
        found[own] = -FAR
        at = np.argsort(-found, axis=1, kind="stable")
        found = np.take_along_axis(found, at, axis=1)
        for span in range(self.lows.shape[1]):
            first = (found > self.highs[:, span, None]).sum(axis=1)
            for step in range(self.most):
                row = np.flatnonzero(first + step < len(ids))
                place = (first + step)[row]
                row, place = (x[(found[row, place] >= self.lows[row, span])] for x in (row, place))
                which = at[row, place]
                self.rows.append((row, np.full(len(row), span), found[row, place].astype(np.int64), ids[which], ties[which]))
                self.n += len(row)
        if self.n > HELD:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        if not self.rows:
            return []
        row, span, score, ids, ties = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ties, ids, -score, span, row))
        key = (row * self.lows.shape[1] + span)[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        kept = order[rank < self.most]
        out = [x[kept] for x in (row, span, score, ids, ties)]
        self.rows, self.n = [tuple(out)], len(kept)
        return out

    def batches(self) -> Iterator[pa.RecordBatch]:
        if out := self.cut():
            row, span, score, ids, ties = out
            columns = [np.array(self.ids)[row], np.array(self.ties)[row], span, score, ids, ties]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["anchor_id", "anchor_tie", "span", "score", "id", "tie"])


def _compared(anchors: DataFrame, rows: DataFrame, same_label: bool, most: int, numbers: tuple[int, int, int]) -> DataFrame:
    """anchor_id, anchor_tie, span, score, id, tie: candidates of the best scores of each part, for each span (lows, highs) of each anchor.

    Blocks of anchors and parts of candidates are dealt by hash, a label's apart where only its own rows count, so
    that a label with most of the rows is spread. Every block meets every part once: a task reads a block's anchors,
    then streams the candidates past them in products of CANDIDATES, holding the best rows only.
    """
    low, high, dims = numbers
    bias, bits = field_bits(low, high, dims)
    group = F.col("label") if same_label else F.lit(0).cast("long")
    anchors, rows = anchors.withColumn("g", group), rows.withColumn("g", group)
    blocks = F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("blocks")
    parts = F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / CANDIDATES)).cast("int").alias("parts")
    counts = anchors.groupBy("g").agg(blocks).join(rows.groupBy("g").agg(parts), "g")
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "tie"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("array<long>")
    a = anchors.join(counts, "g").select("g", deal(F.col("blocks")).alias("block"), spread("parts").alias("part"), F.lit(0).alias("side"), "vec_id", "tie", "label", "codes", "lows", "highs")
    b = rows.join(counts, "g").select("g", spread("blocks").alias("block"), deal(F.col("parts")).alias("part"), F.lit(1).alias("side"), "vec_id", "tie", "label", "codes", none.alias("lows"), none.alias("highs"))
    key = ["g", "block", "part"]
    work = a.unionByName(b).repartition(*key).sortWithinPartitions(*key, "side")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, codes, best = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
            for start, stop in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part, now, side = batch.slice(start, stop - start), tuple(keys[start, :3]), keys[start, 3]
                if now != at:
                    yield from best.batches() if best else ()
                    at, held, codes, best = now, [], [], None
                if side == 0:
                    held += zip(*[part.column(i).to_pylist() for i in (4, 5, 6, 8, 9)], strict=True)
                    codes.append(_matrix(part.column(7), dims))
                elif held:
                    best = best or _Best(held, np.concatenate(codes), same_label, most)
                    ids, ties, labels = (part.column(i).to_numpy() for i in (4, 5, 6))
                    all_codes = _matrix(part.column(7), dims)
                    for i in range(0, len(ids), CANDIDATES):
                        best.add(*[x[i : i + CANDIDATES] for x in (ids, ties, labels, all_codes)], bias, bits)
        yield from best.batches() if best else ()

    return work.mapInArrow(mine, "anchor_id long, anchor_tie long, span long, score long, id long, tie long")


def _first(found: DataFrame, most: int, rank: str) -> DataFrame:
    order = Window.partitionBy("anchor_id", "anchor_tie", "span").orderBy(F.desc("score"), "id", "tie")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def coded(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """vec_id, tie (long, tells rows of one id apart), label, codes: what takes part, equal rows once, components scaled and rounded down."""
    doubles = F.transform(vector_col, lambda x: x.cast("double") * SCALE)
    usable = F.forall("__v", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), doubles.alias("__v"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("__v").isNotNull()).where(usable)
    codes = kept.select("vec_id", "label", F.transform("__v", lambda x: F.floor(x)).alias("codes")).distinct()
    return codes.select("vec_id", F.xxhash64("label", "codes").alias("tie"), "label", "codes")


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Components become floor(SCALE x); a score is an exact inner product, of the shorter vector's length where
    lengths differ. An anchor's positives are the rows of its label with the highest scores; the negatives of one
    are the rows of other labels with the highest scores from low to high percent of the positive's. Ties go to
    the lower id. `anchor` chooses among vec_id and label; `label` replaces the label column.

    Two passes over products of blocks: positives within a label, then negatives, whose spans the positives set.
    Rows with a null id, label, vector or component, with a component that is not finite or beyond LARGEST / SCALE,
    take no part. Equal rows count once; rows that share an id with other contents are rows of their own, but none
    is its namesake's positive. Empty vectors score 0. Extra columns are left out; an empty table gives an empty one.
    """
    known = coded(rows, id_col, F.col(label_col) if label is None else label, vector_col)
    codes = F.col("codes")
    stats = known.agg(F.min(F.array_min(codes)).alias("low"), F.max(F.array_max(codes)).alias("high"), F.max(F.size(codes)).alias("dims")).first()
    numbers = stats.low or 0, stats.high or 0, stats.dims or 0
    narrow = next(k for k, n in (("smallint", 1 << 15), ("int", 1 << 31)) if -n <= numbers[0] and numbers[1] < n)
    known = stored(known.withColumn("codes", codes.cast(f"array<{narrow}>")))
    anchors = known.where(anchor)
    everything = F.array(F.lit(-FAR + 1)), F.array(F.lit(FAR))
    found = _compared(anchors.withColumn("lows", everything[0]).withColumn("highs", everything[1]), known, True, positives, numbers)
    good = stored(_first(found, positives, "place").select("anchor_id", "anchor_tie", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # floor and ceiling of a share, in whole numbers
    most = F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100")
    least = F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100")
    spans = good.withColumn("span", F.struct("place", least.alias("low"), most.alias("high"))).groupBy("anchor_id", "anchor_tie").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    asked = anchors.join(spans, (anchors["vec_id"] == spans["anchor_id"]) & (anchors["tie"] == spans["anchor_tie"]))
    asked = asked.select("vec_id", "tie", "label", "codes", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    bad = _first(_compared(asked, known, False, negatives, numbers), negatives, "rank").withColumn("place", F.col("span") + 1)
    return bad.join(good, ["anchor_id", "anchor_tie", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = f"""
WITH e AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT * FROM e WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM a, e WHERE a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
) WHERE rank <= 3
"""
