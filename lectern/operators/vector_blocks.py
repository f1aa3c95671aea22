"""Nearest neighbours of a table of queries: blocks of queries against blocks of rows, as matrix products in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import ship

#: Rows of a tile, and queries that a task holds at once.
ROWS, QUERIES = 16_384, 8_192
#: Rows, and scores, that one product has at most.
CHUNK, SCORES = 4_096, 1 << 20
#: Norms' squares between which scaled products stand for cosines; others are divided one by one.
NORMS = 1e-140, 1e140
#: Below any score.
LOWEST = -1e300


def matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as rows of dims doubles (the longest one's, if None), short ones filled with zeros, and each one's length; -1 if it or a value of it is null."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(sizes.max(initial=0)) if dims is None else dims
    flat = column.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, sizes)
    if flat.null_count:
        holes = np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]
        lengths[holes] = -1
    if len(values) == len(sizes) * dims and (sizes == dims).all():
        out = values.reshape(len(sizes), dims)
    else:
        row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = place < dims
        out = np.zeros((len(sizes), dims))
        out[row[fits], place[fits]] = values[fits]
    if (lengths < 0).any():
        out = np.where(lengths[:, None] < 0, 0.0, out)
    return out, lengths


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows scaled to length 1, those of length 0 left; and their squared lengths."""
    with np.errstate(all="ignore"):
        squares = np.einsum("ij,ij->i", rows, rows)
        return np.where(squares[:, None] == 0, 0.0, rows / np.sqrt(squares)[:, None]), squares


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves go away from zero."""
    scaled = np.abs(x) * 10.0**places
    whole = np.floor(scaled)
    return np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**places, x) + 0.0


class _Best:
    """The n best rows of each query of one tile. places: scores are cosines, rounded to these; None: plain inner products of whole numbers."""

    def __init__(self, queries: pa.Array, selves: pa.Array, vectors: pa.Array, cells: pa.Array, n: int, places: int | None) -> None:
        self.queries, self.n, self.places = queries, n, places
        self.slack = 0.0 if places is None else 0.6 * 10.0**-places
        self.vectors, self.lengths = matrix(vectors)
        self.units, self.squares = units(self.vectors)
        self.least = np.full(len(queries), LOWEST)
        known = selves.is_valid().to_numpy(zero_copy_only=False)
        self.at = np.flatnonzero(known)  # of queries that have a row of their own
        self.selves = selves.filter(pa.array(known))
        owners, read = np.repeat(np.arange(len(cells)), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)), cells.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(read, kind="stable")
        numbers, starts = np.unique(read[order], return_index=True)
        self.readers = dict(zip(numbers.tolist(), np.split(owners[order], starts[1:]), strict=True)) if len(numbers) else {}
        self.found, self.pending = [], 0

    def _plain(self, lengths: np.ndarray, squares: np.ndarray) -> bool:
        """Whether scaled products are the cosines: vectors of one length, finite, none extreme."""
        fine = lambda s: bool((((s >= NORMS[0]) & (s <= NORMS[1])) | (s == 0)).all())
        return self.places is None or (bool((lengths == self.vectors.shape[1]).all()) and bool((self.lengths == self.vectors.shape[1]).all()) and fine(squares) and fine(self.squares))

    def _cosines(self, dots: np.ndarray, squares: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Similarities of products: 0 for a zero or unlike vectors, 1 at most, 1 for one that is not a number."""
        with np.errstate(all="ignore"):
            sizes = np.sqrt(squares)
            out = np.where(sizes == 0, 0.0, dots / sizes)
        return np.where(same, np.fmin(1.0, out), 0.0)

    def add(self, ids: pa.Array, cell: int, vectors: pa.Array) -> None:
        """Rows of one cell, in order of id."""
        readers = self.readers.get(cell)
        if readers is None:
            return
        rows, lengths = matrix(vectors, self.vectors.shape[1])
        scaled, squares = units(rows) if self.places is not None else (rows, np.ones(len(rows)))
        held = self.units if self.places is not None else self.vectors
        plain = self._plain(lengths, squares)
        same = lambda q, r: (self.lengths[q] == lengths[r]) & (lengths[r] >= 0)

        def exact(q: np.ndarray, r: np.ndarray) -> np.ndarray:
            out = np.empty(len(q))
            for i in range(0, len(q), CHUNK):
                a, b = q[i : i + CHUNK], r[i : i + CHUNK]
                with np.errstate(all="ignore"):
                    dots = np.einsum("ij,ij->i", self.vectors[a], rows[b])
                    out[i : i + CHUNK] = dots if self.places is None else rounded(self._cosines(dots, self.squares[a] * squares[b], same(a, b)), self.places)
            return out

        place = np.full(len(self.queries), -1)  # of a query's own row
        place[self.at] = pc.fill_null(pc.index_in(self.selves, value_set=ids), -1).to_numpy()
        twins = len(ids) != len(pc.unique(ids))
        step = max(1, SCORES // max(1, len(rows)))
        for i in range(0, len(readers), step):
            at = readers[i : i + step]
            with np.errstate(all="ignore"):
                if plain:
                    scores = held[at] @ scaled.T
                else:
                    scores = self._cosines(self.vectors[at] @ rows.T, self.squares[at][:, None] * squares[None, :], same(at[:, None], np.arange(len(rows))[None, :]))
            own = np.flatnonzero(place[at] >= 0)
            scores[own, place[at[own]]] = -np.inf
            for q in own if twins else ():
                scores[q, pc.equal(ids, ids[int(place[at[q]])]).to_numpy(zero_copy_only=False)] = -np.inf
            near = scores >= (self.least[at] - self.slack)[:, None]
            many = np.flatnonzero(near.sum(axis=1) > 4 * self.n)
            if len(many):
                top = np.partition(scores[many], -self.n, axis=1)[:, -self.n]
                near[many] &= scores[many] >= (top - 2 * self.slack)[:, None]
                for q in many[near[many].sum(axis=1) > 4 * self.n]:  # ties: the lowest ids
                    r = np.flatnonzero(near[q])
                    near[q, r] = False
                    near[q, r[np.argsort(-exact(np.full(len(r), at[q]), r), kind="stable")[: self.n]]] = True
            q, r = np.nonzero(near)
            values = exact(at[q], r)
            good = np.flatnonzero(values >= self.least[at[q]])
            self.found.append(pa.table({"q": at[q][good], "value": values[good], "id": ids.take(pa.array(r[good])), "cell": np.full(len(good), cell, np.int32)}))
            self.pending += len(good)
            if self.pending > max(self.n * len(self.queries), CHUNK):
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.found:
            return None
        table = pa.concat_tables(self.found)
        table = table.take(pc.sort_indices(table, sort_keys=[("q", "ascending"), ("value", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = table["q"].to_numpy()
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        last = rank == self.n - 1
        self.least[q[last]] = table["value"].to_numpy()[last]
        table = table.filter(pa.array(rank < self.n))
        self.found, self.pending = [table], 0
        return table

    def batches(self) -> Iterator[pa.RecordBatch]:
        if (table := self.cut()) is not None:
            ids = pa.Table.from_arrays([self.queries.take(table["q"].combine_chunks()), table["id"], table["cell"], table["value"]], ["query", "id", "cell", "value"])
            yield from ids.combine_chunks().to_batches()


def best(rows: DataFrame, queries: DataFrame, tiles: int, n: int, places: int | None) -> DataFrame:
    """query, id, cell, value: for each query and tile at least the n best rows of the cells that the query reads there.

    rows: tile, cell, id, vector. queries: tile, query, self (id of the row that is left out, or null), vector, cells.
    A task reads a tile's queries, then streams its rows past them in products of bounded size, holding the best only.
    """
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *queries.schema]}
    null = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    right = rows.select(F.col("tile").cast("long"), F.lit(1).alias("side"), "cell", null("query"), "id", "vector", null("cells"))
    left = queries.select(F.col("tile").cast("long"), F.lit(0).alias("side"), F.lit(-1).alias("cell"), "query", F.col("self").alias("id"), "vector", "cells")
    work = right.unionByName(left).repartition(max(1, tiles), "tile").sortWithinPartitions("tile", "side", "cell", "id")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist() if len(keys) else []
            for start, stop in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                tile, side, cell = keys[start].tolist()
                if tile != at:
                    yield from held.batches() if held else ()
                    at, asked, held = tile, [], None
                if side == 0:
                    asked.append(batch.slice(start, stop - start))
                elif asked:
                    if held is None:
                        one = pa.Table.from_batches(asked).combine_chunks()
                        whole = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in one.columns]
                        held = _Best(whole[3], whole[4], whole[5], whole[6], n, places)
                    for i in range(start, stop, CHUNK):
                        part = batch.slice(i, min(CHUNK, stop - i))
                        held.add(part.column(4), cell, part.column(5))
        yield from held.batches() if held else ()

    return work.mapInArrow(met, f"query {kinds['query']}, id {kinds['id']}, cell int, value double")


def own(query: Column, rows: DataFrame, drop_self: bool) -> Column:
    """The id of a query's own row, or null if none is to be left out."""
    kind = rows.schema["id"].dataType
    return (query.try_cast(kind) if drop_self else F.lit(None).cast(kind)).alias("self")


def with_id(rows: DataFrame, drop_self: bool, name: str = "id") -> DataFrame:
    """rows; where own rows are left out, without those that have no id."""
    return rows.where(F.col(name).isNotNull()) if drop_self else rows


def first(found: DataFrame, n: int, by: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(by), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def nearest(rows: DataFrame, queries: DataFrame, n: int, drop_self: bool = True, places: int = 6) -> DataFrame:
    """query, id, similarity, rank: what vector.nearest() returns, for a table of queries (id, vector) that grows with the rows.

    Queries are dealt to blocks and rows to parts; every block meets every part once, in one task, in products of
    bounded size, so that memory does not grow with the tables. Ties go to the lower id.
    """
    blocks, parts = max(1, ceil(queries.count() / QUERIES)), max(1, ceil(rows.count() / ROWS))
    deal = lambda key, m: F.pmod(F.xxhash64(key, "vector"), F.lit(m))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = with_id(queries, drop_self).select(F.col("id").alias("query"), own(F.col("id"), rows, drop_self), "vector", deal("id", blocks).alias("block"), spread(parts).alias("part"))
    known = with_id(rows, drop_self).select("id", "vector", deal("id", parts).alias("part"), spread(blocks).alias("block"))
    tile = (F.col("block") * parts + F.col("part")).alias("tile")
    found = best(known.select(tile, F.lit(0).alias("cell"), "id", "vector"), asked.select(tile, "query", "self", "vector", F.array(F.lit(0)).alias("cells")), blocks * parts, n, places)
    return first(found.select("query", "id", F.col("value").alias("similarity")), n, "similarity")
