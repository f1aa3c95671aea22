"""An inverted-file index of vectors: cells around centroids, 8-bit codes beside the floats, the nearest cells read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import vector_blocks
from lectern.operators.vector import clamped, dot
from lectern.operators.vector_blocks import first as _first
from lectern.session import ship
from lectern.storage import kept, small, stored

#: Rows that centroids and the codes' bound are fitted on, at most (in expectation: rows are chosen by a hash of the id).
SAMPLE = 65_536
#: Cells, at most; below that the square root of the rows.
MOST_CELLS = 4_096
#: Share of the values that the codes' range covers, and code of its end.
QUANTILE, TOP_CODE = 0.99, 127
#: Requests that the number of cells to read is fitted on, the neighbours counted for each, and the share of these that the cells must hold.
TRIALS, NEIGHBOURS, RECALL = 100, 10, 0.95
#: Places that similarities are rounded to.
PLACES = 6
#: Rows, or queries, whose distances to all centres a task holds at once.
STEP = 1_024


@dataclass(frozen=True)
class VectorIndex:
    """rows: id, payload, vector, size, codes, cell, stored by cell in order of id; cells: cell, centre, reach (distance of its farthest row), rows (how many it has), bound (of the codes); probes: cells that a request reads."""

    rows: DataFrame
    cells: DataFrame
    probes: int


def unit(vector: Column, size: Column) -> Column:
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))


def coded(vector: Column, bound: Column) -> Column:
    """Values over the bound, as whole numbers from -127 to 127."""
    return F.transform(vector, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(x, bound), F.lit(0.0)))) * TOP_CODE).cast("tinyint"))


class _Centres:
    """Centres of cells as a matrix, for tasks. Vectors count scaled to length 1; those without values, or of another length, as zeros."""

    def __init__(self, cells: DataFrame) -> None:
        held = cells.orderBy("cell").collect()  # MOST_CELLS at most
        self.numbers = np.array([r.cell for r in held], np.int32)
        self.centres = np.array([r.centre for r in held], np.float64) if held else np.zeros((0, 0))
        self.reaches = np.array([r.reach for r in held], np.float64) if "reach" in cells.columns else None
        self.squares = np.einsum("ij,ij->i", self.centres, self.centres)

    def scaled(self, vectors: pa.Array) -> np.ndarray:
        rows, lengths = vector_blocks.matrix(vectors, self.centres.shape[1])
        return np.where((lengths == rows.shape[1])[:, None], vector_blocks.units(rows)[0], 0.0)

    def nearest(self, vectors: pa.Array) -> np.ndarray:
        """Of each vector the nearest cell, the lower one of two."""
        found = [self.numbers[:0]]
        for i in range(0, len(vectors), STEP):
            with np.errstate(all="ignore"):
                found.append(self.numbers[np.argmin(self.squares - 2 * (self.scaled(vectors.slice(i, STEP)) @ self.centres.T), axis=1)])
        return np.concatenate(found)

    def distances(self, scaled: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """To every centre, or of each vector to the centre of its own cell."""
        with np.errstate(all="ignore"):
            squares = np.einsum("ij,ij->i", scaled, scaled)
            if cells is None:
                return np.sqrt(np.maximum(0.0, squares[:, None] - 2 * (scaled @ self.centres.T) + self.squares[None, :]))
            at = np.searchsorted(self.numbers, cells)
            return np.sqrt(np.maximum(0.0, squares - 2 * np.einsum("ij,ij->i", scaled, self.centres[at]) + self.squares[at]))


def indexed(vectors: DataFrame, name: str, made_of: str, cells: int | None = None, seed: int = 1) -> VectorIndex:
    """The index of vectors (id, vector, payload columns), built once for an input version and kept.

    Centroids come from k-means on a bounded sample of the vectors, scaled to length 1; every row is then dealt to its
    nearest centroid. Rows without a vector are not searched. Cells with many rows are written by several tasks. The
    number of cells to read is fitted too: TRIALS rows are searched exhaustively once, and so many of the nearest cells are
    read as hold RECALL of their neighbours. It follows the data: the less they cluster, the more cells it takes.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = vectors.where("vector IS NOT NULL").withColumn("size", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    scaled = known.withColumn("__unit", unit(F.col("vector"), F.col("size")))

    def fitted() -> DataFrame:
        n = known.count()
        k = cells or max(1, min(MOST_CELLS, round(sqrt(n))))
        chosen = scaled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= (1 << 20) * SAMPLE // max(1, n))
        bound = chosen.select(F.explode("__unit").alias("v")).agg(F.coalesce(F.percentile_approx(F.abs("v"), F.lit(QUANTILE), F.lit(10_000)), F.lit(1.0)).alias("bound"))
        if n == 0:
            return bound.select(F.lit(0).alias("cell"), F.array().cast("array<double>").alias("centre"), "bound")
        dense = chosen.select(array_to_vector("__unit").alias("f")).repartition(spark.sparkContext.defaultParallelism)  # a file of one row group is one task
        model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="f", predictionCol="cell").fit(dense)
        centres = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]  # MOST_CELLS at most
        return spark.createDataFrame(centres, "cell int, centre array<double>").crossJoin(F.broadcast(bound))

    centres = kept(spark, f"centroids of {name}", made_of, fitted)

    def dealt() -> DataFrame:
        held, bound = _Centres(centres), centres.first().bound

        @F.arrow_udf("int")
        def near(vector: pa.Array) -> pa.Array:
            return pa.array(held.nearest(vector))

        at = known.withColumn("cell", near("vector")).withColumn("codes", coded(unit(F.col("vector"), F.col("size")), F.lit(bound)))
        return at.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")

    rows = kept(spark, f"cells of {name}", made_of, dealt, ("cell",))

    def reaches() -> DataFrame:
        held = _Centres(centres)

        @F.arrow_udf("double")
        def far(cell: pa.Array, vector: pa.Array) -> pa.Array:
            return pa.array(held.distances(held.scaled(vector), cell.to_numpy()))

        return centres.join(rows.groupBy("cell").agg(F.max(far("cell", "vector")).alias("reach"), F.count(F.lit(1)).alias("rows")), "cell")

    reached = kept(spark, f"reaches of {name}", made_of, reaches)

    def tried() -> DataFrame:
        n = max(1, rows.count())
        trials = stored(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) <= (1 << 20) * TRIALS // n).select("id", "vector", "size"))
        found = rows.select("id", "cell").join(small(vector_blocks.nearest(rows, trials, NEIGHBOURS).select("query", "id"), 2 * TRIALS * NEIGHBOURS, 64), "id")
        places = _placed(trials, reached).select("query", F.posexplode("cells").alias("__place", "cell")).withColumn("__place", F.col("__place") + 1)
        return found.join(places, ["query", "cell"]).agg(F.percentile_approx("__place", F.lit(RECALL), F.lit(10_000)).alias("probes"))

    probes = kept(spark, f"probes of {name}", made_of, tried).first().probes
    return VectorIndex(rows, reached, probes or MOST_CELLS)


def _placed(queries: DataFrame, cells: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """query, __q, cells: the cells as each of queries (id, vector) sees them, the nearest first, after the first ones and up to the last.

    Where queries have `worst`, only cells that may hold a row of that similarity or above; where that is null, all.
    """
    ship(queries.sparkSession)
    held = _Centres(cells)
    worst = F.col("worst") if "worst" in queries.columns else F.lit(None)
    wide = queries.select(F.col("id").alias("query"), F.col("vector").alias("__q"), worst.cast("double").alias("worst"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), STEP):
                batch = whole.slice(i, STEP)
                apart = held.distances(held.scaled(batch.column(1)))
                order = np.argsort(apart, axis=1, kind="stable")[:, first:last]
                read = np.ones(order.shape, bool)
                if held.reaches is not None:
                    least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                    with np.errstate(all="ignore"):
                        highest = 1 - np.maximum(0.0, np.take_along_axis(apart - held.reaches, order, axis=1)) ** 2 / 2
                        read = ~(highest < least - 10.0**-PLACES)  # what is not a number is read
                ends = np.r_[0, np.cumsum(read.sum(axis=1))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(held.numbers[order[read]]))], ["query", "__q", "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    return wide.mapInArrow(placed, f"query {kinds['query']}, __q {kinds['__q']}, cells array<int>")


def _tiles(cells: DataFrame) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, its first tile, how many it has), and the tiles of all: cells together up to vector_blocks.ROWS, larger ones apart, in parts."""
    found, tile, filled = [], 0, 0
    for r in cells.select("cell", "rows").orderBy("cell").collect():  # MOST_CELLS at most
        if filled and filled + r.rows > vector_blocks.ROWS:
            tile, filled = tile + 1, 0
        parts = ceil(r.rows / vector_blocks.ROWS)
        found.append((r.cell, tile, parts))
        tile, filled = (tile + parts, 0) if parts > 1 else (tile, filled + r.rows)
    return found, tile + 1


def _met(index: VectorIndex, asked: DataFrame, where: Column | None, drop_self: bool, column: str, n: int = NEIGHBOURS) -> DataFrame:
    """query, id, cell, value: at least the n best rows of the cells in asked (stored: query, its __q or __codes, cells), by cosine of column vector or product of column codes; other cells' files are not opened.

    Cells are bundled into tiles, as are blocks of queries; a query goes to the tiles that have cells it reads.
    """
    asked = asked if "cells" in asked.columns else asked.withColumn("cells", F.array("cell"))
    read = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]
    rows = index.rows.where(F.col("cell").isin(read))
    rows = vector_blocks.with_id(rows if where is None else rows.where(where), drop_self)
    tiled, tiles = _tiles(index.cells)
    blocks = max(1, ceil(asked.count() / vector_blocks.QUERIES))
    spread = F.broadcast(asked.sparkSession.createDataFrame(tiled, "cell int, __first int, __parts int"))
    tile = (F.col("__first") + F.pmod(F.xxhash64("id"), F.col("__parts"))) * blocks + F.col("__block")
    known = rows.select("id", "cell", F.col(column).alias("vector")).join(spread, "cell").withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    vector = F.col("__q" if column == "vector" else "__codes").alias("vector")
    wide = vector_blocks.with_id(asked, drop_self, "query").select("query", vector_blocks.own(F.col("query"), index.rows, drop_self), vector, "cells")
    wide = wide.withColumn("tile", F.pmod(F.xxhash64("query", "vector"), F.lit(blocks)))
    of = {cell: (tile, parts) for cell, tile, parts in tiled}
    firsts, parts = (np.array([of.get(cell, (0, 0))[i] for cell in range(max(of, default=-1) + 1)], np.int64) for i in (0, 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), STEP // 4):
                batch = whole.slice(i, STEP // 4)
                lists = batch.column(3)
                cells, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
                times = parts[cells]
                tile = np.repeat(firsts[cells], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cells, owner = np.repeat(cells, times), np.repeat(owner, times)
                order = np.lexsort((cells, tile, owner))
                cells, owner, tile = cells[order], owner[order], tile[order]
                start = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (owner[1:] != owner[:-1])]) if len(cells) else np.empty(0, np.int64)
                one = batch.take(pa.array(owner[start]))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(cells)].astype(np.int32)), pa.array(cells))
                yield pa.RecordBatch.from_arrays([*one.columns[:3], lists, pa.array(tile[start] * blocks + one.column(4).to_numpy())], one.schema.names)

    queries = wide.mapInArrow(dealt, wide.schema)
    return vector_blocks.best(known.select(tile.alias("tile"), "cell", "id", "vector"), queries, tiles * blocks, n, PLACES if column == "vector" else None)


def _exact(met: DataFrame) -> DataFrame:
    similarity = F.coalesce(F.try_divide(dot(F.col("vector"), F.col("__q")), F.col("size") * F.sqrt(dot(F.col("__q"), F.col("__q")))), F.lit(0.0))
    return met.select("query", "id", F.round(clamped(similarity), PLACES).alias("similarity"))


def nearest(index: VectorIndex, queries: DataFrame, n: int, probes: int | None = None, where: Column | None = None, oversampling: int | None = None, complete: bool = False, drop_self: bool = True) -> DataFrame:
    """query, id, similarity, rank: for each of queries (id, vector) the n nearest rows of the cells nearest to it (probes, or as many as the index was fitted to), by cosine; ties go to the lower id.

    oversampling: codes choose so many times n rows by whole-number scores, and only these rows' floats are read. complete: a
    second pass reads the further cells that may hold a nearer row, by their distance and reach, so that no neighbour is
    missed. where is tested before the scoring. Queries meet the rows of their cells as products of blocks.
    """
    probes = probes or index.probes
    near = _placed(queries, index.cells, 0, probes)
    cosines = lambda asked: _met(index, asked, where, drop_self, "vector", n).select("query", "id", F.col("value").alias("similarity"))
    if oversampling is None:
        found = cosines(stored(near))
    else:
        bound = F.lit((index.cells.first() or {"bound": 1.0})["bound"])
        near = stored(near.withColumn("__codes", coded(unit(F.col("__q"), F.sqrt(dot(F.col("__q"), F.col("__q")))), bound)))
        rough = _met(index, near, where, drop_self, "codes", oversampling * n)
        chosen = stored(_first(rough, oversampling * n, "value").select("query", "id", "cell"))
        cells = [r.cell for r in chosen.select("cell").distinct().collect()]
        floats = index.rows.where(F.col("cell").isin(cells)).select("cell", "id", "vector", "size")
        asked = near.select("query", "__q")
        found = _exact(floats.join(small(chosen, chosen.count(), 64), ["cell", "id"]).join(small(asked, asked.count(), 2_048), "query"))
    best = _first(found, n, "similarity")
    if not complete:
        return best
    best = stored(best)
    worst = best.groupBy("query").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n).drop("__n")
    further = queries.select("id", "vector").join(worst, F.col("id") == F.col("query"), "left").select("id", "vector", "worst")
    rest = cosines(stored(_placed(further, index.cells, probes)))
    return _first(best.drop("rank").unionByName(rest), n, "similarity")
