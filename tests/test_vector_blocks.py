"""Tables of queries against all rows, as products of blocks: results, ties, odd vectors, plans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import index_queries
from lectern.operators import vector, vector_blocks, vector_index
from lectern.sources.catalog import Catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hits(df):
    return sorted((str(r.query), r.id, r.similarity, r["rank"]) for r in df.collect())


def test_no_pair_of_rows_is_a_row(spark):
    """Pairs are scored in products of blocks, not as rows of a join."""
    text = plan(index_queries.knn_batch(Catalog(spark, DATA)))
    assert "NestedLoop" not in text and "Cartesian" not in text and "MapInArrow" in text


@pytest.mark.parametrize("rows_of_tile, queries_of_tile", [(1 << 14, 1 << 13), (7, 3)])
def test_equals_one_by_one(spark, monkeypatch, rows_of_tile, queries_of_tile):
    monkeypatch.setattr(vector_blocks, "ROWS", rows_of_tile)
    monkeypatch.setattr(vector_blocks, "QUERIES", queries_of_tile)
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)]  # many ties and some zeros
    nan, inf = float("nan"), float("inf")
    rows += [(100, None), (101, [1.0, None, 0.0, 1.0]), (102, [nan, 0.0, 0.0, 1.0]), (103, [inf, 1.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [1e-90] * 4), (107, [1e90] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = df.where("id % 3 = 0 OR id >= 100")
    assert hits(vector_blocks.nearest(df, asked, 5)) == hits(vector.nearest(df, asked, 5))
    ids = df.where("id IS NOT NULL")
    named = ids.select(F.concat(F.lit("q"), "id").alias("id"), "vector")
    assert hits(vector_blocks.nearest(ids, named, 5, drop_self=False)) == hits(vector.nearest(ids, named, 5, drop_self=False))
    assert vector_blocks.nearest(df.where("false"), asked, 5).count() == vector_blocks.nearest(df, asked.where("false"), 5).count() == 0


def test_hot_vectors_and_small_products(monkeypatch):
    """Most rows are copies: the lowest ids stay, whatever chunks they come in."""
    monkeypatch.setattr(vector_blocks, "SCORES", 50)
    copies = [[1.0, 2.0, 3.0]] * 200
    lists = lambda x: pa.array(x, pa.list_(pa.float32()))
    held = vector_blocks._Best(pa.array(["a", "b"]), pa.array([3, None], pa.int64()), lists([[1, 2, 3], [3, 2, 1]]), pa.array([[0], [0]], pa.list_(pa.int32())), 4, 6)
    for start in (100, 0):
        held.add(pa.array(range(start, start + 100), pa.int64()), 0, lists(copies[:100]))
    got = {}
    for batch in held.batches():
        for r in batch.to_pylist():
            got.setdefault(r["query"], []).append((r["id"], r["value"]))
    assert got == {"a": [(i, 1.0) for i in (0, 1, 2, 4)], "b": [(i, 0.714286) for i in range(4)]}


def test_halves_go_away_from_zero():
    import numpy as np

    assert vector_blocks.rounded(np.array([0.0078125, -0.0078125, 0.5, -1e-9]), 6).tolist() == [0.007813, -0.007813, 0.5, 0.0]


@pytest.fixture(scope="module")
def small(spark):
    """An index of 90 rows in 6 cells, and its rows: three clusters, one of them of copies."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(k == i % 3, 0.2) if i % 3 else float(k == 0) for k in range(4)], i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    return vector_index.indexed(df, "small", "1", cells=6), df, df.where("id % 4 = 0").select("id", "vector")


def tiny(monkeypatch):
    """Tiles so small that cells are split into parts and queries into blocks."""
    monkeypatch.setattr(vector_blocks, "ROWS", 4)
    monkeypatch.setattr(vector_blocks, "QUERIES", 5)


def test_filtered_cells_meet_as_blocks(spark, monkeypatch, small):
    """F2"""
    assert "MapInArrow" in plan(index_queries.ivf_knn_filtered(Catalog(spark, DATA)))
    tiny(monkeypatch)
    made, rows, asked = small
    odd = F.col("label") == 1
    assert hits(vector_index.nearest(made, asked, 5, probes=1, where=odd, complete=True)) == hits(vector.nearest(rows, asked, 5, odd))


def test_further_cells_meet_as_blocks(spark, monkeypatch, small):
    """F3"""
    assert "MapInArrow" in plan(index_queries.ivf_knn_complete(Catalog(spark, DATA)))
    tiny(monkeypatch)
    made, rows, asked = small
    outside = spark.createDataFrame([(-1, None), (-2, [0.0] * 4), (-3, [1.0] * 4), (-4, [float("nan")] * 4), (-5, [1.0])], "id long, vector array<float>")
    for queries in (asked, outside):
        assert hits(vector_index.nearest(made, queries, 5, probes=1, complete=True)) == hits(vector.nearest(rows, queries, 5))


def test_codes_meet_as_blocks(spark, monkeypatch, small):
    """F6"""
    assert vector_index._met(vector_index.VectorIndex(small[0].rows, small[0].cells, 6), small[0].rows.where("id < 9").select(F.col("id").alias("query"), F.col("codes").alias("__codes"), "cell"), None, True, "codes").columns == ["query", "id", "cell", "value"]
    tiny(monkeypatch)
    made, rows, asked = small
    codes = {r.id: list(r.codes) for r in made.rows.collect()}
    met = vector_index._met(made, asked.join(made.rows.select("id", "codes"), "id").select(F.col("id").alias("query"), F.col("codes").alias("__codes"), F.expr("sequence(0, 5)").alias("cells")), None, True, "codes", 7)
    got = {(r.query, r.id): r.value for r in vector_blocks.first(met, 7, "value").collect()}
    want = {}
    for q in (r.id for r in asked.collect()):
        scores = sorted((-sum(a * b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in codes if i != q)
        want |= {(q, i): -s for s, i in scores[:7]}
    assert got == want
    found = hits(vector_index.nearest(made, asked, 5, probes=6, oversampling=6))
    assert len(found) == len(hits(vector.nearest(rows, asked, 5))) and all(r[2] <= 1 for r in found)


def test_one_tile_per_part_of_a_cell(spark, monkeypatch, small):
    """F7"""
    assert "MapInArrow" in plan(index_queries.ivf_knn(Catalog(spark, DATA)))
    made, rows, asked = small
    monkeypatch.setattr(vector_blocks, "ROWS", 10)
    counts = {r.cell: r.rows for r in made.cells.collect()}
    tiled, tiles = vector_index._tiles(made.cells)
    assert sum(counts.values()) == 90 and [parts for _, _, parts in tiled] == [-(-counts[cell] // 10) for cell, _, _ in tiled]
    assert tiles - 1 >= max(first + parts - 1 for _, first, parts in tiled) and max(counts.values()) > 10
    tiny(monkeypatch)
    assert hits(vector_index.nearest(made, asked, 5, probes=6)) == hits(vector.nearest(rows, asked, 5))
