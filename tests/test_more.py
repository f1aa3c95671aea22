"""Cases beyond the tables: deep trees and cycles, long walks, retagging, requests, recall of the 8-bit search."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import understanding as ask
from lectern.operators import graph, library, vector
from lectern.plans.explore import answered, explored
from lectern.sources.catalog import Catalog, source_of
from lectern.storage import folder

DATA = "/root/testdata/sf0.001"


def test_trees_of_any_depth(spark):
    rows = [(f"k{i}", f"n{i}", f"k{i - 1}" if i else None) for i in range(13)] + [("a", "A", "b"), ("b", "B", "a"), ("c", "C", "gone")]
    got = {r.key: (r.path, r.level) for r in library.collection_tree(spark.createDataFrame(rows, "key string, name string, parent_key string")).collect()}
    assert len(got) == 16 and got["k12"] == ("/".join(f"n{i}" for i in range(13)), 12)
    assert got["a"] == got["b"] == (None, None) and got["c"] == ("C", 0)
    assert library.collection_tree(spark.createDataFrame([], "key string, name string, parent_key string")).count() == 0


def test_walks_beyond_three_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    assert {r.id: r.hops for r in graph.chain(edges, 0, 5).collect()} == {i: i for i in range(1, 6)}
    shared = spark.createDataFrame([(p, c) for p in range(6) for c in (p, p + 1)], "src long, dst long")
    assert {r.id: r.hops for r in graph.neighbours(shared, 0, 4, 10).collect()} == {i: i for i in range(1, 5)}


def test_retagging_ignores_case(spark):
    tags = spark.createDataFrame([(1, "Old"), (1, "new"), (2, "old"), (3, "Old")], "item_key long, tag string")
    got = library.retagged(tags, spark.createDataFrame([(1,), (2,)], "item_key long"), ["New"], ["OLD"])
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (2, "New"), (3, "Old")]
    assert sorted(map(tuple, library.retag_counts(tags, got).collect())) == [("added", "New", 1), ("removed", "Old", 1), ("removed", "old", 1)]


@pytest.mark.parametrize("seed", [0, 50, 100, 150])
def test_quantized_search_recall(spark, seed):
    rows = Catalog(spark, DATA).vectors()
    exact = {r.id for r in vector.nearest(rows, rows.where(F.col("id") == seed), 10).collect()}
    rough = {r.id for r in vector.nearest_quantized(rows, seed, 10).collect()}
    assert len(exact & rough) >= 9


def test_column_and_plain_decomposition_agree(spark):
    requests = ["memory and attention", "this or that", "methods for sleep", "one, two, three", "Long Short Memory versus Random Forest", "plain", "a with b plus c", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(requests)], "i int, text string")
    got = {r.i: [tuple(p) for p in r.p] for r in df.select("i", ask.decompose_column(F.col("text")).alias("p")).collect()}
    for i, r in enumerate(requests):
        assert got[i] == [(p.text, p.kind, p.importance) for p in ask.decompose(r) if p.text]


def test_summary_intents_agree(spark):
    requests = ["what about this", "short one", "a request of many words that asks for nothing", "the full text please"]
    df = spark.createDataFrame([(r,) for r in requests], "text string")
    assert [tuple(r.i) for r in df.select(ask.intent_column(F.col("text"), "summary").alias("i")).collect()] == [ask.intent(r, "summary") for r in requests]


def test_explore_modes(spark):
    c = Catalog(spark, DATA)
    with pytest.raises(ValueError):
        explored(c, "related")
    with pytest.raises(ValueError):
        explored(c, "nothing", 1)
    assert {r.strategy for r in answered(c, "who cites this paper", 1).collect()} <= {"citation"}
    assert source_of(True, True) == "database" and source_of(True, False) == source_of(False, True) == "api"


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Cluster:
        """A session of a cluster without a shared folder."""

        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        folder(Cluster())


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    from lectern.streaming import ingest

    rows, index = f"file://{tmp_path}/rows", f"file://{tmp_path}/index"
    spark.createDataFrame([(k, 1, "first") for k in range(200)], "k long, t long, v string").coalesce(1).write.parquet(rows)
    schema = spark.read.parquet(rows).schema

    def run():
        ingest.upsert_stream(ingest.stream(spark, rows, schema), index, "k", ["t"], f"{tmp_path}/state", 16).awaitTermination()
        return ingest._versions(spark, index)

    assert {b: len(v) for b, v in run().items()} == dict.fromkeys(range(16), 1)
    spark.createDataFrame([(7, 2, "second"), (8, 0, "late")], "k long, t long, v string").coalesce(1).write.mode("append").parquet(rows)
    assert sum(len(v) for v in run().values()) in (17, 18)
    spark.createDataFrame([(7, 3, "third")], "k long, t long, v string").coalesce(1).write.mode("append").parquet(rows)
    assert max(len(v) for v in run().values()) == 2
    got = {r.k: r.v for r in ingest.latest(spark, index, schema).collect()}
    assert len(got) == 200 and got[7] == "third" and got[8] == "first"
