"""Stores that change by commits: keyed tables, the property graph, the update driver, streamed upserts."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.graph_store import GraphStore, of_mentions
from lectern.operators.keyed_store import KeyedStore
from lectern.storage import files
from lectern.streaming import ingest, update

TABLES = {"rows": ("k long, v string", ("k",))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_commits_and_repeats(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}", TABLES, 4)
    assert store.read("rows").count() == 0
    batch = store.begin(0)
    batch.put("rows", frame(spark, [(i, "a") for i in range(20)] + [(None, "n")]))
    assert store.read("rows").count() == 0  # not before the commit
    batch.commit(n=1)
    assert store.read("rows").count() == 21 and store.version()["counters"] == {"n": 1}
    assert store.begin(0) is None
    half = store.begin()
    half.put("rows", frame(spark, [(3, "lost")]))
    again = store.begin()
    again.replace("rows", frame(spark, [(3, ""), (4, ""), (99, "")]).select("k"), frame(spark, [(3, "b"), (3, "c")]))
    again.commit()
    got = sorted((r.k, r.v) for r in store.read("rows").where("k < 6").collect())
    assert got == [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "c"), (5, "a")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}", TABLES, 8)
    for n in range(4):
        batch = store.begin()
        batch.put("rows", frame(spark, [(i, str(n)) for i in (range(100) if n == 0 else [7])]))
        batch.commit()
    held = store.version()["tables"]["rows"]
    assert sorted(held.values()) == [0] * 7 + [3]
    assert len({f.rpartition("/")[0] for f, _, _ in files(spark, f"file://{tmp_path}/rows")}) == 9  # eight live buckets and one of the version before


def merged_props(spark, *batches):
    out = {}
    for batch in batches:
        for label, key, props, stamp in batch:
            if None in (label, key):
                continue
            node = out.setdefault((label, key), {})
            for name, value in (props or {}).items():
                if value is not None and (stamp, value) >= node.get(name, (float("-inf"), "")):
                    node[name] = (stamp, value)
    return {k: {n: v for n, (_, v) in p.items()} for k, p in out.items()}


def test_graph_merges(spark, tmp_path):
    schema = "label string, key string, props map<string, string>, stamp long"
    graph = GraphStore(spark, f"file://{tmp_path}", 4)
    one = [("A", "1", {"x": "a", "y": "b"}, 5), ("A", "1", {"x": "c"}, 6), ("A", "2", None, 1), ("B", None, {"x": "z"}, 1), ("B", "1", {"x": None}, 1)]
    two = [("A", "1", {"x": "old", "z": "new"}, 2), ("A", "2", {"x": "q"}, 0), ("C", "9", {}, 1)]
    edges = spark.createDataFrame([("R", "1", "2", {"w": "1"}, 1), ("R", "1", "2", {"w": "2"}, 2), ("R", None, "2", None, 1)], "rel string, src string, dst string, props map<string, string>, stamp long")
    frames = [spark.createDataFrame(rows, schema) for rows in (one, two)]
    assert graph.merge(frames[0], edges) == {"nodes_created": 3, "nodes_updated": 0, "nodes_unchanged": 0, "edges_created": 1, "edges_updated": 0, "edges_unchanged": 0}
    assert graph.merge(frames[1])["nodes_updated"] == 2
    before = graph.store.version()["tables"]
    assert graph.merge(frames[1]) == {"nodes_created": 0, "nodes_updated": 0, "nodes_unchanged": 3}
    assert graph.merge(frames[0], edges)["nodes_unchanged"] == 3 and graph.store.version()["tables"] == before
    assert {(r.label, r.key): dict(r.props) for r in graph.nodes().collect()} == merged_props(spark, one, two)
    assert [dict(r.props) for r in graph.edges().collect()] == [{"w": "2"}]


def test_graph_of_mentions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1-0", "Memory", "Concept"), (1, "1-1", "Memory", "Concept"), (1, "1-1", "A. Bee", "Person"), (2, "2-0", "Thing", "Other")], "paper long, chunk string, entity string, label string")
    graph = GraphStore(spark, f"file://{tmp_path}", 4)
    graph.merge(*of_mentions(rows, {"Concept": "DISCUSSES_CONCEPT", "Person": "AUTHORED_BY"}, F.lit(1).cast("long")))
    assert sorted((r.label, r.key) for r in graph.nodes().collect()) == [("Chunk", "1-0"), ("Chunk", "1-1"), ("Chunk", "2-0"), ("Concept", "Memory"), ("Other", "Thing"), ("Paper", "1"), ("Paper", "2"), ("Person", "A. Bee")]
    assert sorted((r.rel, r.src, r.dst) for r in graph.edges().where("rel <> 'HAS_CHUNK'").collect()) == [("AUTHORED_BY", "1", "A. Bee"), ("DISCUSSES_CONCEPT", "1", "Memory"), ("MENTIONS", "1-0", "Memory"), ("MENTIONS", "1-1", "A. Bee"), ("MENTIONS", "1-1", "Memory"), ("MENTIONS", "2-0", "Thing")]


def test_updates_change_together(spark, tmp_path):
    items = lambda rows: spark.createDataFrame(rows, "item_key long, title string, body string, stamp long")
    library = update.Updates(spark, f"file://{tmp_path}", 4)
    assert library.apply(items([(1, "T", "x" * 4500, 1), (2, "U", "Some Thing here", 1), (3, "V", None, 1), (2, "U", "older", 0), (None, "", "y", 1)]), 0) == {"added": 2, "updated": 0, "skipped": 0, "failed": 1}
    assert library.apply(items([(1, "T", "again", 9)]), 0) is None  # a repeated batch

    def broken(*_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        update.Updates(spark, f"file://{tmp_path}", 4, extract=broken).apply(items([(1, "T", "half way", 2)]), 1)
    assert library.store.read("chunks").count() == 4 and library.store.version()["number"] == 0
    assert library.apply(items([(1, "T", "short", 2), (2, "U", "Some Thing here", 3), (9, "W", "new", 1), (3, "V", " ", 2)]), 1) == {"added": 1, "updated": 1, "skipped": 1, "failed": 1}
    assert {r.item_key: r["count"] for r in library.store.read("chunks").groupBy("item_key").count().collect()} == {1: 1, 2: 1, 9: 1}
    assert {r.item_key: r["count"] for r in library.store.read("vectors").groupBy("item_key").count().collect()} == {1: 1, 2: 1, 9: 1}
    assert sorted(r.key for r in library.store.read("nodes").where("label = 'Paper'").collect()) == ["1", "2", "9"]
    assert list(library.counters()) == [0, 1]


def test_half_written_batches_are_not_read(spark, tmp_path):
    rows, index = f"file://{tmp_path}/rows", f"file://{tmp_path}/index"
    frame(spark, [(k, "first") for k in range(50)]).coalesce(1).write.parquet(rows)
    schema = spark.read.parquet(rows).schema
    ingest.upsert_stream(ingest.stream(spark, rows, schema), index, "k", ["v"], f"{tmp_path}/state", 4).awaitTermination()
    frame(spark, [(7, "torn")]).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(4)).cast("int")).write.partitionBy("bucket").parquet(f"{index}/batch=1")
    (tmp_path / "index/batch=1/_SUCCESS").unlink()
    assert {r.v for r in ingest.latest(spark, index, schema).collect()} == {"first"}
