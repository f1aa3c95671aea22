"""What batches of updates leave on disk."""

import os
import uuid

import pytest

from lectern import index_queries, storage
from lectern.sources.catalog import Catalog
from lectern.storage import files
from lectern.streaming import update

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def shared(tmp_path, monkeypatch):
    for module in (storage, index_queries):
        monkeypatch.setattr(module, "folder", lambda spark: f"file://{tmp_path}/shared/lectern-{uuid.uuid4().hex}")
    return tmp_path / "shared"


def left(path):
    return [f"{d}/{name}" for d, _, names in os.walk(path) for name in names if name.endswith(".parquet")]


def test_a_batch_leaves_its_library_only(spark, tmp_path, shared):
    """tables made on the way go, also when a batch fails; texts move and stay as before."""
    rows = lambda r: spark.createDataFrame(r, "item_key long, title string, body string, stamp long")
    library = update.Updates(spark, f"file://{tmp_path}/library", 2)
    assert library.apply(rows([(1, "T", "One Thing", 1), (2, "U", "two", 1), (2, "U", "twice", 2), (3, "V", " ", 1)])) == {"added": 2, "updated": 0, "skipped": 0, "failed": 1}
    assert library.apply(rows([(1, "T", "One Thing", 3), (2, "U", "later", 3), (2, "U", "early", 1)])) == {"added": 0, "updated": 1, "skipped": 1, "failed": 0}
    assert {r.item_key: r.body for r in library.store.read("items").collect()} == {1: "One Thing", 2: "later"}
    assert {(r.item_key, r.chunk) for r in library.store.read("chunks").collect()} == {(1, "One Thing"), (2, "later")}

    def broken(*_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        update.Updates(spark, f"file://{tmp_path}/library", 2, extract=broken).apply(rows([(7, "W", "half way", 1)]))
    assert left(shared) == [] and all(".zstd." in f for f, _, _ in files(spark, f"file://{tmp_path}/library/items"))
    sinks = index_queries.update_sinks(Catalog(spark, DATA))
    there = left(shared)
    assert there and {f.rsplit("/", 1)[0] for f in there} == {f.removeprefix("file://").rsplit("/", 1)[0] for f in sinks.inputFiles()} and sinks.count() > 0


def test_counters_leave_nothing(spark, shared):
    """F5"""
    assert index_queries.update_counters(Catalog(spark, DATA)).count() == 2
    assert left(shared) == []
