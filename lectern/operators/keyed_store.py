"""Keyed tables in shared storage that change together: buckets, versions, one commit for all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.storage import TEXTS, files, remove

#: Buckets that a table's keys are dealt to; a change rewrites those it touches.
BUCKETS = 64


class KeyedStore:
    """Tables under root, each of rows with a key (one or several columns). One writer at a time.

    tables: name to (schema, key columns). A version is one row of JSON under root/versions, written last: for every
    table the folder that holds each bucket. Readers take the newest complete version of all tables, so that a
    batch that fails half way changes none of them.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, tuple[str, ...]]], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.tables, self.buckets = spark, root, tables, buckets

    def version(self) -> dict:
        """number, tables (bucket to the number that wrote it, by name) and counters of the newest complete version."""
        done = [name for name, _, _ in files(self.spark, f"{self.root}/versions") if "/part-" in name]
        numbers = [int(name.rpartition("/n=")[2].partition("/")[0]) for name in done]
        if not numbers:
            return {"number": -1, "tables": {name: {} for name in self.tables}, "counters": {}}
        return json.loads(self.spark.read.text(f"{self.root}/versions/n={max(numbers)}").first()[0])

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None, version: dict | None = None) -> DataFrame:
        """A table's rows, or those of some buckets."""
        schema, held = self.tables[name][0], (version or self.version())["tables"][name]
        paths = [f"{self.root}/{name}/n={n}/bucket={b}" for b, n in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self, number: int | None = None) -> Batch | None:
        """A batch of changes; None if one of this number is complete already, as when a stream repeats it."""
        before = self.version()
        number = before["number"] + 1 if number is None else number
        return Batch(self, before, number) if number > before["number"] else None


class Batch:
    """Changes of several tables that commit() makes visible at once."""

    def __init__(self, store: KeyedStore, before: dict, number: int) -> None:
        self.store, self.before, self.number = store, before, number
        self.tables = {name: dict(held) for name, held in before["tables"].items()}

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of some keys; as many as the table has at most."""
        return [r.bucket for r in keys.select(self.store.bucket(name).alias("bucket")).distinct().collect()]

    def put(self, name: str, rows: DataFrame) -> None:
        """Rows in place of those with their keys."""
        self.replace(name, rows.select(*self.store.tables[name][1]), rows)

    def replace(self, name: str, keys: DataFrame, rows: DataFrame) -> None:
        """rows in place of those with one of keys; a key may have several rows.

        keys and rows are read several times: stored tables or plain scans. Only their buckets are read and written, and
        rows move once: what goes is told by marks of the keys beside the rows in their bucket. Null keys replace nothing.
        """
        schema, key = self.store.tables[name]
        columns = list(self.store.spark.createDataFrame([], schema).columns)
        touched = sorted({*self.touched(name, keys), *self.touched(name, rows)})
        if not touched:
            return
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.store.spark.createDataFrame([], schema).schema if f.name not in key]
        old = self.store.read(name, touched, self.before).select(*columns, F.lit(0).alias("__kind"))
        marks = keys.select(*key).dropna().distinct().select(*key, *none, F.lit(1).alias("__kind")).select(*columns, "__kind")
        dealt = old.unionByName(marks).unionByName(rows.select(*columns, F.lit(2).alias("__kind"))).withColumn("bucket", self.store.bucket(name)).repartition("bucket")
        gone = F.max(F.col("__kind") == 1).over(Window.partitionBy("bucket", *key).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        now = dealt.withColumn("__gone", gone).where("__kind = 2 OR (__kind = 0 AND NOT __gone)").drop("__kind", "__gone")
        now.sortWithinPartitions("bucket", *key).write.partitionBy("bucket").mode("overwrite").options(**TEXTS).parquet(f"{self.store.root}/{name}/n={self.number}")
        written = {int(f.rpartition("/bucket=")[2].partition("/")[0]) for f, _, _ in files(self.store.spark, f"{self.store.root}/{name}/n={self.number}")}
        for b in touched:
            self.tables[name].pop(str(b), None)
            if b in written:
                self.tables[name][str(b)] = self.number

    def commit(self, **counters: object) -> None:
        """Make the batch the newest version; folders that neither it nor the one before needs are removed."""
        version = {"number": self.number, "tables": self.tables, "counters": counters}
        spark, root = self.store.spark, self.store.root
        spark.createDataFrame([(json.dumps(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/versions/n={self.number}")
        for name in self.tables:
            needed = {(str(b), n) for held in (self.tables, self.before["tables"]) for b, n in held[name].items()}
            there = {f.rpartition("/")[0] for f, _, _ in files(spark, f"{root}/{name}")}
            for path in there:
                number, bucket = (part.rpartition("=")[2] for part in path.rsplit("/", 2)[1:])
                if (bucket, int(number)) not in needed:
                    remove(spark, path)
