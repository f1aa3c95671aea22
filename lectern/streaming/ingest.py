"""Incremental ingest as a stream: files to keyed upserts of an index in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.indexing import last_rows

#: Buckets of an index: a batch rewrites those it has keys of.
BUCKETS = 32


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files under path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _versions(spark: SparkSession, index: str) -> dict[int, list[int]]:
    """The complete batches that wrote each bucket, in order. A batch is complete when its job has left its marker: one that is being written, or failed half way, is not read."""
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{name}")
    system = at("").getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda name: [status.getPath().toString() for status in system.globStatus(at(name)) or []]
    complete = {path.rsplit("/", 2)[1] for path in listed("batch=*/_SUCCESS")}
    found: dict[int, list[int]] = {}
    for path in listed("batch=*/bucket=*"):
        name, bucket = path.rsplit("/", 2)[1:]
        if name in complete:
            found.setdefault(int(bucket.rpartition("=")[2]), []).append(int(name.rpartition("=")[2]))
    return {bucket: sorted(batches) for bucket, batches in found.items()}


def _read(spark: SparkSession, index: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{index}/batch={n}/bucket={b}" for b, n in versions.items()])


def upsert_stream(rows: DataFrame, index: str, key: str, order: list[str], state: str, buckets: int = BUCKETS):
    """Start a query that merges each micro-batch into the index under `index`; the last row of a key by order stays,
    whether it came early or late.

    Keys are dealt to buckets by hash. A batch reads the newest earlier version of the buckets it has keys of, and
    writes these alone as batch=<n>/bucket=<b>, so its work grows with what it touches. A repeated batch reads and writes
    the same versions again, so results are exactly-once. Two versions of a bucket stay, for that; older ones go.
    Read the index with latest().
    """
    schema = rows.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]
        before = {b: [n for n in batches if n < number] for b, batches in _versions(spark, index).items() if b in touched}
        held = {b: batches[-1] for b, batches in before.items() if batches}
        now = dealt.drop("bucket")
        now = now.unionByName(_read(spark, index, held, schema)) if held else now
        now = last_rows(now, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        now.write.partitionBy("bucket").mode("overwrite").parquet(f"{index}/batch={number}")
        dealt.unpersist()
        for b, batches in before.items():
            for n in batches[:-1]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/batch={n}/bucket={b}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest(spark: SparkSession, index: str, schema: StructType) -> DataFrame:
    """The newest version of each bucket of an index."""
    versions = {b: batches[-1] for b, batches in _versions(spark, index).items()}
    return _read(spark, index, versions, schema) if versions else spark.createDataFrame([], schema)


def upserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, the table arriving as four files in two micro-batches; equal to one batch over it."""
    from lectern.storage import folder

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = folder(spark)
    events.repartition(4, "event_id").write.parquet(f"{root}/arrived")
    rows = stream(spark, f"{root}/arrived", events.schema, 2)
    upsert_stream(rows, f"{root}/index", "user_id", ["ts", "event_id"], f"{root}/state").awaitTermination()
    return latest(spark, f"{root}/index", events.schema).select("user_id", "event_id", "event_type", "value")
