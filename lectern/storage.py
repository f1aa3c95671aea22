"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lectern-")


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a local master uses a temporary folder, and a cluster is refused: its executors share none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or _own_folder()).rstrip('/')}/lectern-{uuid.uuid4().hex}"


#: How tables of texts are written: small, and in row groups that several tasks can share where one task wrote them.
TEXTS = {"compression": "zstd", "parquet.block.size": 8 << 20}


def stored(df: DataFrame, **options: object) -> DataFrame:
    """df, written to shared storage and read back: a lost executor costs no recomputation of what led here."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that is sent whole to every executor, at most.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df marked for broadcast if its counted rows, of so many bytes each, are within BROADCAST_BYTES; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ms) of the data files under path, in order; none if there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    found, out = system.listFiles(at, True), []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def version(spark: SparkSession, *paths: str) -> str:
    """What tells these tables' present contents from earlier ones: a hash of their files' names, sizes and times."""
    return hashlib.md5(repr([files(spark, p) for p in paths]).encode()).hexdigest()


_kept: dict[tuple[str, str], list[tuple[str, str, StructType]]] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def kept(spark: SparkSession, name: str, made_of: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The table `name` of this application, made and stored by the first who asks for this version of its input, and partitioned by some columns.

    made_of is the input's version(): another one makes the table anew. The one before stays for plans that still read it, older ones go.
    """
    held = _kept.setdefault((spark.sparkContext.applicationId, name), [])
    found = next(((path, schema) for made, path, schema in held if made == made_of and _exists(spark, path)), None)
    if found is None:
        rows, path = make(), folder(spark)
        rows.write.partitionBy(*by).parquet(path)
        found = path, rows.schema
        held.append((made_of, *found))
        for _, old, _ in held[:-2]:
            remove(spark, old)
        del held[:-2]
    return spark.read.schema(found[1]).parquet(found[0])


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stored() whose tables are deleted at the end."""
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(stored(df, **TEXTS))
        return made[-1]

    try:
        yield keep
    finally:
        for df in made:
            discard(df)


def released(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark deletes the shuffle files of plans that are gone; by itself it does so every half hour, or when its heap is full."""
    spark._jvm.System.gc()
