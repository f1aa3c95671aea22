"""Token counts of flat, unindexed token files: a vectorised scan for separators, stitched by a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.scratch import folder, stored
from lectern.llm.tokens import WORD_BPE, word_tokens

#: <|endoftext|> of the vocabulary; strings like it in a text stay ordinary text.
SEPARATOR = 49_407
ITEM = 2  # bytes of an id
#: Bytes of a file that are scanned together, and blocks of a task.
BLOCK_BYTES, TASK_BLOCKS = 4 << 20, 8


def written(docs: DataFrame, to: str, path: str = WORD_BPE, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each input partition's documents to one flat file of 16-bit ids under the URI `to`; the manifest.

    Each document's ids are followed by separator. The manifest has doc_id, file and ordinal (place in the file,
    from 0). A file appears under its name when it is whole, so a repeated task replaces it by an equal one. The
    store needs a pyarrow file system (file, hdfs, s3, gs, abfss). Null texts are empty; extra columns are left
    out; repeated rows are written again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, task = word_tokens(path, literal=True), np.uint16(separator).tobytes(), TaskContext.get()
        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        name = f"tokens-{task.partitionId():06d}.bin"
        part = f"{root}/.{name}.{task.taskAttemptId()}"
        ordinal = 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for ids in tokens.of_texts(batch.column(1)):
                    out.write(ids.tobytes())
                    out.write(end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64())], ["doc_id", "file", "ordinal"])
                ordinal += n
        store.move(part, f"{root}/{name}")

    schema = T.StructType([T.StructField("doc_id", rows.schema[0].dataType), T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType())])
    return rows.mapInArrow(write, schema)


def scanned(spark: SparkSession, at: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens, ended of every document in the flat token files under the URI `at`.

    start is the document's first id in its file, n_tokens its ids without the separator. Ids after a file's last
    separator are a document that has not ended; an empty file has none. Blocks are scanned apart: each yields the
    places of its separators. A running count and maximum over a file's blocks, of one row each, then give each
    separator its number and its predecessor, wherever that lies.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(at).select("path", "length").where("length > 0")
    spans = files.select("path", (F.col("length") / ITEM).cast("long").alias("ids"), F.explode(F.expr(f"sequence(0L, (length - 1) div {block_bytes})")).alias("block"))
    parts = max(1, -(-spans.count() // TASK_BLOCKS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        for batch in batches:
            for path, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path.rpartition('/')[2]}") as file:
                    ids = np.frombuffer(file.read_at(block_bytes, block * block_bytes), "<u2")
                places = np.flatnonzero(ids == separator) + block * (block_bytes // ITEM)
                n = len(places)
                columns = [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(places, pa.int64()), pa.array(np.append(-1, places)[:n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "block", "rank", "place", "before"])

    dealt = spans.repartition(parts, "path", "block")
    ends = stored(dealt.mapInArrow(scan, "path string, block long, rank long, place long, before long"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ends.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    sums = sums.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("prior"))
    found = ends.join(sums, ["path", "block"])
    start = F.when(F.col("rank") == 0, F.col("prior")).otherwise(F.col("before")) + 1
    name = F.substring_index("path", "/", -1).alias("file")
    whole = found.select(name, (F.col("ahead") + F.col("rank")).alias("ordinal"), start.alias("start"), (F.col("place") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    closed = ends.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    rest = files.select("path", (F.col("length") / ITEM).cast("long").alias("ids")).join(closed, "path", "left")
    first = F.coalesce(F.col("last") + 1, F.lit(0))
    rest = rest.where(first < F.col("ids")).select(name, F.coalesce("n", F.lit(0)).alias("ordinal"), first.alias("start"), (F.col("ids") - first).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def counted(docs: DataFrame, path: str = WORD_BPE, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens: documents written to flat files, whose scan gives the counts."""
    spark = docs.sparkSession
    at = folder(spark)
    manifest = stored(written(docs, at, path, separator, id_col, text_col))
    if manifest.isEmpty():
        return manifest.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    return manifest.join(scanned(spark, at, separator), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
