"""A corpus from raw documents to packed sequences: five stages, each stored before the next one reads it.

STAGES names them in order. Each takes (spark, docs, sf_dir), docs being what its predecessor returned as
Parquet, and works on all of it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langid, line_dedup, mixing, near_copies, packing
from lectern.llm.scratch import small, stored
from lectern.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressor tells; those without letters or a margin go."""
    ship(spark)
    model = langid.fit(docs)
    found = docs.withColumn("__language", langid.language_of(F.col("text"), model))
    return found.where(~F.col("__language.rejected")).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; n_chars is that of the text that is left."""
    ship(spark)
    found = line_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard 0.8 of five-word shingles) the row with the least doc_id; rows that repeat an id are rows of their own."""
    ship(spark)
    return near_copies.without_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: part files and the rows in them follow it.

    Rows get their slots by the file and place they are read from, without their texts, which then move once.
    """
    ship(spark)
    at = {"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    slots = mixing.mixed(docs.select("doc_id", "text", "source", *[c.alias(n) for n, c in at.items()]), keep=tuple(at))
    slots = slots.select("slot", "block_row", *[F.col(f"keep_{n}").alias(n) for n in at])
    placed = docs.select(*docs.columns, *[c.alias(n) for n, c in at.items()]).join(small(slots, docs.count(), 64), list(at))
    ordered = placed.withColumnsRenamed({c: f"__{c}" for c in docs.columns}).repartitionByRange("slot", "block_row").sortWithinPartitions("slot", "block_row")
    return ordered.select(*[F.col(f"__{c}").alias(c) for c in docs.columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into windows in the order of the mix: sequence_id follows files and the rows in them.

    Spark deals file splits to tasks by size, so rows are dealt anew by the file they stand in and their place there.
    """
    ship(spark)
    at = ["__file", "__row"]
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    pieces = packing.packed(placed.repartitionByRange(*at).sortWithinPartitions(*at), group_tokens=packing.STEP_TOKENS, in_order=True)
    return packing.with_steps(stored(pieces))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Compression, MinHash, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
