"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import audio, dialogue_repair, hard_negatives, html_text, langid, line_dedup, mixing, packing, phrase_index, quality, sharding, simhash, token_files
from lectern.llm.scratch import stored
from lectern.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_steps(stored(packing.packed(_table(spark, sf_dir, "documents"))))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(audio.stored_audio(_table(spark, sf_dir, "documents")))
    return audio.expanded(media, with_pcm=False)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identified(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.counted(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pack": op2_pack,
    "op3_lines": op3_lines,
    "op4_audio": op4_audio,
    "op5_langid": op5_langid,
    "op6_shards": op6_shards,
    "op7_token_counts": op7_token_counts,
    "op8_main_text": op8_main_text,
    "op9_quality": op9_quality,
    "op10_mix": op10_mix,
    "op11_decontaminate": op11_decontaminate,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op9_quality": quality.ORACLE_SQL, "op11_decontaminate": phrase_index.ORACLE_SQL, "op12_dialogue_repair": dialogue_repair.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
