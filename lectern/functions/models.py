"""Models as stages: any embedder, reranker or extractor in Arrow batches, with offline stand-ins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Texts to vectors of one length; made once in each Python worker."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...

    def get_dimension(self) -> int: ...


class HashedEmbedder:
    """A stand-in for a model: signed, hashed counts of a text's words, scaled to length 1."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def get_dimension(self) -> int:
        return self.dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w{2,}", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class OverlapReranker:
    """A stand-in for a cross-encoder: the share of a query's words that a text has."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(re.findall(r"\w{2,}", t.lower()))
        return [len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs]


def embedded(text: Column, make: Callable[[], Embedder] = HashedEmbedder) -> Column:
    """array<float> of a text column; null texts are empty."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return embed(text)


def reranked(hits: DataFrame, query: str, text: str = "text", make: Callable[[], object] = OverlapReranker) -> DataFrame:
    """hits with a new rank by the model's score of (query, text); other columns, the fused score too, stay as they are."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model.predict([(query, t) for t in batch.fillna("")]), dtype="float64")

    found = hits.withColumn("__s", score(F.col(text))).withColumnRenamed("rank", "__was")
    order = Window.orderBy(F.desc("__s"), "__was")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).drop("__s", "__was")


def rule_entities(texts: list[str]) -> list[list[tuple[str, str]]]:
    """A stand-in for an extraction model: capitalised phrases as concepts, names with initials as people."""
    found = []
    for text in texts:
        people = set(re.findall(r"\b[A-Z]\. [A-Z][a-z]+", text))
        concepts = set(re.findall(r"(?<![.!?] )\b[A-Z][a-z]{3,}(?: [A-Z][a-z]+)*", text))
        found.append(sorted([(p, "Person") for p in people] + [(c, "Concept") for c in concepts]))
    return found


def extracted_entities(chunks: DataFrame, key: str, text: str, extract: Callable[[list[str]], list[list[tuple[str, str]]]] = rule_entities) -> DataFrame:
    """key, entity, label of each chunk: entities link only to the chunk they come from."""

    @F.pandas_udf("array<struct<entity: string, label: string>>")
    def find(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"entity": e, "label": kind} for e, kind in row] for row in extract(batch.fillna("").tolist())])

    return chunks.select(key, F.explode(find(F.col(text))).alias("e")).where("e.entity <> ''").select(key, "e.entity", "e.label")


def graph_input(chunks: DataFrame, most: int = 20) -> DataFrame:
    """item_key, text: an item's first chunks, each under its headings, for an extraction model."""
    head = F.when(F.size("headings") > 0, F.concat(F.lit("[Section: "), F.array_join("headings", " > "), F.lit("]\n"))).otherwise("")
    parts = chunks.where(F.col("chunk_id") < most).select("item_key", "chunk_id", F.concat(head, "chunk").alias("chunk"))
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", "chunk")))
    return parts.groupBy("item_key").agg(F.array_join(F.transform(listed, lambda p: p["chunk"]), "\n\n").alias("text"))
