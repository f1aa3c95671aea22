"""Sparse vectors of terms: TF-IDF and BM25, fitted on the whole corpus, and searches over their postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import terms
from lectern.storage import small, stored

FEATURES = 10_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, features: int = FEATURES) -> DataFrame:
    """term, df, cf, idf of the most frequent terms (ties: the lower term); n_docs: one row, column n.

    idf is ln((1 + n) / (1 + df)) + 1.
    """
    sums = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = sums.orderBy(F.desc("cf"), "term").limit(features)
    return kept.crossJoin(F.broadcast(n_docs)).select("term", "df", "cf", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, term, weight: tf times idf of the terms in the vocabulary, whose FEATURES rows are broadcast."""
    return counts.join(F.broadcast(vocab.select("term", "idf")), "term").select("id", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))


@dataclass(frozen=True)
class Index:
    """Stored tables of a corpus: postings (id, term, tf) in order of term, so that a scan reads a request's terms only; lengths (id, dl); vocabulary()."""

    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame


def _held(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of asked's terms, a request's few, by a filter that reaches the scan."""
    return counts.where(F.col("term").isin([r.term for r in asked.select("term").collect()]))


def sparse_search(counts: DataFrame, vocab: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """id, score, rank: rows with the largest dot product with the query's (one row, column text) sparse vector."""
    asked = query.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))
    hits = _held(counts, asked).join(F.broadcast(asked.join(vocab.select("term", "idf"), "term")), "term")
    scores = hits.groupBy("id").agg(F.round(F.sum(F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf")), 4).alias("score"))
    return ranked(scores, "score", n)


def bm25_search(counts: DataFrame, query: DataFrame, n: int, k1: float = 1.2, b: float = 0.75, lengths: DataFrame | None = None) -> DataFrame:
    """id, score, rank by Okapi BM25 over the distinct query terms; every row with a term counts in the lengths (id, dl), summed up unless given."""
    lengths = counts.groupBy("id").agg(F.sum("tf").alias("dl")) if lengths is None else lengths
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = query.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    hits = _held(counts, asked)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = hits.join(F.broadcast(df), "term").join(lengths, "id").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return ranked(found.groupBy("id").agg(F.round(F.sum(part), 4).alias("score")), "score", n)


#: Distinct terms of a table of requests up to which the postings are filtered by their names, so that a scan skips the rest.
NAMED_TERMS = 1_000


def asked_terms(requests: DataFrame) -> DataFrame:
    """query, term, qtf of requests (query, text)."""
    return requests.select("query", F.explode(terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _met(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked's rows (stored) with the postings of their terms."""
    names = [r.term for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    rows = counts.where(F.col("term").isin(names)) if len(names) <= NAMED_TERMS else counts
    return rows.join(small(asked, asked.count(), 128), "term")


def ranked_by_query(scores: DataFrame, n: int) -> DataFrame:
    """The n best rows of each query (query, id, score) with a rank from 1; ties go to the lower id. Spark limits each query before it shuffles."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def sparse_searches(counts: DataFrame, vocab: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """query, id, score, rank: sparse_search() for a table of requests (query, text), in one plan."""
    asked = stored(asked_terms(requests).join(F.broadcast(vocab.select("term", "idf")), "term"))
    part = F.col("tf") * F.col("idf") * F.col("qtf") * F.col("idf")
    return ranked_by_query(_met(counts, asked).groupBy("query", "id").agg(F.round(F.sum(part), 4).alias("score")), n)


def bm25_searches(index: Index, requests: DataFrame, n: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, id, score, rank: bm25_search() for a table of requests (query, text), in one plan."""
    whole = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = asked_terms(requests).drop("qtf")
    distinct = stored(asked.select("term").distinct())
    df = _met(index.postings, distinct).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = stored(asked.join(df, "term"))
    found = _met(index.postings, asked).join(index.lengths, "id").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return ranked_by_query(found.groupBy("query", "id").agg(F.round(F.sum(part), 4).alias("score")), n)


def ranked(scores: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of id and a score with the largest score and a rank from 1; ties go to the lower id."""
    top = scores.orderBy(F.desc(by), "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")).cast("long"))
