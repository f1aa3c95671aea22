"""Plans of searches: which backends a request needs, their lists in one plan, fusion, quality and escalation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import understanding as ask
from lectern.operators import fusion, hits, lexical, library, vector
from lectern.sources.catalog import Catalog
from lectern.storage import stored

#: Backends by intent or mode; graph is left out where the library has no graph.
BACKENDS = {
    "fast": ("semantic",), "semantic": ("semantic",), "entity": ("entity",), "relationship": ("semantic", "graph"),
    "metadata": ("semantic", "metadata"), "comprehensive": ("semantic", "graph", "metadata"),
}
ALL = ("semantic", "graph", "metadata")
#: Weights of the backends' lists by intent, for weighted fusion.
WEIGHTS = {"relationship": {"graph": 1.5, "semantic": 1.0, "metadata": 0.5}, "metadata": {"metadata": 1.5, "semantic": 1.0, "graph": 0.5}, "semantic": {"semantic": 1.5, "graph": 0.8, "metadata": 0.5}}


@dataclass(frozen=True)
class Search:
    """Searches over one catalog. A request is text; its dense vector is that of a stored row, `seed`, if given."""

    catalog: Catalog

    def backend(self, name: str, text: str, seed: int | None, n: int) -> DataFrame:
        """list, id, score, rank of one backend."""
        c, spark = self.catalog, self.catalog.spark
        if name == "semantic" and seed is not None:
            rows = c.vectors()
            found = vector.nearest(rows, rows.where(F.col("id") == seed), n).select("id", F.col("similarity").alias("score"), "rank")
        elif name in ("semantic", "entity"):
            index = c.lexical_index()
            found = lexical.sparse_search(index.postings, index.vocabulary, spark.createDataFrame([(text,)], "text string"), n)
        elif name == "graph":
            index = c.lexical_index("part", "p_partkey", "p_name")
            named = lexical.bm25_search(index.postings, spark.createDataFrame([(text,)], "text string"), n, lengths=index.lengths).select(F.col("id").alias("dst"), "score")
            papers = c.edges("DISCUSSES_CONCEPT").join(F.broadcast(named), "dst").groupBy(F.col("src").alias("id"))
            found = lexical.ranked(papers.agg(F.round(F.sum("score"), 4).alias("score")), "score", n)
        else:
            words = sorted(text.split(), key=len)[-1:] or [""]
            found = library.searched(c.items(), words[0], ["title", "author", "date"], n).select(F.col("item_key").alias("id"), F.lit(1.0).alias("score"))
            found = lexical.ranked(found, "score", n)
        return found.select(F.lit(name).alias("list"), "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))

    def lists(self, names: tuple[str, ...], text: str, seed: int | None, n: int) -> DataFrame:
        rows = [self.backend(name, text, seed, n) for name in names]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    def smart(self, text: str, seed: int | None = None, limit: int = 10, mode: str | None = None, weighted: bool = False) -> DataFrame:
        """id, score, rank, found_in: backends by mode or intent, fused by reciprocal rank.

        The fused lists are stored and their quality read, one row; if it is low, the backends not yet asked are
        asked too and all lists are fused again.
        """
        intent, _ = ask.intent(text)
        names = BACKENDS[mode or intent]
        asked = ask.expand_by_quality(text)
        rows = stored(self.lists(names, asked, seed, 2 * limit))
        weights = WEIGHTS.get(intent) if weighted else None
        quality = hits.coverage_quality(rows).first()
        rest = tuple(name for name in ALL if name not in names)
        if quality.escalate and rest and mode is None:
            rows = stored(rows.unionByName(self.lists(rest, asked, seed, 2 * limit)))
        return fusion.rrf(rows, limit, list_weights=weights)

    def full(self, text: str, seed: int | None = None, limit: int = 10) -> DataFrame:
        """item_key, score, rank, backends, n_backends, title, publication, confidence, coverage of one request: a search as a whole.

        A request of several parts has these searched apart and merged, beside what the backends of its intent find; lists
        are fused by reciprocal rank, each hit with the lists it came from and its item. Confidence and coverage are
        those of the parts' or the text's own list; low confidence asks the backends that are left.
        """
        intent, _ = ask.intent(text)
        names = BACKENDS[intent]
        if len(ask.decompose(text)) > 1:
            found = self.decomposed(text, 2 * limit)
            own = found.select(F.lit("decomposed").alias("list"), "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))
        else:
            own = self.backend("semantic", ask.expand_by_quality(text), seed, 2 * limit)
        own = stored(own)
        quality = hits.coverage_quality(own)
        asked = ALL if quality.first().escalate else names
        others = [n for n in asked if n != "semantic"]
        rows = stored(own.unionByName(self.lists(tuple(others), text, seed, 2 * limit)) if others else own)
        fused = fusion.rrf(rows, limit).drop("found_in").join(hits.provenance(rows), "id").withColumnRenamed("id", "item_key")
        told = fused.crossJoin(F.broadcast(quality.select("confidence", "coverage")))
        return hits.enriched(told, self.catalog.items().select("item_key", "title", "publication"))

    def _sparse(self, requests: DataFrame, n: int) -> DataFrame:
        index = self.catalog.lexical_index()
        return lexical.sparse_searches(index.postings, index.vocabulary, requests, n)

    def _one(self, text: str) -> DataFrame:
        return self.catalog.spark.createDataFrame([(0, text)], "query int, text string")

    def decomposed(self, text: str, limit: int = 10) -> DataFrame:
        """id, score, rank: the parts of a request searched apart, never taken apart again, and merged."""
        return self.decomposed_table(self._one(text), limit).drop("query")

    def decomposed_table(self, requests: DataFrame, limit: int = 10) -> DataFrame:
        """query, id, score, rank of a table of requests (query, text): all parts of all requests in one plan."""
        parts = requests.select("query", F.posexplode(ask.decompose_column(F.col("text"))).alias("part", "p"))
        parts = stored(parts.select(F.struct("query", "part").alias("query"), "p.text", "p.importance"))
        found = self._sparse(parts.select("query", "text"), 2 * limit).join(parts.select("query", "importance"), "query")
        return fusion.decomposed_by_query(found.withColumn("query", F.col("query.query")), limit)

    def iterative(self, text: str, limit: int = 10, rounds: int = 2) -> DataFrame:
        """id, score, rank: a weak result is joined by those of reformulated requests, new ids only, by score."""
        return self.iterative_table(self._one(text), limit, rounds).drop("query")

    def iterative_table(self, requests: DataFrame, limit: int = 10, rounds: int = 2) -> DataFrame:
        """query, id, score, rank of a table of requests (query, text).

        A round takes the requests whose results are weak, all at once: concepts of their three best rows, their forms,
        and the rows of these that a request does not have yet. The number of plans is that of the rounds.
        """
        rows = stored(self._sparse(requests, 2 * limit))
        docs = self.catalog.table("documents").select(F.col("doc_id").alias("id"), "text")
        for _ in range(rounds):
            weak = hits.weak_queries(requests, rows)
            top = rows.where("rank <= 3").join(weak.select("query"), "query", "left_semi").select("query", "id")
            concepts = ask.key_concepts_by_query(docs.join(top, "id"), "text")
            asked = weak.join(concepts, "query", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
            forms = asked.select("query", F.posexplode(ask.reformulate_column(F.col("text"), F.col("concepts"))).alias("form", "text"))
            forms = stored(forms.select(F.struct("query", "form").alias("query"), "text"))
            if forms.isEmpty():
                break
            found = self._sparse(forms, limit).withColumn("form", F.col("query.form")).withColumn("query", F.col("query.query"))
            fresh = found.join(rows.select("query", "id"), ["query", "id"], "left_anti")
            best = fresh.groupBy("query", "id").agg(F.min_by("score", F.struct("rank", "form")).alias("score"), F.min("rank").alias("rank"))
            rows = stored(rows.unionByName(best))
        return lexical.ranked_by_query(rows.select("query", "id", "score"), limit)
