"""Questions to the graph by mode, and all that is known of a paper at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import understanding as ask
from lectern.operators import graph, vector_index
from lectern.sources.catalog import Catalog

#: Modes that need a node to start from.
STARTED = ("related", "citation", "collaboration", "concept", "temporal", "content_similarity", "comprehensive")
MODES = (*STARTED, "influence", "venue")


def explored(c: Catalog, mode: str, start: object = None, hops: int = 2, n: int = 10, years: tuple[int, int] = (0, 9999), field: str | None = None) -> DataFrame:
    """strategy, id, score of one mode: related (papers by shared concepts), citation (by hops), influence (by citations),
    collaboration (people by shared papers), concept (concepts by shared papers), temporal (a concept's years, within a span, by
    papers), content_similarity (papers by their vectors), venue (of a field or all, by papers), or comprehensive, which joins the first three.

    A mode of STARTED without a start is refused.
    """
    if mode in STARTED and start is None:
        raise ValueError(f"{mode} needs a start")
    row = lambda df, score: df.select(F.lit(mode).alias("strategy"), "id", F.col(score).cast("double").alias("score"))
    if mode == "related":
        return row(graph.related(c.edges("DISCUSSES_CONCEPT"), start, n), "shared")
    if mode == "citation":
        return row(graph.chain(c.edges("CITES"), start, hops), "hops")
    if mode == "influence":
        return row(graph.in_degree(c.edges("CITES"), c.papers(), n).withColumnRenamed("paper", "id"), "citations")
    if mode in ("collaboration", "concept"):
        rel = "AUTHORED_BY" if mode == "collaboration" else "DISCUSSES_CONCEPT"
        return row(graph.neighbours(c.edges(rel), start, 1, n), "papers")
    if mode == "temporal":
        return row(graph.yearly(c.edges("DISCUSSES_CONCEPT"), c.papers(), start, *years).withColumnRenamed("year", "id"), "papers")
    if mode == "venue":
        return row(graph.venues(c.papers(), n, field).withColumnRenamed("venue", "id"), "papers")
    if mode == "content_similarity":
        return row(vector_index.nearest(c.vector_index(), c.vectors().where(F.col("id") == start), n, complete=True), "similarity")
    if mode != "comprehensive":
        raise ValueError(f"no mode {mode}")
    parts = [explored(c, m, start, hops, n) for m in ("related", "citation", "influence")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def answered(c: Catalog, request: str, start: object = None, n: int = 10) -> DataFrame:
    """explored() in the mode that a request asks for, within the years that it names; an exploratory one is comprehensive."""
    mode, _ = ask.intent(request, "graph")
    return explored(c, mode if mode in MODES else "comprehensive", start, n=n, years=ask.years(request) or (0, 9999))
