"""Documents to chunks: sections, references, sentence ends, packed paragraphs, labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFERENCES = re.compile(r"^\s*(#{1,4}\s*)?(\d+\.?\s*)?(references|bibliography|works cited|literature cited)\s*:?\s*$", re.I)
REFERENCE_HEADING = r"(?i)^\s*(#{1,4}\s*)?(\d+\.?\s*)?(references|bibliography|works cited|literature cited)\s*:?\s*$"
NUMBERED = re.compile(r"^\s*(\[\d+\]|\d+\.)\s+\S")
SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+")
#: Lines of a reference list without a heading: so many numbered lines, with at most this gap between them.
RUN, GAP = 3, 5
EXCLUDED_LABELS = ("reference", "page_header", "page_footer")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, heading, body: a text at its headings (# to ####, or a line in bold capitals); what precedes them is section 0."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    is_head = F.col("line").rlike(r"^#{1,4}\s+\S|^\*\*[\p{Lu}\p{N} .:-]+\*\*\s*$")
    order = Window.partitionBy(key).orderBy("no")
    numbered = lines.withColumn("head", is_head).withColumn("section", F.sum(is_head.cast("int")).over(order))
    name = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#{1,4}\s+", ""), r"\*\*", ""))
    parts = numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("head"), name)).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    return parts.where(F.length(F.trim("body")) > 0)


def before_references(text: str) -> str:
    """The text up to its reference list: a heading of that name, or RUN numbered lines with gaps of at most GAP; never beyond."""
    lines, run = text.split("\n"), []
    for i, line in enumerate(lines):
        if REFERENCES.match(line):
            return "\n".join(lines[:i])
        if NUMBERED.match(line):
            run = [*run, i] if run and i - run[-1] <= GAP else [i]
            if len(run) == RUN:
                return "\n".join(lines[: run[0]])
    return text


def whole_sentences(chunks: list[str]) -> list[str]:
    """Chunks that end at sentence ends: what follows a chunk's last one moves to the next; the last keeps all. No text is lost."""
    out, carried = [], ""
    for i, chunk in enumerate(chunks):
        text = f"{carried} {chunk}" if carried else chunk
        carried = ""
        if i < len(chunks) - 1 and not re.search(r"[.!?][\"')\]]*\s*$", text):
            ends = [m.end() for m in SENTENCE_END.finditer(text)]
            if ends:
                text, carried = text[: ends[-1]].rstrip(), text[ends[-1] :]
        out.append(text)
    return out


def paragraphs(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Paragraphs packed up to size characters, each chunk begun with the last one's tail; over-long ones are cut at sentences."""
    parts = []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        parts += [s for s in re.split(r"(?<=[.!?])\s+", p) if s] if len(p) > size else [p] if p else []
    out, now = [], ""
    for part in parts:
        if now and len(now) + len(part) + 2 > size:
            out.append(now)
            now = now[-overlap:] if overlap else ""
        now = f"{now}\n\n{part}" if now else part
    return [*out, now] if now else out


def applied(docs: DataFrame, key: str, text: str, split) -> DataFrame:
    """key, chunk_id, chunk: split, a plain function of one text to a list of texts, over a table in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(batch: pd.Series) -> pd.Series:
        return pd.Series([split(t) for t in batch.fillna("")])

    return docs.select(key, F.posexplode(cut(F.col(text))).alias("chunk_id", "chunk"))


def repaired(chunks: DataFrame, key: str = "item_key") -> DataFrame:
    """chunks (key, chunk_id, chunk) with whole_sentences() along each document, as a scan.

    What a chunk passes on depends on itself alone: the rest after its last sentence end, nothing if it ends a sentence,
    has no such end or is the last. So a chunk is what the one before passed on and itself without its own rest.
    """
    text, order = F.coalesce("chunk", F.lit("")), Window.partitionBy(key).orderBy("chunk_id")
    ended = text.rlike(r"[.!?][\"')\]]*\s*\z")
    last = F.lead(F.lit(1)).over(order).isNull()
    rest = F.when(ended | last, "").otherwise(F.regexp_extract(text, r"(?s)\A.*[.!?][\"')\]]*\s+(.*)\z", 1))
    rows = chunks.withColumn("__rest", rest).withColumn("__before", F.coalesce(F.lag("__rest").over(order), F.lit("")))
    own = F.when(F.col("__rest") == "", text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length("__rest")), r"\s+\z", ""))
    whole = F.when(F.col("__before") == "", own).otherwise(F.concat("__before", F.lit(" "), own))
    return rows.withColumn("chunk", whole).drop("__rest", "__before")


def without_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: before_references() as windows over lines; nulls stay.

    Numbered lines with gaps of at most GAP form islands; the first to reach RUN lines, or a heading if one comes before
    that line, ends the text, at the island's first line or at the heading.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    head, numbered = F.col("line").rlike(REFERENCE_HEADING), F.col("line").rlike(r"^\s*(\[\d+\]|\d+\.)\s+\S")
    order = Window.partitionBy(key).orderBy("no")
    apart = (F.col("no") - F.lag("no").over(order) > GAP).cast("int")
    islands = lines.where(numbered).withColumn("island", F.sum(F.coalesce(apart, F.lit(0))).over(order))
    inside = Window.partitionBy(key, "island").orderBy("no")
    runs = islands.withColumn("n", F.row_number().over(inside)).withColumn("first", F.first("no").over(inside)).where(F.col("n") == RUN)
    ends = runs.select(key, F.struct(F.col("no").alias("at"), F.col("first").alias("cut")).alias("end")).unionByName(lines.where(head).select(key, F.struct(F.col("no").alias("at"), F.col("no").alias("cut")).alias("end")))
    cuts = ends.groupBy(key).agg(F.min("end")["cut"].alias("__cut"))
    return docs.join(cuts, key, "left").select(*[F.col(c) for c in docs.columns if c != text], F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(F.slice(F.split(text, "\n"), F.lit(1), F.col("__cut")), "\n")).alias(text))


def paragraph_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk_id, chunk: paragraphs() as a fold along each text's parts."""
    trimmed = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")
    sentences = lambda p: F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: s != "")
    parts = F.flatten(F.transform(trimmed, lambda p: F.when(F.length(p) > size, sentences(p)).otherwise(F.array(p))))

    def packed(state: Column, part: Column) -> Column:
        now = state["now"]
        full = (now != "") & (F.length(now) + F.length(part) + 2 > size)
        kept = F.when(full, F.right(now, F.lit(overlap)) if overlap else F.lit("")).otherwise(now)
        return F.struct(F.when(full, F.concat(state["out"], F.array(now))).otherwise(state["out"]).alias("out"), F.when(kept == "", part).otherwise(F.concat(kept, F.lit("\n\n"), part)).alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
    chunks = F.aggregate(parts, start, packed, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))
    return docs.select(key, F.posexplode(chunks).alias("chunk_id", "chunk"))


def labelled_text(labels: Column) -> Column:
    """Whether a chunk has a label that is not excluded; chunks without labels stay."""
    return labels.isNull() | (F.size(labels) == 0) | (F.size(F.array_except(labels, F.array(*[F.lit(x) for x in EXCLUDED_LABELS]))) > 0)


def headings(chunks: DataFrame, key: str = "item_key") -> DataFrame:
    """chunks with the last heading seen at or before each."""
    order = Window.partitionBy(key).orderBy("chunk_id")
    return chunks.withColumn("heading", F.last("heading", ignorenulls=True).over(order))
