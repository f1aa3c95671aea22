"""Files as tables: plain text, binary content with its MD5, attachments, parsed documents, annotations, TEI."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: JSON of an annotation as extraction tools write it.
ANNOTATION = "struct<key: string, type: string, text: string, comment: string, color: string, page: int>"


def plain(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files; bytes that are no UTF-8 are replaced."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, md5."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.md5("content").alias("md5"))


def attachment_choice(files: DataFrame, parent: str = "parent") -> DataFrame:
    """One file per parent: of the wanted name, else a .pdf, else a PDF by its first bytes, else any; by path."""
    order = F.when(F.col("path").endswith(F.col("wanted")), 0).when(F.lower("path").endswith(".pdf"), 1).when(F.substring("content", 1, 4) == F.lit(b"%PDF"), 2).otherwise(3)
    best = Window.partitionBy(parent).orderBy(order, "path")
    return files.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def parsed(files: DataFrame, parse: Callable[[bytes], list[tuple[str, list[str]]]], cache: DataFrame | None = None) -> DataFrame:
    """path, md5, chunk_id, chunk, labels of files (path, content, md5) by a parser of one file's bytes.

    Files whose MD5 the cache (such a result, stored) has are taken from it. A file that the parser fails on has one
    row with a null chunk and the error as its label, so that one bad file costs no other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, md5 in batch[["path", "content", "md5"]].itertuples(index=False):
                try:
                    rows += [(path, md5, i, text, labels) for i, (text, labels) in enumerate(parse(content))]
                except Exception as error:  # noqa: BLE001  any parser, any error
                    rows.append((path, md5, 0, None, [f"error: {error}"]))
            yield pd.DataFrame(rows, columns=["path", "md5", "chunk_id", "chunk", "labels"])

    schema = "path string, md5 string, chunk_id int, chunk string, labels array<string>"
    fresh = files if cache is None else files.join(cache.select("md5").distinct(), "md5", "left_anti")
    out = fresh.select("path", "content", "md5").mapInPandas(run, schema)
    return out if cache is None else out.unionByName(cache.join(files.select("md5").distinct(), "md5", "left_semi"))


def annotations(lines: DataFrame, json: str = "value") -> DataFrame:
    """Annotations of a JSON column; rows that are no such JSON go."""
    return lines.select(F.from_json(json, ANNOTATION).alias("a")).where("a.key IS NOT NULL").select("a.*")


#: Levels of nested TEI sections that are told apart; deeper ones are paragraphs of the last.
TEI_DEPTH = 6


def _tei_schema(depth: int) -> str:
    """Of a list of divs; markup inside headings and paragraphs is kept as text."""
    inner = "array<string>" if depth == 1 else _tei_schema(depth - 1)
    return f"array<struct<_type: string, _coords: string, head: array<string>, p: array<string>, div: {inner}>>"


def tei_sections(docs: DataFrame, key: str, xml: str, depth: int = TEI_DEPTH) -> DataFrame:
    """key, section, part, type, heading, paragraphs, coords, is_reference of TEI documents, one row a section, in document order (a section before those in it).

    The document is read by a nested schema, so that a heading, its paragraphs and its attributes stay together: a missing
    heading is an empty one, a missing type is "unknown". References are sections of that type in the body, and all of the
    back matter. Documents that are no TEI have no rows.
    """
    divs = _tei_schema(depth)
    read = F.from_xml(F.col(xml), f"text struct<body: struct<div: {divs}>, back: struct<div: {divs}>>", {"mode": "PERMISSIVE"})
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", ""), r"\s+", " "), "&amp;", "&"))
    texts = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), plain), lambda p: p != "")

    def listed(found: Column, level: int) -> Column:
        def one(d: Column) -> Column:
            deep = texts(d["div"]) if level == 1 else F.array().cast("array<string>")
            own = F.struct(F.coalesce(d["_type"], F.lit("unknown")).alias("type"), F.coalesce(F.get(texts(d["head"]), 0), F.lit("")).alias("heading"), F.concat(texts(d["p"]), deep).alias("paragraphs"), F.coalesce(d["_coords"], F.lit("")).alias("coords"))
            return F.array(own) if level == 1 else F.concat(F.array(own), listed(d["div"], level - 1))

        empty = F.array().cast("array<struct<type: string, heading: string, paragraphs: array<string>, coords: string>>")
        return F.coalesce(F.flatten(F.transform(found, one)), empty)

    def parted(part: str) -> Column:
        made = lambda s: F.struct(F.lit(part).alias("part"), *[s[c].alias(c) for c in ("type", "heading", "paragraphs", "coords")], ((s["type"] == "references") | F.lit(part == "back")).alias("is_reference"))
        return F.transform(listed(F.col(f"__tei.text.{part}.div"), depth), made)

    parts = parted("body"), parted("back")
    rows = docs.select(key, read.alias("__tei")).select(key, F.posexplode(F.concat(*parts)).alias("section", "s"))
    return rows.select(key, "section", "s.*")


#: One link of a chain: name, parser of a file's bytes, characters from which its text is enough.
Link = tuple[str, Callable[[bytes], str], int]


def chained(files: DataFrame, links: list[Link], forced: str | None = None) -> DataFrame:
    """path, parser, text, chars, tried of files (path, content): parsers in order, in tasks, until one gives enough text.

    A file whose text is short, or that a parser fails on, goes on to the next; if none is enough the last text that a
    parser gave counts, and a file that all fail on has a null text and parser. tried lists each parser that ran with the
    characters it gave or its error. forced runs one parser alone; a name that the chain lacks is refused.
    """
    if forced is not None and forced not in [name for name, _, _ in links]:
        raise ValueError(f"no parser {forced}")
    chain = [link for link in links if forced in (None, link[0])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch[["path", "content"]].itertuples(index=False):
                name = text = None
                tried = []
                for link, parse, least in chain:
                    try:
                        got = parse(content)
                    except Exception as error:  # noqa: BLE001  any parser, any error
                        tried.append({"parser": link, "chars": None, "error": f"{type(error).__name__}: {error}"})
                        continue
                    chars = len(got.strip())
                    tried.append({"parser": link, "chars": chars, "error": None})
                    name, text = link, got
                    if chars >= least:
                        break
                rows.append((path, name, text, len(text.strip()) if text is not None else None, tried))
            out = pd.DataFrame(rows, columns=["path", "parser", "text", "chars", "tried"])
            yield out.astype({"chars": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, parser string, text string, chars long, tried array<struct<parser: string, chars: long, error: string>>")
