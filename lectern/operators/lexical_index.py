"""A lexical index that follows its table: postings in segments, with dead ids, merged when there are many."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import terms
from lectern.operators.indexing import last_rows
from lectern.operators.lexical import FEATURES, Index
from lectern.storage import files, folder, remove, small, stored

#: Segments from which an update merges them all into one.
MOST_SEGMENTS = 8
#: What a segment holds: postings in order of term; rows with their length, a digest of their text and their terms; which file each row read stands in; ids whose earlier entries are void; signed changes of the terms' counts.
TABLES = {
    "postings": "id {id}, term string, tf long", "rows": "id {id}, dl long, digest string, terms array<struct<term: string, tf: long>>",
    "places": "id {id}, file string", "dead": "id {id}", "counts": "term string, df long, cf long",
}


@dataclass(frozen=True)
class Change:
    """What an update did: rows tokenized that were new or changed, rows gone, files read."""

    added: int
    changed: int
    removed: int
    files_read: int


class LexicalIndex:
    """An index under `root` of the Parquet table at a path, whose rows have an id and a text. One writer at a time.

    A version is a row in root/versions, written last: the segments it consists of and the files it has seen. A reader
    takes the newest complete one, so an update that failed half way changes nothing. Files are told apart by name, size
    and time: only new ones are read, only rows whose text has changed are tokenized, and rows of files that are gone
    and stand in no new file die. Of rows that share an id the one with the greatest digest counts; rows without an id
    are left out, null texts are empty.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str, text_col: str, id_type: str = "bigint") -> None:
        self.spark, self.root, self.id_col, self.text_col, self.id_type = spark, root, id_col, text_col, id_type

    def version(self) -> dict:
        """number, segments, dead (ids by segment) and files of the newest complete version."""
        done = [name for name, _, _ in files(self.spark, f"{self.root}/versions") if "/part-" in name]
        numbers = [int(name.rpartition("/n=")[2].partition("/")[0]) for name in done]
        if not numbers:
            return {"number": 0, "segments": [], "dead": {}, "files": []}
        return json.loads(self.spark.read.text(f"{self.root}/versions/n={max(numbers)}").first()[0])

    def _commit(self, version: dict) -> None:
        self.spark.createDataFrame([(json.dumps(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/versions/n={version['number']}")

    def _table(self, segment: int, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name].format(id=self.id_type)).parquet(f"{self.root}/segment={segment}/{name}")

    def _write(self, segment: int, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/segment={segment}/{name}")

    def _live(self, name: str, version: dict) -> DataFrame:
        """Rows of a table of all segments that no later segment has made void."""
        parts, segments = [], version["segments"]
        for i, segment in enumerate(segments):
            rows, later = self._table(segment, name), [s for s in segments[i + 1 :] if version["dead"][str(s)]]
            if later:
                dead = reduce(DataFrame.union, [self._table(s, "dead") for s in later]).distinct()
                rows = rows.join(small(dead, sum(version["dead"][str(s)] for s in later), 64), "id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], TABLES[name].format(id=self.id_type))

    def postings(self) -> DataFrame:
        """id, term, tf; a filter on term reaches each segment's scan."""
        return self._live("postings", self.version())

    def lengths(self) -> DataFrame:
        """id, dl of every row, also of rows without a term."""
        return self._live("rows", self.version()).select("id", "dl")

    def counts(self) -> DataFrame:
        """term, df, cf, kept up by adding the segments' changes."""
        version = self.version()
        parts = [self._table(s, "counts") for s in version["segments"]] or [self.spark.createDataFrame([], TABLES["counts"])]
        return reduce(DataFrame.union, parts).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def vocabulary(self, features: int = FEATURES) -> DataFrame:
        """term, df, cf, idf of the most frequent terms, as lexical.vocabulary() has them."""
        n = self.lengths().agg(F.count(F.lit(1)).alias("n"))
        top = self.counts().orderBy(F.desc("cf"), "term").limit(features)
        return top.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6).alias("idf"))

    def index(self) -> Index:
        return Index(self.postings(), self.lengths().where("dl > 0"), self.vocabulary())

    def update(self, path: str) -> Change:
        """Bring the index up to the table's present files."""
        before, now = self.version(), files(self.spark, path)
        seen = {tuple(f) for f in before["files"]}
        fresh = [f[0] for f in now if f not in seen]
        gone = [f[0] for f in seen - set(now)]
        if not fresh and not gone:
            return Change(0, 0, 0, 0)
        segment = before["number"] + 1
        known = self._live("rows", before)
        read = self.spark.createDataFrame([], f"id {self.id_type}, text string, file string")
        if fresh:
            table = self.spark.read.parquet(*fresh)
            read = table.select(F.col(self.id_col).cast(self.id_type).alias("id"), F.coalesce(F.col(self.text_col), F.lit("")).alias("text"), F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/").alias("file")).where("id IS NOT NULL")
        read = read.withColumn("digest", F.md5(F.col("text").cast("binary")))
        placed = stored(last_rows(read.select("id", "digest", "file"), "id", ["digest", "file"]))
        was = known.select("id", F.col("digest").alias("__was"))
        differing = stored(placed.join(was, "id", "left").where(~F.col("digest").eqNullSafe(F.col("__was"))).select("id", "digest", F.col("__was").isNotNull().alias("known")))
        lost = self.spark.createDataFrame([], f"id {self.id_type}")
        if gone:
            names = self.spark.createDataFrame([(_plain(g),) for g in gone], "file string")
            newest = self._live_places(before).join(small(names, len(gone), 256), "file", "left_semi")
            lost = newest.select("id").join(placed, "id", "left_anti")
        dead = stored(lost.withColumn("gone", F.lit(True)).unionByName(differing.where("known").select("id", F.lit(False).alias("gone"))))
        # texts are moved only where ids repeat, or where more rows changed in read files than can be told to every task
        texts, n_new = read, differing.count()
        if read.count() != placed.count():
            texts = read.join(placed.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id"])
        if before["segments"]:
            texts = texts.join(small(differing.select("id", "digest"), n_new, 64), ["id", "digest"], "left_semi")
        made = texts.select("id", F.explode(terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        self._write(segment, "postings", made.repartitionByRange("term", "id").sortWithinPartitions("term", "id"))
        held = self._table(segment, "postings")
        listed = held.groupBy("id").agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("terms"))
        rows = differing.select("id", "digest").join(listed, "id", "left")
        self._write(segment, "rows", rows.select("id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"), "digest", F.coalesce("terms", F.array().cast("array<struct<term: string, tf: long>>")).alias("terms")))
        self._write(segment, "places", placed.select("id", "file"))
        self._write(segment, "dead", dead.select("id"))
        void = known.join(dead.select("id"), "id", "left_semi").select(F.explode("terms").alias("t")).select("t.term", F.lit(-1).cast("long").alias("df"), (-F.col("t.tf")).alias("cf"))
        counts = held.select("term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("cf")).unionByName(void)
        self._write(segment, "counts", counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 OR cf <> 0"))
        n = {r.known: r["count"] for r in differing.groupBy("known").count().collect()}
        n_dead = {r.gone: r["count"] for r in dead.groupBy("gone").count().collect()}
        self._commit({"number": segment, "segments": [*before["segments"], segment], "dead": before["dead"] | {str(segment): sum(n_dead.values())}, "files": now})
        if len(before["segments"]) + 1 > MOST_SEGMENTS:
            self.compact()
        return Change(n.get(False, 0), n.get(True, 0), n_dead.get(True, 0), len(fresh))

    def _live_places(self, version: dict) -> DataFrame:
        """id, file of live rows: where the newest segment that read them found them."""
        every = [self._table(s, "places").withColumn("__s", F.lit(s)) for s in version["segments"]]
        if not every:
            return self.spark.createDataFrame([], TABLES["places"].format(id=self.id_type))
        newest = reduce(DataFrame.unionByName, every).groupBy("id").agg(F.max_by("file", "__s").alias("file"))
        return newest.join(self._live("rows", version).select("id"), "id", "left_semi")

    def compact(self) -> None:
        """All live rows in one segment, without tokenizing any; segments of the version before stay until the next one."""
        before = self.version()
        segment = before["number"] + 1
        self._write(segment, "postings", self._live("postings", before).repartitionByRange("term", "id").sortWithinPartitions("term", "id"))
        self._write(segment, "rows", self._live("rows", before))
        self._write(segment, "places", self._live_places(before))
        self._write(segment, "dead", self.spark.createDataFrame([], f"id {self.id_type}"))
        self._write(segment, "counts", self.counts())
        self._commit({"number": segment, "segments": [segment], "dead": {str(segment): 0}, "files": before["files"]})
        kept = {segment, *before["segments"]}
        for old in range(1, segment):
            if old not in kept:
                remove(self.spark, f"{self.root}/segment={old}")


def _plain(name: str) -> str:
    """A file's name, however many slashes its scheme is written with."""
    return re.sub(r"^(\w+):/+", r"\1:/", name)


_roots: dict[tuple[str, str], str] = {}


def followed(spark: SparkSession, path: str, id_col: str, text_col: str, id_type: str = "bigint") -> Index:
    """The index of the table at a path, kept for this application and brought up to the table's files by whoever asks."""
    root = _roots.setdefault((spark.sparkContext.applicationId, f"{path} {id_col} {text_col}"), folder(spark))
    index = LexicalIndex(spark, root, id_col, text_col, id_type)
    index.update(path)
    return index.index()
