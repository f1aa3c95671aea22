"""Sinks: Markdown files, BibTeX, GraphML, snapshots with retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.items import bibtex, file_name, markdown


def write_markdown(items: DataFrame, path: str) -> None:
    """A folder per item, name=<title>_<key>, with its document; attachments are left out."""
    col = F.col
    rows = items.where(col("item_type") != "attachment").select(
        file_name(col("title"), col("item_key")).alias("name"), markdown(col("item_key"), col("title"), col("author"), col("date"), col("item_type"), col("body")).alias("value")
    )
    rows.write.partitionBy("name").mode("overwrite").text(path)


def write_bibtex(items: DataFrame, path: str) -> None:
    """Entries, a blank line after each, in part files."""
    col = F.col
    entry = bibtex(col("item_type"), col("item_key"), col("author"), col("title"), F.substring("date", 1, 4), col("publication"))
    items.select(F.concat(entry, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def xml_text(value: Column) -> Column:
    """A value made safe for XML text and attributes."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None, most: int | None = None) -> DataFrame:
    """value, part: the lines of a GraphML document, in order of part: head, nodes, edges between them, foot.

    nodes: node, label, name; edges: src, dst, rel. most keeps the lowest nodes: a stated limit of the export.
    """
    kept = nodes.where(F.col("label").isin(labels)) if labels else nodes
    kept = kept.orderBy("node").limit(most) if most is not None else kept
    ids = kept.select("node")
    linked = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    node = F.concat(F.lit('<node id="'), xml_text(F.col("node")), F.lit('"><data key="label">'), xml_text(F.col("label")), F.lit('</data><data key="name">'), xml_text(F.col("name")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"><data key="rel">'), xml_text(F.col("rel")), F.lit("</data></edge>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>\n' for k, f in (("label", "node"), ("name", "node"), ("rel", "edge"))) + '<graph edgedefault="directed">'
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(head, 0), ("</graph>\n</graphml>", 3)], "value string, part int")
    return ends.union(kept.select(node, F.lit(1))).union(linked.select(edge, F.lit(2)))


def write_graphml(lines: DataFrame, path: str) -> None:
    """The document in part files that follow each other; joined they are one file."""
    lines.repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def snapshot(df: DataFrame, root: str, version: str, keep: int = 5) -> list[str]:
    """Write df as root/version=<version>, keep the last `keep` versions by name; the versions that are left."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    spark = df.sparkSession
    names = snapshots(spark, root)
    jvm = spark._jvm
    for name in names[keep:]:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/version={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return names[:keep]


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Versions, newest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getPath().getName().removeprefix("version=") for s in found if s.getPath().getName().startswith("version=")), reverse=True)
