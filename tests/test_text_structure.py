"""Text structure: declared scans equal the plain functions, TEI documents, parser chains, full entries."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking, items
from lectern.sources import files


def test_sentence_scan_equals_the_plain_function(spark):
    rng = random.Random(2)
    bits = ["One two", " end. ", "Why? ", 'He said "no." ', "tail", "  ", "x.", ") ", "A b c d", "\n", "!] "]
    docs = {k: ["".join(rng.choice(bits) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6))] for k in range(120)}
    rows = [(k, i, t) for k, parts in docs.items() for i, t in enumerate(parts)]
    got = {}
    for r in chunking.repaired(spark.createDataFrame(rows, "item_key long, chunk_id int, chunk string")).orderBy("item_key", "chunk_id").collect():
        got.setdefault(r.item_key, []).append(r.chunk)
    assert got == {k: chunking.whole_sentences(parts) for k, parts in docs.items()}


def test_reference_scan_equals_the_plain_function(spark):
    rng = random.Random(3)
    bits = ["text", "", "[1] A", "2. Bc", "  3. D", "References", "## bibliography:", "see references", "4.", "12 Works Cited"]
    texts = ["\n".join(rng.choices(bits, [6, 3, 2, 2, 1, 0.3, 0.2, 1, 1, 0.1], k=rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, text string")
    got = {r.k: r.text for r in chunking.without_references(df, "k", "text").collect()}
    assert got == {-1: None, **{i: chunking.before_references(t) for i, t in enumerate(texts)}}


@pytest.mark.parametrize(("size", "overlap"), [(60, 10), (25, 0)])
def test_paragraph_fold_equals_the_plain_function(spark, size, overlap):
    rng = random.Random(4)
    bits = ["Some words here.", "Short.", "A much longer sentence that goes on and on?", "\n\n", "\n \n", " ", "x" * 40, "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(100)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, text string")
    got = {}
    for r in chunking.paragraph_chunks(df, "k", "text", size, overlap).orderBy("k", "chunk_id").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {i: parts for i, t in enumerate(texts) if (parts := chunking.paragraphs(t, size, overlap))}


def test_tei(spark):
    xml = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title></teiHeader><text><body>
<div type="methods" coords="1,2"><head n="1">The <hi>first</hi> part</head><p>One &amp; two.</p><p/><p>Three <ref>[4]</ref>.</p><div><head>Inner</head><p>Deep</p><div><p>Deeper</p></div></div></div>
<div><p>No head</p></div><div type="references"><head>References</head></div></body><back><div type="annex"><head>Annex</head><p>Z</p></div></back></text></TEI>"""
    df = spark.createDataFrame([(1, xml), (2, "<TEI><text><body/></text></TEI>"), (3, None), (4, "no xml"), (5, "")], "k long, xml string")
    got = [(r.k, r.section, r.part, r.type, r.heading, list(r.paragraphs), r.coords, r.is_reference) for r in files.tei_sections(df, "k", "xml").orderBy("k", "section").collect()]
    assert got == [
        (1, 0, "body", "methods", "The first part", ["One & two.", "Three [4]."], "1,2", False), (1, 1, "body", "unknown", "Inner", ["Deep"], "", False), (1, 2, "body", "unknown", "", ["Deeper"], "", False),
        (1, 3, "body", "unknown", "", ["No head"], "", False), (1, 4, "body", "references", "References", [], "", True), (1, 5, "back", "annex", "Annex", ["Z"], "", True),
    ]
    flat = files.tei_sections(df.where("k = 1"), "k", "xml", depth=1).orderBy("section").collect()
    assert len(flat) == 4 and "Deep" in " ".join(flat[0].paragraphs)


def test_chain_of_parsers(spark):
    def strict(content):
        if content == b"bad":
            raise ValueError("no text")
        return content.decode()

    links = [("strict", strict, 10), ("half", lambda content: content.decode()[:5], 5), ("never", lambda content: 1 / 0, 0)]
    df = spark.createDataFrame([("a", b"long enough text"), ("b", b"bad"), ("c", b"seven"), ("d", b"x")], "path string, content binary")
    got = {r.path: (r.parser, r.text, r.chars, [(t.parser, t.chars, t.error) for t in r.tried]) for r in files.chained(df, links).collect()}
    assert got["a"] == ("strict", "long enough text", 16, [("strict", 16, None)])
    assert got["b"][0] == "half" and got["b"][3] == [("strict", None, "ValueError: no text"), ("half", 3, None), ("never", None, "ZeroDivisionError: division by zero")]
    assert got["c"] == ("half", "seven", 5, [("strict", 5, None), ("half", 5, None)])
    assert got["d"][0] == "half" and len(got["d"][3]) == 3
    assert {r.parser for r in files.chained(df, links, forced="half").collect()} == {"half"}
    alone = files.chained(df.where("path = 'b'"), links, forced="never").first()
    assert (alone.parser, alone.text, alone.chars) == (None, None, None)
    with pytest.raises(ValueError):
        files.chained(df, links, forced="other")


def test_full_entries(spark):
    schema = "kind string, creators array<struct<creatorType: string, firstName: string, lastName: string, name: string>>, title string, date string, doi string"
    rows = [("journalArticle", [("author", "Jane", "van Dyk", None), ("editor", "E", "D", None), ("author", None, None, "The Group")], "A {b}", "2020-01-02", "10.1/x"), ("film", [("author", None, None, "Some Body")], None, None, ""), ("book", [], "T", "", None), ("book", None, "T", "", None)]
    col = F.col
    made = items.bibtex_full(col("kind"), F.lit("K"), col("creators"), col("title"), col("date"), F.lit(None).cast("string"), doi=col("doi"))
    got = [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(made).collect()]
    assert got[0] == "@article{vanDyk2020_K,\n  title = {A \\{b\\}},\n  doi = {10.1/x},\n  author = {van Dyk, Jane and The Group},\n  year = {2020}\n}"
    assert got[1] == "@misc{Bodynodate_K,\n  author = {Some Body}\n}"
    assert got[2] == got[3] == "@book{nodate_K,\n  title = {T}\n}"
