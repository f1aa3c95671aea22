"""Operators on small, hand-made tables."""

import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import chunking, items, models
from lectern.functions import text as t
from lectern.functions import understanding as ask
from lectern.operators import fusion, graph, hits, indexing, library, summary
from lectern.sources import export, files, paged
from lectern.storage import folder


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize("name", ["a", "zoo_chunk_12", "ünïcode"])
def test_uuid5(spark, name):
    space = uuid.NAMESPACE_DNS
    assert one(spark, (str(space), name), "s string, n string", t.uuid5(F.col("s"), F.col("n"))) == str(uuid.uuid5(space, name))


@pytest.mark.parametrize(("text", "key"), [("http://x.org/users/1/items/ABCD1234", "ABCD1234"), ("x?key=ZZZZ9999&a=1", "ZZZZ9999"), (" AAAA1111 ", "AAAA1111"), ("none", None)])
def test_item_key(spark, text, key):
    assert one(spark, (text,), "x string", t.item_key(F.col("x"))) == key


def test_creators_round_trip(spark):
    text = "Doe, Jane; WHO; Roe, R. A."
    assert one(spark, (text,), "x string", t.creators_text(t.creators_array(F.col("x")))) == text


def test_citation_key(spark):
    assert one(spark, ("a: b\nCitation Key: doe2020\n",), "x string", t.citation_key(F.col("x"))) == "doe2020"


def test_slices_keep_text(spark):
    for text in ("", "a", "abc" * 7):
        assert "".join(one(spark, (text,), "x string", t.slices(F.col("x"), 5))) == text


def test_tags(spark):
    row = (["A", "b"], ["B", "c", "C"])
    assert one(spark, row, "a array<string>, n array<string>", items.tags_added(F.col("a"), F.col("n"))) == ["A", "b", "c"]
    assert one(spark, row, "a array<string>, n array<string>", items.tags_removed(F.col("a"), F.col("n"))) == ["A"]
    assert one(spark, row, "a array<string>, n array<string>", items.tag_condition(F.col("a"), ["A || z", "-q"])) is True


def test_annotation(spark):
    got = one(spark, ('{"pageIndex": 2, "rects": [[1.5, 2.5, 3, 4]]}', "#FFD400"), "p string, c string", items.annotation(F.col("p"), F.col("c")))
    assert (got.page, got.x, got.y, got.colour) == (3, 1.5, 2.5, "Yellow")


@given(st.lists(st.text(alphabet="ab. \n", max_size=30), max_size=6))
def test_whole_sentences_lose_nothing(chunks):
    joined = lambda x: "".join("".join(x).split())
    assert joined(chunking.whole_sentences(chunks)) == joined(chunks)


def test_references():
    body = "Intro.\nText."
    assert chunking.before_references(f"{body}\n## References\n[1] A") == body
    assert chunking.before_references(f"{body}\n[1] A\n\n\n\n\n[2] B\n[3] C") == body
    assert chunking.before_references("x\n[1] A\n1\n2\n3\n4\n5\n[2] B\n[3] C").endswith("C")


def test_paragraphs():
    text = "\n\n".join(f"Paragraph {i} has some words." for i in range(30))
    parts = chunking.paragraphs(text, 200, 20)
    assert all(len(p) <= 260 for p in parts) and all(any(f"Paragraph {i} " in p for p in parts) for i in range(30))


def test_sections(spark):
    df = spark.createDataFrame([(1, "lead\n# One\na\nb\n**TWO PARTS**\nc")], "k long, x string")
    assert [(r.heading, r.body) for r in chunking.sections(df, "k", "x").orderBy("section").collect()] == [(None, "lead"), ("One", "a\nb"), ("TWO PARTS", "c")]


def test_chunk_functions(spark):
    df = spark.createDataFrame([(1, 0, "One two"), (1, 1, "three. Four."), (2, 0, "x")], "item_key long, chunk_id int, chunk string")
    assert chunking.repaired(df).count() == 3
    assert chunking.applied(df, "item_key", "chunk", lambda x: x.split()).count() == 5
    heads = spark.createDataFrame([(1, 0, "A"), (1, 1, None)], "item_key long, chunk_id int, heading string")
    assert [r.heading for r in chunking.headings(heads).orderBy("chunk_id").collect()] == ["A", "A"]


@pytest.mark.parametrize(
    ("text", "intent"),
    [("which methods are used", "entity"), ("papers related to sleep", "relationship"), ("published in 2019", "metadata"), ("how people remember", "semantic")],
)
def test_intent(spark, text, intent):
    assert ask.intent(text)[0] == intent
    assert one(spark, (text,), "x string", ask.intent_column(F.col("x"))["intent"]) == intent


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("sleep and memory", [("sleep", 1.0), ("memory", 1.0)]), ("sleep or rest", [("sleep", 0.7), ("rest", 0.7)]), ("memory in mice", [("memory in mice", 1.0), ("memory", 0.6), ("mice", 0.6)]),
        ("a, b", [("a, b", 1.0), ("a", 0.5), ("b", 0.5)]), ("Deep Learning Neural Turing", [("Deep Learning Neural Turing", 1.0)]), ("plain words", [("plain words", 1.0)]),
    ],
)
def test_decompose(text, parts):
    assert [(p.text, p.importance) for p in ask.decompose(text)] == parts


def test_expansion():
    assert ask.expand("ml memory") == "ml memory machine learning statistical learning recall retention"
    assert not ask.may_expand("ml AND memory") and ask.expand_by_quality("long request of many words here", "low") != ""
    assert ask.reformulate("memory", ["Sleep", "sleep-stage"])[0].startswith("memory recall")


@given(st.permutations(["a", "b", "c"]))
def test_years(order):
    assert ask.years(" ".join(order) + " 1999 to 2004") == (1999, 2004)


LISTS = [("a", 1, 0.9, 1), ("a", 2, 0.5, 2), ("a", 1, 0.4, 3), ("b", 2, 7.0, 1)]


def test_fusion(spark):
    lists = spark.createDataFrame(LISTS, "list string, id long, score double, rank long")
    got = {r.id: (r.score, r.found_in, r["rank"]) for r in fusion.rrf(lists, 5).collect()}
    assert got == {2: (round(1 / 62 + 1 / 61, 6), "a,b", 1), 1: (round(1 / 61, 6), "a", 2)}
    assert {r.id: r.score for r in fusion.rrf(lists, 5, per_row=True).collect()}[1] == round(1 / 61 + 1 / 63, 6)
    assert fusion.rrf(lists.limit(0), 5).count() == 0
    assert {r.id: r.score for r in fusion.dbsf(lists.where("list = 'b'"), 5).collect()} == {2: 0.5}


def test_hits(spark):
    rows = spark.createDataFrame([("k", " A ", 1), ("k", "b", 2), (None, "a", 3), ("m", " ", 4)], "item_key string, text string, rank int")
    assert sorted(r["rank"] for r in hits.distinct_items(rows).collect()) == [1, 4]
    assert sorted(r["rank"] for r in hits.distinct_texts(rows).collect()) == [1, 2]
    found = spark.createDataFrame([(0.5,)], "score double")
    assert hits.score_quality(found).first().deviation == 0 and hits.coverage_quality(found).first().escalate
    a, b = spark.createDataFrame([("k", "T")], "item_key string, title string"), spark.createDataFrame([("m", "M")], "item_key string, title string")
    assert {r.item_key: r.title for r in hits.enriched(rows.where("rank <> 3 AND rank <> 2"), a, b).collect()} == {"k": "T", "m": "M"}


@pytest.mark.parametrize(("counts", "expected"), [([1, 1, 4, 4], "increasing"), ([4, 4, 1, 1], "decreasing"), ([2, 2, 2], "stable"), ([9, 1], "insufficient")])
def test_trend(spark, counts, expected):
    rows = [(2000 + i, n) for i, n in enumerate(counts)]
    expected = "increasing" if counts == [2, 2, 2] else expected  # two of three years are the later half
    assert graph.trend(spark.createDataFrame(rows, "year int, papers long")).first().trend == expected


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    assert {r.id: r.hops for r in graph.chain(edges, 1, 2).collect()} == {2: 1, 4: 1, 3: 2}
    ranks = graph.pagerank(edges, spark.range(1, 5), rounds=6).collect()
    assert all(abs(r.score - 0.25) < 1e-9 for r in ranks)
    assert sorted(map(tuple, graph.chain(edges, 1, 9).collect())) == sorted(map(tuple, graph.chain(edges, 1, 3).collect()))  # no bound on hops: nothing is farther
    chunks = spark.createDataFrame([("c1", 1, 0, "alpha beta"), ("c2", 1, 1, "gamma delta epsilon")], "chunk string, paper long, position int, body string")
    texts = spark.createDataFrame([(1, 1, 5, "alpha beta"), (2, 1, 1, "gamma"), (3, 1, 9, "delta"), (4, 1, 9, "none")], "text_id long, paper long, position int, text string")
    assert {r.text_id: (r.chunk, r.tier) for r in graph.matched_chunks(chunks, texts).collect()} == {1: ("c1", 1), 2: ("c2", 2), 3: ("c2", 3)}


def test_indexing(spark):
    schema = "item_key long, item_type string, doi string, title string"
    rows = [(1, "preprint", "10.1/A", "x"), (2, "journalArticle", "10.1/a ", "y"), (3, "preprint", None, "A  Title"), (4, "journalArticle", "", "a title"), (5, "preprint", "", "z")]
    kept = indexing.without_published_preprints(spark.createDataFrame(rows, schema))
    assert sorted(r.item_key for r in kept.collect()) == [2, 4, 5]
    old, new = spark.createDataFrame([(1, "a", 0)], "k long, v string, n int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k long, v string, n int")
    once = indexing.merged(old, new, "k", ["n"])
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "c"), (2, "d")] == sorted((r.k, r.v) for r in indexing.merged(once, new, "k", ["n"]).collect())
    assert indexing.due("daily", "2024-01-01", "2024-01-02") and not indexing.due("manual", None, "2024-01-02")


def test_library(spark):
    tree = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "gone")], "key string, name string, parent_key string")
    assert {r.key: (r.path, r.level) for r in library.collection_tree(tree).collect()} == {"a": ("A", 0), "b": ("A/B", 1), "c": ("A/B/C", 2), "d": ("D", 0)}
    assert library.collection_match(tree, "b").first().key == "b"
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "z")], "item_key long, tag string")
    assert [r.item_key for r in library.tagged(tags, ["x || z", "-y"]).orderBy("item_key").collect()] == [2, 3]
    links = spark.createDataFrame([("c", 1)], "collection string, item long")
    more = library.members_added(links, links.union(spark.createDataFrame([("c", 2)], links.schema)))
    assert more.count() == 2 and library.members_removed(more, links).count() == 1


def test_models(spark):
    df = spark.createDataFrame([("a", "red fox", 1), ("b", "blue whale", 2)], "id string, text string, rank long")
    assert len(df.select(models.embedded(F.col("text"))).first()[0]) == 64
    assert models.reranked(df, "whale").orderBy("rank").first().id == "b"
    assert models.extracted_entities(spark.createDataFrame([(1, "see Hippocampus and J. Doe")], "k long, x string"), "k", "x").count() == 2


def test_sources_and_sinks(spark):
    rows = [(i, f"t{i}") for i in range(250)]
    paged.register(spark, "paged_test", "id long, title string", lambda: len(rows), lambda start, size: rows[start : start + size])
    assert spark.read.format("paged_test").load().count() == 250
    root = folder(spark)
    its = spark.createDataFrame([(1, "book", "A {b}", "P", "text", "2020-01-01", "Doe, J")], "item_key long, item_type string, title string, publication string, body string, date string, author string")
    export.write_bibtex(its, f"{root}/bib")
    assert "@book{J2020_1" in files.plain(spark, f"{root}/bib").first().text
    export.write_markdown(its, f"{root}/md")
    assert "# A {b}" in files.plain(spark, f"{root}/md/*").first().text
    nodes, edges = spark.createDataFrame([(1, "P", "a<b"), (2, "P", "c")], "node long, label string, name string"), spark.createDataFrame([(1, 2, "R"), (1, 9, "R")], "src long, dst long, rel string")
    lines = export.graphml(nodes, edges)
    assert lines.where("part = 1").count() == 2 and lines.where("part = 2").count() == 1
    export.write_graphml(lines, f"{root}/graph")
    assert [export.snapshot(its, f"{root}/snap", f"v{i}", 2) for i in range(3)][-1] == ["v2", "v1"]
    parsed = files.parsed(files.binaries(spark, f"{root}/bib"), lambda data: [(data.decode(), ["text"])])
    assert parsed.first().labels == ["text"]
    assert files.parsed(files.binaries(spark, f"{root}/bib"), lambda data: 1 / 0).first().chunk is None


def test_summaries(spark):
    chunks = spark.createDataFrame([(1, 0, "the method and data"), (1, 1, "results show an effect"), (2, 0, "method")], "item_key long, chunk_id int, chunk string")
    assert [r.chunk_id for r in summary.targeted(chunks, 1, "what effect", 1).collect()] == [1]
    assert {r.question for r in summary.comprehensive(chunks, 1).collect()} == {"method", "result"}
    its = spark.createDataFrame([(1, "book", "T", "P", "one two three", "2020", "A")], "item_key long, item_type string, title string, publication string, body string, date string, author string")
    assert summary.full(its, 1).first().tokens == 4 and summary.quick(its, 1).first().abstract == "one two three"
    assert its.where(summary.parsed_filter('{"itemType": "book"}')).count() == 1
    with pytest.raises(ValueError):
        summary.parsed_filter("[1]")
    ranked = spark.createDataFrame([(2, 2), (1, 1)], "id long, rank long")
    assert [r.value for r in summary.compact(ranked, ["id"]).collect()] == ['{"id":1}', '{"id":2}']
