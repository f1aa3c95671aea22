"""Stored indexes: recall and pruning of vectors in cells, codes, postings that follow their table."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical, lexical_index, vector, vector_index
from lectern.sources.catalog import Catalog
from lectern.storage import kept, version

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def index(spark):
    return Catalog(spark, DATA).vector_index()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("oversampling", [None, 3])
def test_recall_over_all_requests(spark, index, oversampling):
    rows = Catalog(spark, DATA).vectors()
    asked = rows.where("id % 50 = 0").select("id", "vector")
    want = {(r.query, r.id) for r in vector.nearest(rows, asked, 10).collect()}
    got = {(r.query, r.id) for r in vector_index.nearest(index, asked, 10, oversampling=oversampling).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)


def test_clusters_need_few_cells(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 30]], i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    made = vector_index.indexed(df, "clusters", "1")
    assert made.probes <= 3 and made.cells.count() == 30
    asked = df.where("id % 50 = 0").select("id", "vector")
    want = {(r.query, r.id, r.similarity) for r in vector.nearest(df, asked, 10).collect()}
    assert len({(r.query, r.id, r.similarity) for r in vector_index.nearest(made, asked, 10).collect()} & want) >= 0.9 * len(want)
    assert {(r.query, r.id, r.similarity) for r in vector_index.nearest(made, asked, 10, probes=1, complete=True).collect()} == want
    outside = spark.createDataFrame([("new", centres[4])], "id string, vector array<double>")
    assert {r.id % 30 for r in vector_index.nearest(made, outside, 5, drop_self=False).collect()} == {4}


def test_scans_open_cells_and_columns_they_need(index):
    asked = index.rows.where("id = 0").select(F.col("id").alias("query"), F.col("codes").alias("__codes"), "cell")
    text = plan(vector_index._met(index, asked, None, True, "codes"))
    scan = next(line for line in text.splitlines() if "PartitionFilters: [" in line and "codes" in line)
    assert "cell#" in scan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "vector" not in scan.partition("ReadSchema: ")[2]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.5, 0.5]), (5, [1.0, 0.0])]
    made = vector_index.indexed(spark.createDataFrame(rows, "id long, vector array<double>"), "odd", "1")
    got = [(r.query, r.id, r.similarity) for r in vector_index.nearest(made, spark.createDataFrame(rows[:2], "id long, vector array<double>"), 9, complete=True).orderBy("query", "rank").collect()]
    assert got == [(1, 5, 1.0), (1, 4, 0.707107), (1, 2, 0.0), (2, 1, 0.0), (2, 4, 0.0), (2, 5, 0.0)]
    empty = vector_index.indexed(spark.createDataFrame([], "id long, vector array<double>"), "empty", "1")
    assert vector_index.nearest(empty, spark.createDataFrame(rows[:1], "id long, vector array<double>"), 3).count() == 0


# Postings that follow their table

SCHEMA = "id long, text string"


def rebuilt(docs):
    p = lexical.postings(docs, "id", "text")
    return {tuple(r) for r in p.select("id", "term", "tf").collect()}, {tuple(r) for r in p.groupBy("term").agg(F.count(F.lit(1)), F.sum("tf")).collect()}


def held(index):
    return {tuple(r) for r in index.postings().select("id", "term", "tf").collect()}, {tuple(r) for r in index.counts().select("term", "df", "cf").collect()}


def test_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "MOST_SEGMENTS", 3)
    table = f"file://{tmp_path}/table"
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", "id", "text")
    assert index.update(table) == lexical_index.Change(0, 0, 0, 0) and held(index) == (set(), set())
    put = lambda part, rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{table}/part={part}")
    now = lambda: rebuilt(spark.read.parquet(table).where("id IS NOT NULL"))
    put("a", [(1, "red green"), (2, "green blue"), (3, None), (None, "lost")])
    assert index.update(table) == lexical_index.Change(3, 0, 0, 1) and held(index) == now()
    put("b", [(4, "red red sky"), (5, "")])
    assert index.update(table) == lexical_index.Change(2, 0, 0, 1) and held(index) == now()
    assert index.update(table) == lexical_index.Change(0, 0, 0, 0)
    put("a", [(1, "red green"), (2, "green sun")])  # 2 changed, 3 gone
    assert index.update(table) == lexical_index.Change(0, 1, 1, 1) and held(index) == now()
    put("c", [(6, "sky")])
    index.update(table)
    assert len(index.version()["segments"]) == 1 and held(index) == now()  # merged
    put("b", [(5, "moon")])  # 4 gone, after a merge
    assert index.update(table) == lexical_index.Change(0, 1, 1, 1) and held(index) == now()
    assert {r.id: r.dl for r in index.lengths().collect()} == {1: 2, 2: 2, 5: 1, 6: 1}
    assert [tuple(r) for r in lexical.bm25_searches(index.index(), spark.createDataFrame([("q", "moon red")], "query string, text string"), 5).select("id", "rank").orderBy("rank").collect()] == [(5, 1), (1, 2)]


def test_failed_update_changes_nothing(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/table"
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", "id", "text")
    spark.createDataFrame([(1, "red")], SCHEMA).write.parquet(table)
    index.update(table)
    before = held(index)
    spark.createDataFrame([(2, "blue")], SCHEMA).write.mode("append").parquet(table)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(lexical_index.LexicalIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError()))
        index.update(table)
    assert held(index) == before
    index.update(table)
    assert held(index) == rebuilt(spark.read.parquet(table))


def test_searches_see_a_table_rewritten_in_place(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    catalog = Catalog(spark, str(tmp_path))
    for n in (2, 5):
        spark.range(n).select(F.col("id").alias("doc_id"), F.lit("word").alias("text")).write.mode("overwrite").parquet(path)
        assert catalog.lexical_index().postings.count() == n


def test_kept_tables_follow_their_input(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    for n in (2, 3, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        made = kept(spark, "rows", version(spark, path), lambda: spark.read.parquet(path))
        again = kept(spark, "rows", version(spark, path), lambda: 1 / 0)
        assert made.count() == again.count() == n


# Tables of requests

def test_requests_at_once_equal_requests_one_by_one(spark):
    import re
    from collections import Counter
    from math import log

    from lectern.functions import text as t
    from lectern.functions import understanding as ask
    from lectern.plans.search import Search

    c = Catalog(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r.text for r in c.table("documents").collect()}
    terms = lambda x: Counter(w for w in re.findall(r"[^\W]{2,}", x.lower()) if w not in t.STOP_WORDS)
    index = {i: terms(x) for i, x in docs.items()}
    df = Counter(w for x in index.values() for w in x)
    cf = sum((x for x in index.values()), Counter())
    voc = {w: round(log((1 + len(docs)) / (1 + df[w])) + 1, 6) for w in sorted(cf, key=lambda w: (-cf[w], w))[: lexical.FEATURES]}

    def search(text, n):
        asked, found = terms(text), {}
        for i, x in index.items():
            if hit := [w for w in asked if w in x and w in voc]:
                found[i] = sum(x[w] * voc[w] * asked[w] * voc[w] for w in hit)
        return [(i, s, rank) for rank, (i, s) in enumerate(sorted(found.items(), key=lambda p: (-round(p[1], 4), p[0]))[:n], 1)]

    def iterate(text, limit):
        rows = search(text, 2 * limit)
        for _ in range(2):
            if len(rows) >= 5 and max(s for _, s, _ in rows) >= 0.6:
                break
            words = Counter(w for i, _, rank in rows if rank <= 3 for w in re.findall(r"[A-ZÀ-ÖØ-Þ][^\W\d_]{3,}|[a-zß-öø-ÿ]+-[a-zß-öø-ÿ]+", docs[i]))
            concepts = sorted((w for w, n in words.items() if n > 1), key=lambda w: (-words[w], w))[:3]
            forms = ask.reformulate(text, concepts)
            if not forms:
                break
            fresh = {}
            for f, form in enumerate(forms):
                for i, s, rank in search(form, limit):
                    if i not in {r[0] for r in rows}:
                        fresh[i] = min(fresh.get(i, (99, 99, 0, 0)), (rank, f, s))
            rows += [(i, s, rank) for i, (rank, _, s) in fresh.items()]
        return [i for i, _, _ in sorted(rows, key=lambda r: (-round(r[1], 4), r[0]))[:limit]]

    rare = [w for w, n in df.items() if n == 1 and w.isascii() and w.isalpha()][:6]
    requests = [f"memory {w}" for w in rare] + ["Zxqv neural", "", "The of", f"{rare[0]} or {rare[1]}"] + [" ".join(list(terms(x))[:2]) for x in list(docs.values())[:4]]
    table = spark.createDataFrame(list(enumerate(requests)), "query int, text string")
    got = {}
    for r in Search(c).iterative_table(table, 8).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    assert got == {q: ids for q, x in enumerate(requests) if (ids := iterate(x, 8))}


def test_reformulations_agree(spark):
    from lectern.functions import understanding as ask

    cases = [("memory thor", ["Alpha", "Beta", "Gamma"]), ("ml", []), ("AI and memory", ["X"]), ("a long request of many words", ["Y"]), ("neural", ["neural"]), ("", [])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, concepts array<string>")
    got = {r.i: list(r.f) for r in df.select("i", ask.reformulate_column(F.col("text"), F.col("concepts")).alias("f")).collect()}
    assert got == {i: ask.reformulate(*c) for i, c in enumerate(cases)}


def test_paths(spark):
    from lectern.operators import graph

    edges = spark.createDataFrame([(1, 2), (3, 1), (2, 4), (3, 4), (4, 5), (5, 6), (9, 9)], "src long, dst long")
    found = graph.paths(edges, 1, 3)
    assert {r.id: list(r.path) for r in found.collect()} == {2: [1, 2], 3: [1, 3], 4: [1, 2, 4], 5: [1, 2, 4, 5]}
    named = graph.titled(found, spark.createDataFrame([(1, "One", 2001), (2, None, 2002), (4, "Four", 1999)], "id long, title string, year int"))
    assert {r.id: (list(r.titles), r.year) for r in named.collect()}[4] == (["One", "paper 2", "Four"], 1999)
    assert [r.id for r in graph.placed(named.select("id", "hops"), ["hops", "id"]).orderBy("place").collect()] == [2, 3, 4, 5]
