"""Registered queries of the stored indexes: vectors in cells, 8-bit codes, postings that follow their table, tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import understanding as ask
from lectern.operators import graph_store, lexical, lexical_index, vector_blocks, vector_index
from lectern.plans.explore import explored
from lectern.plans.search import Search
from lectern.registry import CONCEPT, CONCEPTS, COSINE, ITEMS, ORACLE_SQL, PAPERS, POSTINGS, STOP, TOP, VECTORS, YEARS, _knn, query
from lectern.sources.catalog import Catalog
from lectern.storage import TEXTS, folder, remove, stored
from lectern.streaming import ingest, update

#: Searches take every row whose id is divisible by this as a request, against all rows.
EACH = 50
#: Buckets of the small stores that queries make.
FEW_BUCKETS = 8


def _seeds(c: Catalog) -> DataFrame:
    return c.vectors().where(F.col("id") % EACH == 0).select("id", "vector")


def _knn_of_all(where: str = "true") -> str:
    return f"WITH {VECTORS} SELECT query, id, similarity, rank FROM (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (SELECT b.id AS query, a.id, round({COSINE}, 6) AS similarity FROM v a, v b WHERE b.id % {EACH} = 0 AND a.id <> b.id AND {where})) WHERE rank <= {TOP}"


@query("knn_batch", _knn_of_all())
def knn_batch(c: Catalog) -> DataFrame:
    """Exhaustive: the truth that the index's recall is measured against."""
    return vector_blocks.nearest(c.vectors(), _seeds(c), TOP)


@query("ivf_knn")
def ivf_knn(c: Catalog) -> DataFrame:
    """The nearest cells only; the tests measure the recall."""
    return vector_index.nearest(c.vector_index(), _seeds(c), TOP)


@query("ivf_knn_complete", _knn_of_all())
def ivf_knn_complete(c: Catalog) -> DataFrame:
    """The nearest cells, then those that may still hold a nearer row."""
    return vector_index.nearest(c.vector_index(), _seeds(c), TOP, complete=True)


@query("ivf_knn_filtered", _knn_of_all("a.label = 3"))
def ivf_knn_filtered(c: Catalog) -> DataFrame:
    return vector_index.nearest(c.vector_index(), _seeds(c), TOP, where=F.col("label") == 3, complete=True)


@query("quantized_batch")
def quantized_batch(c: Catalog) -> DataFrame:
    """Stored codes choose rows, whose floats order them; the tests measure the recall."""
    return vector_index.nearest(c.vector_index(), _seeds(c), TOP, oversampling=3)


# Terms: requests are the benchmark's items

REQUESTS = f"requests AS (SELECT item_id AS query, text FROM benchmark WHERE item_id % {EACH} = 0)"
ASKED = f"asked AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM requests) WHERE term NOT IN ({STOP}) GROUP BY ALL)"
BEST = f"SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {TOP}"
BM25 = f"""dl AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id), w AS (SELECT count(*) AS m, avg(dl) AS avgdl FROM dl), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query, id, round(sum(ln(1 + (m - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM asked JOIN p USING (term) JOIN d USING (term) JOIN dl USING (id), w GROUP BY query, id)"""


def _requests(c: Catalog) -> DataFrame:
    return c.table("benchmark").where(F.col("item_id") % EACH == 0).select(F.col("item_id").alias("query"), "text")


@query("sparse_batch", f"WITH {POSTINGS}, {REQUESTS}, {ASKED}, s AS (SELECT query, id, round(sum(tf * idf * qtf * idf), 4) AS score FROM p JOIN voc USING (term) JOIN asked USING (term) GROUP BY query, id) {BEST}")
def sparse_batch(c: Catalog) -> DataFrame:
    index = c.lexical_index()
    return lexical.sparse_searches(index.postings, index.vocabulary, _requests(c), TOP)


@query("bm25_batch", f"WITH {POSTINGS}, {REQUESTS}, {ASKED}, {BM25} {BEST}")
def bm25_batch(c: Catalog) -> DataFrame:
    return lexical.bm25_searches(c.lexical_index(), _requests(c), TOP)


#: The documents after two changes of their files: halves of some texts, some rows gone.
CHANGED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN substring(text, 1, length(text) // 2) ELSE text END AS text FROM main.documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 11 = 0))"


def _followed(c: Catalog) -> lexical_index.LexicalIndex:
    """An index that saw two thirds of the documents, then the rest in a file of its own, then that file replaced."""
    root = folder(c.spark)
    index, table = lexical_index.LexicalIndex(c.spark, f"{root}/index", "doc_id", "text"), f"{root}/table"
    docs, third = c.table("documents").select("doc_id", "text"), F.col("doc_id") % 3 == 0
    docs.where(~third).write.parquet(f"{table}/part=a")
    index.update(table)
    docs.where(third).write.parquet(f"{table}/part=b")
    index.update(table)
    changed = F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    docs.where(third & (F.col("doc_id") % 11 != 0)).select("doc_id", changed.alias("text")).write.mode("overwrite").parquet(f"{table}/part=b")
    index.update(table)
    return index


@query("followed_search", f"WITH {CHANGED}, {POSTINGS}, {REQUESTS}, {ASKED}, {BM25} {BEST}")
def followed_search(c: Catalog) -> DataFrame:
    return lexical.bm25_searches(_followed(c).index(), _requests(c), TOP)


@query("followed_vocabulary", f"WITH {CHANGED}, {POSTINGS} SELECT term, df, cf, idf FROM voc")
def followed_vocabulary(c: Catalog) -> DataFrame:
    """Frequencies kept up by adding changes, not by counting again."""
    return _followed(c).vocabulary()


#: All parts of all requests, searched apart and merged.
PARTS = f"parts AS (SELECT item_id AS query, part, text AS q, importance FROM ({ORACLE_SQL['query_decompose']}) WHERE item_id % {EACH} = 0)"


@query(
    "decomposed_batch",
    f"""WITH {POSTINGS}, {PARTS}, asked AS (SELECT query, part, importance, term, count(*) AS qtf FROM (SELECT query, part, importance, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM parts) WHERE term NOT IN ({STOP}) GROUP BY ALL),
l AS (SELECT query, part, importance, id, round(sum(tf * idf * qtf * idf), 4) AS score FROM p JOIN voc USING (term) JOIN asked USING (term) GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, part ORDER BY score DESC, id) AS rank FROM l) WHERE rank <= {2 * TOP}),
s AS (SELECT query, id, round(sum(score * importance / rank), 4) AS score FROM r GROUP BY query, id) {BEST}""",
)
def decomposed_batch(c: Catalog) -> DataFrame:
    return Search(c).decomposed_table(_requests(c), TOP)


@query("iterative_batch")
def iterative_batch(c: Catalog) -> DataFrame:
    """Short requests, of every benchmark item, that often find too little; the tests compare with one request at a time in plain Python."""
    short = F.concat(F.lit("memory "), F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " "))
    return Search(c).iterative_table(c.table("benchmark").select(F.col("item_id").alias("query"), short.alias("text")), TOP)


# Graph store: concepts and people, then what the lines say of them, then old and repeated writes

GRAPH_BATCHES = """a AS (SELECT 'Concept' AS label, p_partkey::VARCHAR AS key, [{'n': 'name', 'v': p_name}, {'n': 'type', 'v': p_type}] AS props, 1 AS stamp FROM part UNION ALL SELECT 'Person', s_suppkey::VARCHAR, [{'n': 'name', 'v': s_name}], 1 FROM supplier),
b AS (SELECT 'Concept' AS label, l_partkey::VARCHAR AS key, [{'n': 'lines', 'v': count(*)::VARCHAR}, {'n': 'last', 'v': strftime(max(l_shipdate), '%Y-%m-%d')}] AS props, 2 AS stamp FROM lineitem GROUP BY l_partkey
      UNION ALL SELECT 'Concept', p_partkey::VARCHAR, [{'n': 'name', 'v': upper(p_name)}], 2 FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'Paper', o_orderkey::VARCHAR, [{'n': 'venue', 'v': o_orderpriority}], 2 FROM orders),
c AS (SELECT 'Concept' AS label, p_partkey::VARCHAR AS key, [{'n': 'name', 'v': 'old'}, {'n': 'note', 'v': 'late'}] AS props, 0 AS stamp FROM part WHERE p_partkey % 7 = 0)"""


def _graph_batches(c: Catalog) -> list[DataFrame]:
    props = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v)])
    node = lambda table, label, key, p, stamp: table.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), p.alias("props"), F.lit(stamp).cast("long").alias("stamp"))
    part, col = c.table("part"), F.col
    lines = c.table("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).cast("string").alias("n"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last"))
    a = node(part, "Concept", "p_partkey", props(name=col("p_name"), type=col("p_type")), 1).unionByName(node(c.table("supplier"), "Person", "s_suppkey", props(name=col("s_name")), 1))
    b = node(lines, "Concept", "l_partkey", props(lines=col("n"), last=col("last")), 2).unionByName(node(part.where("p_partkey % 5 = 0"), "Concept", "p_partkey", props(name=F.upper("p_name")), 2))
    b = b.unionByName(node(c.table("orders"), "Paper", "o_orderkey", props(venue=col("o_orderpriority")), 2))
    return [a, b, node(part.where("p_partkey % 7 = 0"), "Concept", "p_partkey", props(name=F.lit("old"), note=F.lit("late")), 0), b]


@query("graph_merged", f"WITH {GRAPH_BATCHES}, w AS (SELECT label, key, p.n AS name, stamp, p.v AS value FROM (SELECT label, key, stamp, unnest(props) AS p FROM (FROM a UNION ALL FROM b UNION ALL FROM c))) SELECT label, key, name, arg_max(value, stamp) AS value FROM w GROUP BY label, key, name")
def graph_merged(c: Catalog) -> DataFrame:
    """Properties of all nodes after four merges, of which one is older and one a repetition."""
    graph = graph_store.GraphStore(c.spark, folder(c.spark), FEW_BUCKETS)
    for batch in _graph_batches(c):
        graph.merge(batch)
    return graph.nodes().select("label", "key", F.explode("props").alias("name", "value"))


@query("graph_merge_counts", f"""WITH {GRAPH_BATCHES}, k AS (SELECT DISTINCT label, key FROM a), l AS (SELECT DISTINCT label, key FROM b), m AS (SELECT DISTINCT label, key FROM c), old AS (SELECT label, key FROM k UNION SELECT label, key FROM l)
SELECT 0 AS batch, count(*) AS nodes_created, 0::BIGINT AS nodes_updated, 0::BIGINT AS nodes_unchanged FROM k UNION ALL SELECT 1, sum((k.key IS NULL)::INT)::BIGINT, sum((k.key IS NOT NULL)::INT)::BIGINT, 0 FROM l LEFT JOIN k USING (label, key)
UNION ALL SELECT 2, sum((old.key IS NULL)::INT)::BIGINT, sum((old.key IS NOT NULL)::INT)::BIGINT, 0 FROM m LEFT JOIN old USING (label, key) UNION ALL SELECT 3, 0, 0, count(*) FROM l""")
def graph_merge_counts(c: Catalog) -> DataFrame:
    """What each merge created, updated and left: the repeated one leaves all."""
    graph = graph_store.GraphStore(c.spark, folder(c.spark), FEW_BUCKETS)
    told = [graph.merge(batch) for batch in _graph_batches(c)]
    return c.spark.createDataFrame([(i, x["nodes_created"], x["nodes_updated"], x["nodes_unchanged"]) for i, x in enumerate(told)], "batch int, nodes_created long, nodes_updated long, nodes_unchanged long")


# Update driver: the documents arrive, then a second file with unchanged, changed, blank and new ones

ARRIVED = "a AS (SELECT doc_id AS k, text FROM documents), b AS (SELECT CASE WHEN doc_id % 8 = 0 THEN doc_id + 1000000 ELSE doc_id END AS k, CASE WHEN doc_id % 10 = 0 THEN ' ' WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0)"


def _updated(c: Catalog) -> update.Updates:
    root, col = folder(c.spark), F.col
    docs = c.table("documents").select(col("doc_id").alias("item_key"), F.substring_index("text", "\n", 1).alias("title"), col("text").alias("body"), F.lit(1).cast("long").alias("stamp"))
    docs.coalesce(1).write.options(**TEXTS).parquet(f"{root}/arrived")
    body = F.when(col("item_key") % 10 == 0, " ").when(col("item_key") % 3 == 0, F.concat("body", F.lit(" more"))).otherwise(col("body"))
    key = F.when(col("item_key") % 8 == 0, col("item_key") + 1_000_000).otherwise(col("item_key"))
    docs.where("item_key % 2 = 0").select(key.alias("item_key"), "title", body.alias("body"), F.lit(2).cast("long").alias("stamp")).coalesce(1).write.mode("append").options(**TEXTS).parquet(f"{root}/arrived")
    updates = update.Updates(c.spark, f"{root}/library", FEW_BUCKETS)
    updates.run(ingest.stream(c.spark, f"{root}/arrived", docs.schema), f"{root}/state")
    remove(c.spark, f"{root}/arrived")
    return updates


@query("update_counters", f"WITH {ARRIVED} SELECT 0 AS batch, sum((trim(text) <> '')::INT)::BIGINT AS added, 0::BIGINT AS updated, 0::BIGINT AS skipped, sum((trim(text) = '')::INT)::BIGINT AS failed FROM a UNION ALL SELECT 1, sum((trim(b.text) <> '' AND a.k IS NULL)::INT)::BIGINT, sum((trim(b.text) <> '' AND a.text <> b.text)::INT)::BIGINT, sum((trim(b.text) <> '' AND a.text = b.text)::INT)::BIGINT, sum((trim(b.text) = '')::INT)::BIGINT FROM b LEFT JOIN (SELECT * FROM a WHERE trim(text) <> '') a USING (k)")
def update_counters(c: Catalog) -> DataFrame:
    updates = _updated(c)
    told = updates.counters()
    remove(c.spark, updates.store.root)
    return c.spark.createDataFrame([(n, x["added"], x["updated"], x["skipped"], x["failed"]) for n, x in told.items()], "batch int, added long, updated long, skipped long, failed long")


@query("update_sinks", f"WITH {ARRIVED}, n AS (SELECT coalesce(b.k, a.k) AS k, coalesce(b.text, a.text) AS text FROM (SELECT * FROM a WHERE trim(text) <> '') a FULL JOIN (SELECT * FROM b WHERE trim(text) <> '') b ON a.k = b.k) SELECT k AS item_key, md5(text) AS digest, ((length(text) + 1999) // 2000)::BIGINT AS chunks, ((length(text) + 1999) // 2000)::BIGINT AS vectors, true AS in_graph FROM n")
def update_sinks(c: Catalog) -> DataFrame:
    """What the tables of items, chunks, vectors and graph nodes hold after both batches."""
    store = _updated(c).store
    count = lambda name: store.read(name).groupBy("item_key").agg(F.count(F.lit(1)).alias(name))
    papers = store.read("nodes").where("label = 'Paper'").select(F.col("key").cast("long").alias("item_key"), F.lit(True).alias("__there"))
    rows = store.read("items").select("item_key", "digest").join(count("chunks"), "item_key", "left").join(count("vectors"), "item_key", "left").join(papers, "item_key", "left")
    out = stored(rows.select("item_key", "digest", "chunks", "vectors", F.coalesce("__there", F.lit(False)).alias("in_graph")))
    remove(c.spark, store.root)
    return out


# Searches and explorations as a whole

REQUEST = "thor and ther ing"


@query("full_search", f"""WITH {POSTINGS}, {ITEMS}, parts AS (SELECT * FROM (VALUES ('0', 'thor'), ('1', 'ther ing')) v(list, q)),
asked AS (SELECT list, term, count(*) AS qtf FROM (SELECT list, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM parts) WHERE term NOT IN ({STOP}) GROUP BY ALL),
l AS (SELECT list, id, round(sum(tf * idf * qtf * idf), 4) AS score FROM p JOIN voc USING (term) JOIN asked USING (term) GROUP BY ALL), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) AS rank FROM l) WHERE rank <= {4 * TOP}),
f AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(sum(score / rank), 4) AS score FROM r GROUP BY id)), o AS (FROM f WHERE rank <= {2 * TOP}), q AS (SELECT count(*) AS n, max(score) AS top FROM o)
SELECT id AS item_key, round(1.0 / (60 + rank), 6)::DOUBLE AS score, rank, 'decomposed' AS backends, 1::BIGINT AS n_backends, CASE WHEN n >= 10 AND top >= 0.7 THEN 'high' WHEN n >= 5 AND top >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, least(1.0, n / 10.0)::DOUBLE AS coverage, title, publication FROM o, q LEFT JOIN it ON id = item_key WHERE rank <= {TOP}""")
def full_search(c: Catalog) -> DataFrame:
    return Search(c).full(REQUEST, limit=TOP)


@query("explored_by_mode", f"""WITH {CONCEPTS}, {PAPERS}, {VECTORS}
SELECT 'temporal' AS strategy, year::VARCHAR AS id, count(DISTINCT paper)::DOUBLE AS score FROM e JOIN pa ON src = paper WHERE dst = {CONCEPT} AND year BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY year
UNION ALL SELECT * FROM (SELECT 'venue', venue, count(*)::DOUBLE AS score FROM pa WHERE field = 'ASIA' GROUP BY venue ORDER BY score DESC, venue LIMIT {TOP}) UNION ALL SELECT 'content_similarity', id::VARCHAR, similarity FROM ({_knn(7)})""")
def explored_by_mode(c: Catalog) -> DataFrame:
    rows = [explored(c, "temporal", CONCEPT, years=YEARS), explored(c, "venue", n=TOP, field="ASIA"), explored(c, "content_similarity", 7, n=TOP)]
    texts = [r.withColumn("id", F.col("id").cast("string")) for r in rows]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])


ORDERED = "o AS (SELECT o_orderkey AS key, year(o_orderdate) AS y, c_mktsegment AS segment, chr(65 + (o_orderkey % 26)::INT) || 'ann' AS name, 'KEY' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS item FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("kind_parameters", f"""WITH {ORDERED} SELECT key, 'graph' AS kind, name || ' Lee' AS who, 'memory for ' || lower(segment) AS what, y::VARCHAR AS low, '2003' AS high, NULL::VARCHAR AS keys FROM o WHERE key % 3 = 0
UNION ALL SELECT key, 'collection', NULL, lower(segment) || ' things', (key % 40 + 1)::VARCHAR, NULL, item || ',ABCD1234' FROM o WHERE key % 3 = 1 UNION ALL SELECT key, 'tag', NULL, lower(segment) || ',to read,' || lower(name), NULL, NULL, item FROM o WHERE key % 3 = 2""")
def kind_parameters(c: Catalog) -> DataFrame:
    """Parameters of requests by kind, against what the requests were made from."""
    col, text = F.col, lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    rows = c.table("orders").join(c.table("customer"), col("o_custkey") == col("c_custkey"))
    rows = rows.select(
        col("o_orderkey").alias("key"), F.year("o_orderdate").alias("y"), F.lower("c_mktsegment").alias("segment"), F.concat(F.char((65 + col("o_orderkey") % 26).cast("int")), F.lit("ann")).alias("name"),
        F.concat(F.lit("KEY"), F.lpad((col("o_orderkey") % 100000).cast("string"), 5, "0")).alias("item"),
    )
    graphs = rows.where("key % 3 = 0").select("key", ask.graph_parameters(text("How did work on memory for ", F.lower("segment"), " change from ", col("y"), " to 2003 by ", col("name"), " Lee?")).alias("p"))
    shelves = rows.where("key % 3 = 1").select("key", ask.collection_parameters(text("put the ", col("key") % 40 + 1, " latest papers ", col("item"), " and ABCD1234 into the collection \"", col("segment"), " Things\"")).alias("p"))
    tags = rows.where("key % 3 = 2").select("key", ask.tag_parameters(text("add tags ", col("segment"), ", 'to read' and \"", col("name"), "\" to ", col("item"))).alias("p"))
    none = F.lit(None).cast("string")
    one = graphs.select("key", F.lit("graph").alias("kind"), col("p.author").alias("who"), col("p.concept").alias("what"), col("p.start_year").cast("string").alias("low"), col("p.end_year").cast("string").alias("high"), none.alias("keys"))
    two = shelves.select("key", F.lit("collection"), none, "p.name", col("p.limit").cast("string"), none, F.array_join("p.keys", ","))
    return one.union(two).union(tags.select("key", F.lit("tag"), none, F.array_join("p.tags", ","), none, none, F.array_join("p.keys", ",")))
