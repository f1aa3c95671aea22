"""The registered queries of the retrieval, graph and library operators, with SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import items as entries
from lectern.functions import models
from lectern.functions import text as t
from lectern.functions import understanding as ask
from lectern.operators import fusion, graph, hits, indexing, lexical, library, summary, vector
from lectern.plans.search import Search
from lectern.session import ship
from lectern.sources import export
from lectern.sources.catalog import Catalog
from lectern.storage import kept, version
from lectern.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters of the queries.
TOP, LIST = 10, 20
PAPER, PERSON, CONCEPT, YEARS = 1, 1, 1, (1995, 2001)
#: Namespace of domain names (RFC 4122).
DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
STOP = ",".join(f"'{w}'" for w in t.STOP_WORDS)


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# Vectors

COSINE = "least(1.0, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))"
VECTORS = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _knn(seed: int, where: str = "true", n: int = TOP) -> str:
    return f"SELECT * FROM (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM (SELECT a.id, round({COSINE}, 6) AS similarity FROM v a, v b WHERE b.id = {seed} AND a.id <> {seed} AND {where})) WHERE rank <= {n}"


def _nearest(c: Catalog, seed: int, n: int = TOP, where=None) -> DataFrame:
    rows = c.vectors()
    return vector.nearest(rows, rows.where(F.col("id") == seed), n, where).select("id", "similarity", F.col("rank").cast("long").alias("rank"))


@query("dense_knn", f"WITH {VECTORS} {_knn(0)}")
def dense_knn(c: Catalog) -> DataFrame:
    return _nearest(c, 0)


@query("dense_knn_filtered", f"WITH {VECTORS} {_knn(0, 'a.label = 3')}")
def dense_knn_filtered(c: Catalog) -> DataFrame:
    return _nearest(c, 0, where=library.equals({"label": 3}))


@query("content_similarity", f"WITH {VECTORS} {_knn(5, n=5)}")
def content_similarity(c: Catalog) -> DataFrame:
    return _nearest(c, 5, 5)


@query("quantized_knn")
def quantized_knn(c: Catalog) -> DataFrame:
    return vector.nearest_quantized(c.vectors(), 0, TOP).select("id", "similarity", "rank")


# Terms

POSTINGS = f"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
p AS (SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP}) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
voc AS (SELECT term, df, cf, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term ORDER BY cf DESC, term LIMIT {lexical.FEATURES}), n)"""
ASKED = f"asked AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)) WHERE term NOT IN ({STOP}) GROUP BY term)"
SPARSE = "s AS (SELECT id, round(sum(tf * idf * qtf * idf), 4) AS score FROM p JOIN voc USING (term) JOIN asked USING (term) GROUP BY id)"


def _ranked(table: str, n: int, columns: str = "id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {table}) WHERE rank <= {n}"


def _postings(c: Catalog) -> DataFrame:
    return lexical.postings(c.table("documents"), "doc_id", "text")


def _vocabulary(c: Catalog, counts: DataFrame) -> DataFrame:
    return lexical.vocabulary(counts, c.table("documents").agg(F.count(F.lit(1)).alias("n")))


def _asked(c: Catalog) -> DataFrame:
    return c.table("benchmark").orderBy("item_id").limit(1).select("text")


def _sparse(c: Catalog, n: int) -> DataFrame:
    index = c.lexical_index()
    return lexical.sparse_search(index.postings, index.vocabulary, _asked(c), n)


@query("tfidf_vocab", f"WITH {POSTINGS} SELECT term, df, cf, idf FROM voc")
def tfidf_vocab(c: Catalog) -> DataFrame:
    return _vocabulary(c, _postings(c))


@query("tfidf_weights", f"WITH {POSTINGS} SELECT id, term, round(tf * idf, 6) AS weight FROM p JOIN voc USING (term)")
def tfidf_weights(c: Catalog) -> DataFrame:
    counts = _postings(c)
    return lexical.weights(counts, _vocabulary(c, counts))


@query("sparse_search", f"WITH {POSTINGS}, {ASKED}, {SPARSE} {_ranked('s', TOP)}")
def sparse_search(c: Catalog) -> DataFrame:
    return _sparse(c, TOP)


@query(
    "bm25_search",
    f"""WITH {POSTINGS}, {ASKED}, dl AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id), w AS (SELECT count(*) AS m, avg(dl) AS avgdl FROM dl),
h AS (SELECT p.* FROM p JOIN asked USING (term)), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT id, round(sum(ln(1 + (m - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
      FROM h JOIN d USING (term) JOIN dl USING (id), w GROUP BY id) {_ranked('s', TOP)}""",
)
def bm25_search(c: Catalog) -> DataFrame:
    index = c.lexical_index()
    return lexical.bm25_search(index.postings, _asked(c), TOP, lengths=index.lengths)


# Fusion: the dense list of vector 0 and the sparse list of the first benchmark item share numbers as ids

LISTS = f"""{VECTORS}, {POSTINGS}, {ASKED}, {SPARSE},
l AS (SELECT 'dense' AS list, id, similarity AS score, rank FROM ({_knn(0, n=LIST)}) UNION ALL SELECT 'sparse', id, score, rank FROM ({_ranked('s', LIST)}))"""


def _lists(c: Catalog) -> DataFrame:
    dense = _nearest(c, 0, LIST).select(F.lit("dense").alias("list"), "id", F.col("similarity").alias("score"), "rank")
    return dense.unionByName(_sparse(c, LIST).select(F.lit("sparse").alias("list"), "id", "score", F.col("rank").cast("long").alias("rank")))


@query("hybrid_rrf", f"WITH {LISTS}, f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(DISTINCT list, ',' ORDER BY list) AS found_in FROM l GROUP BY id) {_ranked('f', TOP, 'id, score, found_in')}")
def hybrid_rrf(c: Catalog) -> DataFrame:
    return fusion.rrf(_lists(c), TOP)


@query(
    "hybrid_dbsf",
    f"""WITH {LISTS}, m AS (SELECT list, avg(score) AS mu, stddev_samp(score) AS sd FROM l GROUP BY list),
f AS (SELECT id, round(sum(CASE WHEN coalesce(sd, 0) = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (score - (mu - 3 * sd)) / (6 * sd))) END), 6) AS score, string_agg(DISTINCT list, ',' ORDER BY list) AS found_in
      FROM l JOIN m USING (list) GROUP BY id) {_ranked('f', TOP, 'id, score, found_in')}""",
)
def hybrid_dbsf(c: Catalog) -> DataFrame:
    return fusion.dbsf(_lists(c), TOP)


@query("provenance", f"WITH {LISTS} SELECT id, string_agg(DISTINCT list, ',' ORDER BY list) AS backends, count(DISTINCT list) AS n_backends FROM l GROUP BY id")
def provenance(c: Catalog) -> DataFrame:
    return hits.provenance(_lists(c))


SUBQUERIES = ((0, 1.0), (1, 0.6), (2, 0.4))
DECOMPOSED = " UNION ALL ".join(f"SELECT 'q{i}' AS list, {w} AS importance, id, similarity, rank FROM ({_knn(i, n=LIST)})" for i, w in SUBQUERIES)


@query(
    "decomposed_merge",
    f"WITH {VECTORS}, l AS ({DECOMPOSED}), f AS (SELECT id, round(sum(similarity * importance / rank), 4) AS score, arg_max(list, struct_pack(part := similarity * importance / rank, list := list)) AS best_list FROM l GROUP BY id) {_ranked('f', TOP, 'id, score, best_list')}",
)
def decomposed_merge(c: Catalog) -> DataFrame:
    rows = c.vectors()
    asked = rows.where(F.col("id").isin([i for i, _ in SUBQUERIES]))
    lists = vector.nearest(rows, asked, LIST).select(F.concat(F.lit("q"), "query").alias("list"), "id", F.col("similarity").alias("score"), "rank")
    importance = c.spark.createDataFrame([(f"q{i}", w) for i, w in SUBQUERIES], "list string, importance double")
    return fusion.decomposed(lists, importance, TOP)


@query(
    "vector_graph_boost",
    f"""WITH {VECTORS}, h AS ({_knn(0, n=LIST)}), r AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1),
f AS (SELECT id, round(similarity * 0.7 + least(least(coalesce(n, 0), 5) / 10.0::DOUBLE, 0.3) * 0.3, 4) AS score FROM h LEFT JOIN r USING (id)) {_ranked('f', LIST)}""",
)
def vector_graph_boost(c: Catalog) -> DataFrame:
    concepts = c.edges("DISCUSSES_CONCEPT").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return fusion.graph_boost(_nearest(c, 0, LIST).select("id", F.col("similarity").alias("score")), concepts).select("id", "score", "rank")


@query("quality_metrics_a", f"""WITH {VECTORS}, h AS ({_knn(0, n=LIST)}) SELECT n, mean, low, high, deviation, share_high, CASE WHEN low >= 0.65 THEN 'high' WHEN low >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT count(*) AS n, round(avg(similarity), 6) AS mean, min(similarity) AS low, max(similarity) AS high, round(coalesce(stddev_samp(similarity), 0), 6) AS deviation, round(avg((similarity >= 0.75)::INT), 6) AS share_high FROM h)""")
def quality_metrics_a(c: Catalog) -> DataFrame:
    return hits.score_quality(_nearest(c, 0, LIST), "similarity")


@query("quality_metrics_b", f"""WITH {VECTORS}, h AS ({_knn(0, n=LIST)}), q AS (SELECT count(*) AS n, max(similarity) AS top FROM h), r AS (SELECT *, CASE WHEN n >= 10 AND top >= 0.7 THEN 'high' WHEN n >= 5 AND top >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM q) SELECT *, least(1.0, n / 10.0)::DOUBLE AS coverage, confidence = 'low' AS escalate FROM r""")
def quality_metrics_b(c: Catalog) -> DataFrame:
    return hits.coverage_quality(_nearest(c, 0, LIST), "similarity")


CHUNKS = "ch AS (SELECT doc_id AS item_key, i AS chunk_id, substring(text, i * 2000 + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 1999) // 2000)::BIGINT)) AS i FROM documents))"


@query("result_dedup", f"WITH {CHUNKS} SELECT item_key, min(chunk_id)::INT AS chunk_id FROM ch WHERE contains(lower(chunk), 'the') GROUP BY item_key")
def result_dedup(c: Catalog) -> DataFrame:
    found = c.chunks().where(F.lower("chunk").contains("the"))
    return hits.distinct_items(found, rank="chunk_id").select("item_key", "chunk_id")


@query("chunk_text_dedup", f"WITH {CHUNKS} SELECT item_key, chunk_id::INT AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(lower(trim(chunk))) ORDER BY item_key, chunk_id) AS n FROM ch WHERE length(trim(chunk)) > 0) WHERE n = 1")
def chunk_text_dedup(c: Catalog) -> DataFrame:
    return hits.distinct_texts(c.chunks(), "chunk", ["item_key", "chunk_id"]).select("item_key", "chunk_id")


# Graph

CONCEPTS = "e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
PEOPLE = "e AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem)"
CITES = "e AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"
PAPERS = "pa AS (SELECT o_orderkey AS paper, year(o_orderdate)::INT AS year, o_orderpriority AS venue, r_name AS field FROM orders LEFT JOIN (SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey)"
FEW = "array_to_string(list_slice(list_sort(list(DISTINCT {0})), 1, {1}), ',')"


@query("related_papers", f"WITH {CONCEPTS} SELECT a.src AS id, count(DISTINCT a.dst) AS shared, {FEW.format('a.dst', 5)} AS examples FROM e a JOIN e b USING (dst) WHERE b.src = {PAPER} AND a.src <> {PAPER} GROUP BY 1 ORDER BY shared DESC, id LIMIT {TOP}")
def related_papers(c: Catalog) -> DataFrame:
    return graph.related(c.edges("DISCUSSES_CONCEPT"), PAPER, TOP)


BOTH = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("citation_chain", f"WITH RECURSIVE {CITES}, {BOTH}, w AS (SELECT {PAPER}::BIGINT AS id, 0 AS hops UNION SELECT u.dst, hops + 1 FROM w JOIN u ON u.src = w.id WHERE hops < 3) SELECT id, min(hops)::INT AS hops FROM w GROUP BY id HAVING min(hops) > 0")
def citation_chain(c: Catalog) -> DataFrame:
    return graph.chain(c.edges("CITES"), PAPER, 3)


def _neighbours(edges: str, start: int, hops: int, n: int) -> str:
    parts, seen = [f"s0 AS (SELECT {start}::BIGINT AS id)"], "SELECT id FROM s0"
    for i in range(1, hops + 1):
        parts.append(f"s{i} AS (SELECT dst AS id, {i} AS hops, count(DISTINCT src) AS papers FROM e WHERE src IN (SELECT src FROM e WHERE dst IN (SELECT id FROM s{i - 1})) AND dst NOT IN ({seen}) GROUP BY dst)")
        seen += f" UNION SELECT id FROM s{i}"
    rows = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, hops + 1))
    return f"WITH {edges}, {', '.join(parts)} SELECT id, hops::INT AS hops, papers FROM ({rows}) ORDER BY hops, papers DESC, id LIMIT {n}"


@query("related_concepts", _neighbours(CONCEPTS, CONCEPT, 2, LIST))
def related_concepts(c: Catalog) -> DataFrame:
    return graph.neighbours(c.edges("DISCUSSES_CONCEPT"), CONCEPT, 2, LIST)


@query("collaborators", _neighbours(PEOPLE, PERSON, 1, LIST))
def collaborators(c: Catalog) -> DataFrame:
    return graph.neighbours(c.edges("AUTHORED_BY"), PERSON, 1, LIST)


@query("seminal_indegree", f"WITH {CITES} SELECT o_orderkey AS paper, count(src) AS citations FROM orders LEFT JOIN e ON dst = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {LIST}")
def seminal_indegree(c: Catalog) -> DataFrame:
    return graph.in_degree(c.edges("CITES"), c.papers(), LIST)


def _pagerank(rounds: int) -> str:
    parts = ["deg AS (SELECT src, count(*) AS degree FROM e GROUP BY src)", "n AS (SELECT count(*) AS n FROM orders)", "r0 AS (SELECT o_orderkey AS id, 1.0::DOUBLE / n AS score FROM orders, n)"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT o_orderkey AS id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS score FROM orders, n LEFT JOIN (SELECT dst, sum(score / degree) AS got FROM e JOIN deg USING (src) JOIN r{i - 1} ON r{i - 1}.id = e.src GROUP BY dst) ON dst = o_orderkey)")
    return f"WITH {CITES}, {', '.join(parts)}, {PAPERS} SELECT id, round(score * n, 4) AS score FROM r{rounds} JOIN pa ON id = paper, n WHERE field = 'EUROPE' ORDER BY score DESC, id LIMIT {LIST}"


@query("seminal_pagerank", _pagerank(10))
def seminal_pagerank(c: Catalog) -> DataFrame:
    papers = c.papers()
    nodes = papers.select(F.col("paper").alias("id"))
    ranks = graph.pagerank(c.edges("CITES"), nodes)
    chosen = ranks.join(papers.where(F.col("field") == "EUROPE").select(F.col("paper").alias("id")), "id", "left_semi")
    whole = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))
    return chosen.crossJoin(whole).select("id", F.round(F.col("score") * F.col("n"), 4).alias("score")).orderBy(F.desc("score"), "id").limit(LIST)


YEARLY = f"y AS (SELECT year, count(DISTINCT paper) AS papers, {FEW.format('paper', 3)} AS examples FROM e JOIN pa ON src = paper WHERE dst = {CONCEPT} AND year BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY year)"


def _yearly(c: Catalog) -> DataFrame:
    return graph.yearly(c.edges("DISCUSSES_CONCEPT"), c.papers(), CONCEPT, *YEARS)


@query("topic_yearly", f"WITH {CONCEPTS}, {PAPERS}, {YEARLY} SELECT * FROM y")
def topic_yearly(c: Catalog) -> DataFrame:
    return _yearly(c)


@query("topic_cooccur", f"WITH {CONCEPTS}, {PAPERS} SELECT a.dst AS id, count(DISTINCT a.src) AS papers, min(year)::INT AS first_year FROM e a JOIN e b USING (src) JOIN pa ON paper = a.src WHERE b.dst = {CONCEPT} AND a.dst <> {CONCEPT} AND year BETWEEN {YEARS[0]} AND {YEARS[1]} GROUP BY 1 ORDER BY papers DESC, id LIMIT {TOP}")
def topic_cooccur(c: Catalog) -> DataFrame:
    return graph.co_occurring(c.edges("DISCUSSES_CONCEPT"), c.papers(), CONCEPT, *YEARS, TOP)


@query("topic_trend", f"WITH {CONCEPTS}, {PAPERS}, {YEARLY}, o AS (SELECT papers, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM y), s AS (SELECT count(*) AS n_years, coalesce(sum(papers) FILTER (i <= n // 2), 0)::BIGINT AS early, coalesce(sum(papers) FILTER (i > n // 2), 0)::BIGINT AS late FROM o) SELECT *, CASE WHEN n_years < 3 THEN 'insufficient' WHEN late > 1.5 * early THEN 'increasing' WHEN late < 0.67 * early THEN 'decreasing' ELSE 'stable' END AS trend FROM s")
def topic_trend(c: Catalog) -> DataFrame:
    return graph.trend(_yearly(c))


@query("venue_ranking", f"WITH {PAPERS} SELECT venue, count(*) AS papers, {FEW.format('paper', 3)} AS examples FROM pa WHERE field = 'ASIA' GROUP BY venue ORDER BY papers DESC, venue LIMIT {TOP}")
def venue_ranking(c: Catalog) -> DataFrame:
    return graph.venues(c.papers(), TOP, "ASIA")


@query("graph_stats", f"SELECT 'node' AS kind, 'Paper' AS name, count(*) AS n FROM orders UNION ALL SELECT 'node', 'Person', count(*) FROM supplier UNION ALL SELECT 'node', 'Concept', count(*) FROM part UNION ALL (WITH {CITES} SELECT 'edge', 'CITES', count(*) FROM e) UNION ALL (WITH {PEOPLE} SELECT 'edge', 'AUTHORED_BY', count(*) FROM e) UNION ALL (WITH {CONCEPTS} SELECT 'edge', 'DISCUSSES_CONCEPT', count(*) FROM e)")
def graph_stats(c: Catalog) -> DataFrame:
    label = lambda table, name: c.table(table).select(F.lit(name).alias("label"))
    nodes = label("orders", "Paper").union(label("supplier", "Person")).union(label("part", "Concept"))
    edges = [c.edges(rel).select(F.lit(rel).alias("rel")) for rel in ("CITES", "AUTHORED_BY", "DISCUSSES_CONCEPT")]
    return graph.statistics(nodes, edges[0].union(edges[1]).union(edges[2]))


LINES = "ln AS (SELECT l_orderkey AS paper, l_orderkey * 10 + l_linenumber AS chunk, l_partkey, l_suppkey FROM lineitem)"


def _mentions(c: Catalog) -> DataFrame:
    """chunk, paper, entity, label: an order's lines are its chunks, their parts and suppliers what they mention."""
    lines = c.table("lineitem").select(F.col("l_orderkey").alias("paper"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), "l_partkey", "l_suppkey")
    both = F.array(F.struct(F.concat(F.lit("p"), "l_partkey").alias("entity"), F.lit("Concept").alias("label")), F.struct(F.concat(F.lit("s"), "l_suppkey").alias("entity"), F.lit("Person").alias("label")))
    return lines.select("paper", "chunk", F.explode(both).alias("e")).select("paper", "chunk", "e.entity", "e.label")


MENTIONS = f"{LINES}, me AS (SELECT paper, chunk, 'p' || l_partkey AS entity, 'Concept' AS label FROM ln UNION SELECT paper, chunk, 's' || l_suppkey, 'Person' FROM ln)"


@query("chunk_entities", f"WITH {MENTIONS} SELECT chunk, least(count(*), 5) AS n, array_to_string(list_slice(list_sort(list(entity)), 1, 5), ',') AS entities FROM me GROUP BY chunk")
def chunk_entities(c: Catalog) -> DataFrame:
    rows = _mentions(c)
    return graph.entities_of(rows.select("chunk").distinct(), rows, 5)


@query("entity_propagation", f"WITH {MENTIONS} SELECT DISTINCT paper AS src, unnest(['MENTIONS', CASE label WHEN 'Concept' THEN 'DISCUSSES_CONCEPT' ELSE 'AUTHORED_BY' END]) AS rel, entity AS dst FROM me")
def entity_propagation(c: Catalog) -> DataFrame:
    rows = _mentions(c)
    return graph.propagated(rows.select("paper", "chunk").distinct(), rows.select("chunk", "entity", "label"), {"Concept": "DISCUSSES_CONCEPT", "Person": "AUTHORED_BY"})


@query("entity_search", "SELECT p_partkey AS node, p_name AS name, p_type AS description, 'Concept' AS label FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') ORDER BY name, node LIMIT 10")
def entity_search(c: Catalog) -> DataFrame:
    nodes = c.table("part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit("Concept").alias("label"))
    return graph.found_entities(nodes, "ring", ["Concept"])


@query("isolated_papers", "SELECT o_orderkey AS paper FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def isolated_papers(c: Catalog) -> DataFrame:
    return graph.without(c.papers().select("paper"), c.table("lineitem").select(F.col("l_orderkey").alias("paper")))


# Text

@query("fixed_chunks", f"WITH {CHUNKS} SELECT item_key, chunk_id::INT AS chunk_id, chunk FROM ch")
def fixed_chunks(c: Catalog) -> DataFrame:
    return c.chunks()


@query("fulltext_rebuild", "SELECT doc_id AS item_key, text FROM documents WHERE length(text) > 0")
def fulltext_rebuild(c: Catalog) -> DataFrame:
    return indexing.rebuilt_texts(c.chunks())


@query("html_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages")
def html_strip(c: Catalog) -> DataFrame:
    return c.page_texts()


@query("keyword_in_context", "SELECT doc_id, substring(text, greatest(pos - 100, 1), pos - greatest(pos - 100, 1)) || '**' || substring(text, pos, 5) || '**' || substring(text, pos + 5, 195) AS context FROM (SELECT doc_id, text, instr(lower(text), 'thing') AS pos FROM documents) WHERE pos > 0")
def keyword_in_context(c: Catalog) -> DataFrame:
    found = c.table("documents").select("doc_id", t.in_context(F.col("text"), "thing").alias("context"))
    return found.where("context IS NOT NULL")


@query("note_titles", "SELECT key, parent_key, CASE WHEN length(line) > 50 THEN substring(line, 1, 50) || '...' ELSE line END AS title FROM (SELECT conv_id || '-' || turn AS key, conv_id AS parent_key, split_part(text, chr(10), 1) AS line FROM conversations)")
def note_titles(c: Catalog) -> DataFrame:
    return c.children().select("key", "parent_key", t.note_title(F.col("body")).alias("title"))


@query("key_concepts", f"SELECT concept, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}{{3,}}|\\p{{Ll}}+-\\p{{Ll}}+')) AS concept FROM documents) WHERE lower(concept) NOT IN ({STOP}) GROUP BY concept HAVING count(*) > 1 ORDER BY n DESC, concept LIMIT 10")
def key_concepts(c: Catalog) -> DataFrame:
    return ask.key_concepts(c.table("documents"), "text", t.STOP_WORDS)


def _intent_sql(kind: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''regexp_matches(lower(trim(text)), '{p}')''' for p in patterns)} THEN '{name}'" for name, _, patterns in ask.GROUPS[kind])
    confidence = " ".join(f"WHEN '{name}' THEN {c}::DOUBLE" for name, c, _ in ask.GROUPS[kind])
    default, low = ask.DEFAULTS[kind]
    return f"SELECT key, intent, CASE intent {confidence} ELSE {low}::DOUBLE END AS confidence FROM (SELECT conv_id || '-' || turn AS key, CASE {cases} ELSE '{default}' END AS intent FROM conversations)"


@query("query_intent", _intent_sql("search").replace("'s|", "''s|"))
def query_intent(c: Catalog) -> DataFrame:
    return c.children().select("key", ask.intent_column(F.col("body")).alias("i")).select("key", "i.intent", "i.confidence")


@query(
    "query_decompose",
    r"""WITH p AS (SELECT item_id, trim(text) AS w FROM benchmark), q AS (SELECT item_id, w, regexp_split_to_array(w, '(?i)\s+(?:and|with|plus)\s+') AS a, regexp_split_to_array(w, '(?i)\s+or\s+') AS o, string_split(w, ',') AS c,
  CASE WHEN regexp_matches(w, '(?i)\s+(about|in|on|for|of|using|through)\s+') THEN regexp_extract(w, '(?is)^(.*?)\s+(?:about|in|on|for|of|using|through)\s+(.*)$', ['l', 'r']) END AS s,
  regexp_extract_all(w, '\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)*') AS h FROM p),
k AS (SELECT item_id, w, [{'t': w, 'k': 'full', 'i': 1.0::DOUBLE}] AS one, s, len(h) AS n, list_transform(list_filter(list_transform(a, lambda x: trim(x)), lambda x: x <> ''), lambda x: {'t': x, 'k': 'required', 'i': 1.0::DOUBLE}) AS a,
  list_transform(list_filter(list_transform(o, lambda x: trim(x)), lambda x: x <> ''), lambda x: {'t': x, 'k': 'optional', 'i': 0.7::DOUBLE}) AS o,
  list_transform(list_filter(list_transform(c, lambda x: trim(x)), lambda x: x <> ''), lambda x: {'t': x, 'k': 'support', 'i': 0.5::DOUBLE}) AS c,
  list_transform(list_filter([trim(s.l), trim(s.r)], lambda x: x <> ''), lambda x: {'t': x, 'k': 'support', 'i': 0.6::DOUBLE}) AS d,
  list_transform(list_slice(list_filter(h, lambda x: contains(x, ' ')), 1, 3), lambda x: {'t': x, 'k': 'phrase', 'i': 0.4::DOUBLE}) AS h FROM q),
f AS (SELECT item_id, CASE WHEN len(a) > 1 THEN a WHEN len(o) > 1 THEN o WHEN s IS NOT NULL THEN list_concat(one, d) WHEN len(c) > 1 THEN list_concat(one, c) WHEN n > 1 THEN list_concat(one, h) ELSE [{'t': w, 'k': 'simple', 'i': 1.0::DOUBLE}] END AS l FROM k)
SELECT item_id, i::INT AS part, l[i + 1].t AS text, l[i + 1].k AS kind, l[i + 1].i AS importance FROM (SELECT *, unnest(range(0, len(l))) AS i FROM f)""",
)
def query_decompose(c: Catalog) -> DataFrame:
    parts = c.table("benchmark").select("item_id", F.posexplode(ask.decompose_column(F.col("text"))).alias("part", "p"))
    return parts.select("item_id", "part", "p.text", "p.kind", "p.importance")


SYNONYM_MAP = "MAP {" + ", ".join(f"'{w}': '{' '.join(s[:2])}'" for w, s in ask.SYNONYMS.items()) + "}"


@query("query_expand", rf"""SELECT item_id, text || ' ' || array_to_string(list_filter(list_transform(words, lambda w: {SYNONYM_MAP}[w]), lambda x: x IS NOT NULL), ' ') AS expanded
FROM (SELECT item_id, text, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) AS words FROM (SELECT item_id, text, regexp_split_to_array(lower(trim(text)), '\s+') AS l FROM benchmark))""")
def query_expand(c: Catalog) -> DataFrame:
    return c.table("benchmark").select("item_id", ask.expand_column(F.col("text")).alias("expanded"))


# Indexing

PREPRINTS = "i AS (SELECT doc_id AS item_key, CASE WHEN doc_id % 3 = 0 THEN 'preprint' ELSE 'journalArticle' END AS item_type, CASE WHEN doc_id % 7 = 0 THEN 'DOI ' || n_chars END AS doi, split_part(text, chr(10), 1) AS title FROM documents)"


@query("preprint_dedup", rf"WITH {PREPRINTS}, k AS (SELECT *, regexp_replace(lower(doi), '\s+', '', 'g') AS d, regexp_replace(lower(title), '\s+', '', 'g') AS t FROM i) SELECT item_key, item_type FROM k WHERE item_type <> 'preprint' OR ((d IS NULL OR d = '' OR d NOT IN (SELECT d FROM k WHERE item_type = 'journalArticle' AND d IS NOT NULL)) AND (t IS NULL OR t = '' OR t NOT IN (SELECT t FROM k WHERE item_type = 'journalArticle' AND t IS NOT NULL)))")
def preprint_dedup(c: Catalog) -> DataFrame:
    items = c.table("documents").select(
        F.col("doc_id").alias("item_key"), F.when(F.col("doc_id") % 3 == 0, "preprint").otherwise("journalArticle").alias("item_type"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("DOI "), "n_chars")).alias("doi"), F.substring_index("text", "\n", 1).alias("title"),
    )
    return indexing.without_published_preprints(items).select("item_key", "item_type")


@query("parent_resolve", "SELECT conv_id || '-' || turn AS key, conv_id::VARCHAR AS parent, doc_id IS NOT NULL AS known FROM conversations LEFT JOIN documents ON conv_id = doc_id")
def parent_resolve(c: Catalog) -> DataFrame:
    return indexing.resolved_parents(c.children(), c.items())


@query("incremental_new_keys", "SELECT doc_id AS item_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_new_keys(c: Catalog) -> DataFrame:
    return indexing.new_rows(c.table("documents").select(F.col("doc_id").alias("item_key")), c.table("labels").select(F.col("doc_id").alias("item_key")), "item_key")


@query("upsert_merge", "WITH n AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) SELECT c_custkey AS user_id, -1::BIGINT AS event_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n")
def upsert_merge(c: Catalog) -> DataFrame:
    old = c.table("customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"), F.lit(None).cast("timestamp").alias("ts"))
    new = c.table("events").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return indexing.merged(old, new, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


# Library

TAGS = "tg AS (SELECT doc_id AS item_key, unnest([lang, source]) AS tag FROM documents UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END FROM labels UNION ALL SELECT doc_id, 'Toxic' FROM labels WHERE toxic = 1)"


@query("tag_list", f"WITH {TAGS} SELECT tag, count(DISTINCT item_key) AS items, upper(substring(tag, 1, 1)) AS letter FROM tg WHERE tag IS NOT NULL GROUP BY tag")
def tag_list(c: Catalog) -> DataFrame:
    return library.tag_counts(c.item_tags())


@query("tag_expression", f"WITH {TAGS} SELECT DISTINCT item_key FROM tg a WHERE EXISTS (FROM tg b WHERE b.item_key = a.item_key AND tag IN ('en', 'de')) AND EXISTS (FROM tg b WHERE b.item_key = a.item_key AND tag = 'Good') AND NOT EXISTS (FROM tg b WHERE b.item_key = a.item_key AND tag = 'Toxic')")
def tag_expression(c: Catalog) -> DataFrame:
    return library.tagged(c.item_tags(), ["en || de", "Good", "-Toxic"])


def _tag_sets(c: Catalog) -> DataFrame:
    return c.table("documents").select(F.col("doc_id").alias("item_key"), F.array("lang", "source").alias("tags"))


@query("tag_add", "SELECT doc_id AS item_key, CASE WHEN lang = 'en' THEN concat_ws(',', lang, source, 'New') ELSE concat_ws(',', lang, source, 'EN', 'New') END AS tags FROM documents")
def tag_add(c: Catalog) -> DataFrame:
    new = F.array(F.lit("EN"), F.lit("New"), F.lit("new"))
    return _tag_sets(c).select("item_key", F.array_join(entries.tags_added(F.col("tags"), new), ",").alias("tags"))


@query("tag_remove", "SELECT doc_id AS item_key, array_to_string(list_filter([lang, source], lambda x: lower(x) NOT IN ('en', 'src1')), ',') AS tags FROM documents")
def tag_remove(c: Catalog) -> DataFrame:
    return _tag_sets(c).select("item_key", F.array_join(entries.tags_removed(F.col("tags"), F.array(F.lit("EN"), F.lit("Src1"))), ",").alias("tags"))


COLLECTIONS = "c AS (SELECT 'r' || r_regionkey AS key, r_name AS name, NULL AS parent_key FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer)"


@query("collection_tree", f"WITH RECURSIVE {COLLECTIONS}, w AS (SELECT key, name AS path, 0 AS level FROM c WHERE parent_key IS NULL OR parent_key NOT IN (SELECT key FROM c) UNION ALL SELECT c.key, path || '/' || name, level + 1 FROM c JOIN w ON c.parent_key = w.key) SELECT * FROM w")
def collection_tree(c: Catalog) -> DataFrame:
    key = lambda p, k: F.concat(F.lit(p), k)
    rows = c.table("region").select(key("r", "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_key"))
    rows = rows.union(c.table("nation").select(key("n", "n_nationkey"), "n_name", key("r", "n_regionkey"))).union(c.table("customer").select(key("c", "c_custkey"), "c_name", key("n", "c_nationkey")))
    return library.collection_tree(rows)


ITEMS = "it AS (SELECT doc_id AS item_key, lang AS item_type, split_part(text, chr(10), 1) AS title, source AS publication, text AS body, strftime(o_orderdate, '%Y-%m-%d') AS date, c_name AS author FROM documents LEFT JOIN orders ON doc_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"


@query("recent_items", f"WITH {ITEMS} SELECT item_key, date, author FROM it WHERE date IS NOT NULL ORDER BY date DESC, item_key LIMIT 100")
def recent_items(c: Catalog) -> DataFrame:
    return library.recent(c.items(), 1000).select("item_key", "date", "author")


@query("keyword_search", f"WITH {ITEMS} SELECT item_key, title FROM it WHERE contains(lower(concat_ws(' ', title, author, date)), 'the') AND contains(lower(concat_ws(' ', title, author, date)), '199') ORDER BY item_key LIMIT 50")
def keyword_search(c: Catalog) -> DataFrame:
    return library.searched(c.items(), "The 199", ["title", "author", "date"], 50).select("item_key", "title")


@query("note_search", "SELECT conv_id || '-' || turn AS key, conv_id AS parent_key FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')")
def note_search(c: Catalog) -> DataFrame:
    return c.children().where((F.col("item_type") == "user") & F.lower("body").contains("the")).select("key", "parent_key")


@query("attachment_pick", "SELECT parent, key FROM (SELECT conv_id AS parent, conv_id || '-' || turn AS key, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, conv_id || '-' || turn) AS n FROM conversations) WHERE n = 1")
def attachment_pick(c: Catalog) -> DataFrame:
    kind = F.when(F.col("item_type") == "assistant", "application/pdf").when(F.col("item_type") == "user", "text/html").otherwise("text/plain")
    return library.preferred(c.children().select(F.col("parent_key").alias("parent"), "key", kind.alias("content_type"))).select("parent", "key")


@query("fulltext_coverage", "SELECT lang AS item_type, count(*) AS n, sum((length(text) >= 100)::INT)::BIGINT AS with_text, round(sum((length(text) >= 100)::INT) / count(*), 4) AS share FROM documents GROUP BY lang")
def fulltext_coverage(c: Catalog) -> DataFrame:
    return library.text_coverage(c.items())


@query("type_distribution", "SELECT lang AS item_type, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, item_type LIMIT 20")
def type_distribution(c: Catalog) -> DataFrame:
    return library.types(c.items())


@query("repeated_titles", f"WITH {ITEMS} SELECT title, count(*) AS n FROM it GROUP BY title HAVING count(*) > 1 ORDER BY n DESC, title LIMIT 10")
def repeated_titles(c: Catalog) -> DataFrame:
    return library.repeated_titles(c.items())


@query("cache_stats", "SELECT count(*) AS n, sum(length(props))::BIGINT AS chars, min(event_id) AS first, max(event_id) AS last FROM events")
def cache_stats(c: Catalog) -> DataFrame:
    return library.cache_statistics(c.table("events"), "props", "event_id")


@query("bibtex_entries", rf"""WITH {ITEMS}, f AS (SELECT item_key, '@misc{{' || coalesce(regexp_extract(author, '([\p{{L}}\p{{N}}#]+)[^\p{{L}}\p{{N}}#]*$', 1), '') || coalesce(substring(date, 1, 4), '') || '_' || item_key AS head,
[title, author, substring(date, 1, 4), publication] AS v, ['title', 'author', 'year', 'journal'] AS k FROM it)
SELECT item_key, array_to_string(list_concat([head], list_transform(list_filter(list_zip(k, v), lambda z: z[2] IS NOT NULL AND z[2] <> ''), lambda z: '  ' || z[1] || ' = {{' || regexp_replace(z[2], '([{{}}])', '\\\1', 'g') || '}}')), ',' || chr(10)) || chr(10) || '}}' AS entry FROM f""")
def bibtex_entries(c: Catalog) -> DataFrame:
    col = F.col
    return c.items().select("item_key", entries.bibtex(col("item_type"), col("item_key"), col("author"), col("title"), F.substring("date", 1, 4), col("publication")).alias("entry"))


@query("markdown_entries", rf"""WITH {ITEMS} SELECT item_key, array_to_string(['---' || chr(10) || 'title: "' || replace(coalesce(title, ''), '"', '\"') || '"' || chr(10) || 'authors: "' || replace(coalesce(author, ''), '"', '\"') || '"' || chr(10) || 'date: "' || coalesce(date, '') || '"' || chr(10) || 'type: "' || coalesce(item_type, '') || '"' || chr(10) || 'key: ' || item_key || chr(10) || '---', '# ' || coalesce(title, ''), coalesce(body, '')], chr(10) || chr(10)) AS document FROM it""")
def markdown_entries(c: Catalog) -> DataFrame:
    col = F.col
    return c.items().select("item_key", entries.markdown(col("item_key"), col("title"), col("author"), col("date"), col("item_type"), col("body")).alias("document"))


QUESTIONS = {"topic": ("the", "of", "what"), "method": ("with", "by", "how"), "result": ("that", "this", "are"), "limits": ("not", "for", "from")}


@query("summarize_aspects", f"WITH {CHUNKS}, q AS (SELECT * FROM (VALUES {', '.join(f'''('{q}', '{w}')''' for q, ws in QUESTIONS.items() for w in ws)}) AS t(question, word)), " + r"""w AS (SELECT DISTINCT item_key, chunk_id, word FROM (SELECT item_key, chunk_id, unnest(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+')) AS word FROM ch)), s AS (SELECT question, item_key, chunk_id::INT AS chunk_id, count(*) AS score FROM w JOIN q USING (word) GROUP BY ALL)
SELECT question, item_key, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, item_key, chunk_id) AS rank FROM s) WHERE rank <= 3""")
def summarize_aspects(c: Catalog) -> DataFrame:
    asked = c.spark.createDataFrame([(q, list(w)) for q, w in QUESTIONS.items()], "question string, words array<string>")
    return library.top_passages(c.chunks(), asked, 3)


@query("smart_search")
def smart_search(c: Catalog) -> DataFrame:
    return Search(c).smart(_asked(c).first()[0], seed=0, limit=TOP)


@query("stream_upsert", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(c: Catalog) -> DataFrame:
    return ingest.upserted_events(c.spark, c.path)


@query(
    "graphml_lines",
    f"""WITH n AS (SELECT s_suppkey AS node, s_name AS name FROM supplier), {PEOPLE}
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<key id="label" for="node" attr.name="label" attr.type="string"/>' || chr(10)
  || '<key id="name" for="node" attr.name="name" attr.type="string"/>' || chr(10) || '<key id="rel" for="edge" attr.name="rel" attr.type="string"/>' || chr(10) || '<graph edgedefault="directed">' AS value, 0 AS part
UNION ALL SELECT '<node id="' || node || '"><data key="label">Person</data><data key="name">' || name || '</data></node>', 1 FROM n
UNION ALL SELECT '<edge source="' || a.node || '" target="' || b.node || '"><data key="rel">SHARED_PAPER</data></edge>', 2 FROM (SELECT DISTINCT x.dst AS a, y.dst AS b FROM e x JOIN e y USING (src) WHERE x.dst < y.dst) JOIN n a ON a = a.node JOIN n b ON b = b.node
UNION ALL SELECT '</graph>' || chr(10) || '</graphml>', 3""",
)
def graphml_lines(c: Catalog) -> DataFrame:
    """The whole document: people, and an edge between two who wrote a paper together."""
    nodes = c.table("supplier").select(F.col("s_suppkey").alias("node"), F.lit("Person").alias("label"), F.col("s_name").alias("name"))
    wrote = c.edges("AUTHORED_BY")
    pairs = wrote.join(wrote.withColumnRenamed("dst", "other"), "src").where("dst < other").select(F.col("dst").alias("src"), F.col("other").alias("dst")).distinct()
    return export.graphml(nodes, pairs.withColumn("rel", F.lit("SHARED_PAPER")))


@query("section_chunks", r"SELECT doc_id AS item_key, i::INT AS chunk_id, array_to_string(list_slice(w, i * 200 + 1, i * 200 + 200), ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, ((len(w) + 199) // 200)::BIGINT)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\x0B\f]+'), lambda x: x <> '') AS w FROM documents))")
def section_chunks(c: Catalog) -> DataFrame:
    return c.table("documents").select(F.col("doc_id").alias("item_key"), F.posexplode(t.token_windows(F.col("text"), 200)).alias("chunk_id", "chunk"))


@query(
    "point_ids",
    f"""WITH {CHUNKS}, h AS (SELECT item_key, chunk_id::INT AS chunk_id, sha1(unhex('{DNS.replace('-', '')}') || encode('lectern.' || item_key || '_chunk_' || chunk_id)) AS d FROM ch)
SELECT item_key, chunk_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', d[17:17]), 1) || d[18:20] || '-' || d[21:32] AS point_id FROM h""",
)
def point_ids(c: Catalog) -> DataFrame:
    """A name-based UUID per chunk, by which an index is overwritten."""
    name = F.concat(F.lit("lectern."), "item_key", F.lit("_chunk_"), "chunk_id")
    return c.chunks().select("item_key", "chunk_id", t.uuid5(F.lit(DNS), name).alias("point_id"))


@query("semantic_chunks")
def semantic_chunks(c: Catalog) -> DataFrame:
    """Chunks nearest to a request by the stand-in embedder, reranked by the stand-in reranker."""
    ship(c.spark)
    asked = _asked(c).first()[0]
    chunks = c.chunks().select(F.concat_ws("_chunk_", "item_key", "chunk_id").alias("id"), F.col("chunk").alias("text"))
    vectors = kept(c.spark, f"chunk vectors of {c.path}", version(c.spark, f"{c.path}/documents.parquet"), lambda: chunks.withColumn("vector", models.embedded(F.col("text"))))
    query_row = c.spark.createDataFrame([("request", asked)], "id string, text string").withColumn("vector", models.embedded(F.col("text")))
    found = vector.nearest(vectors, query_row, TOP).select("id", "similarity", "rank")
    ranked = models.reranked(found.join(chunks, "id"), asked)
    return ranked.select(t.parent_key(F.col("id"), F.lit(None).cast("string")).alias("item_key"), "id", "similarity", "rank")


@query("grouped_children", "SELECT conv_id AS parent_key, role AS item_type, count(*) AS n, array_to_string(list_sort(list(conv_id || '-' || turn)), ',') AS keys FROM conversations GROUP BY conv_id, role")
def grouped_children(c: Catalog) -> DataFrame:
    return summary.grouped_children(c.children())


@query("audit_types", "SELECT lang AS item_type, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang ORDER BY n DESC, item_type LIMIT 10")
def audit_types(c: Catalog) -> DataFrame:
    return summary.audit(c.items(), c.table("labels").where("toxic = 1").select(F.col("doc_id").alias("item_key")))


@query("migration_counts", f"WITH {MENTIONS} SELECT 'papers' AS name, count(*) AS n FROM orders UNION ALL SELECT 'papers with chunks', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'chunk links', count(DISTINCT chunk) FROM me UNION ALL SELECT 'chunks with entities', count(DISTINCT chunk) FROM me UNION ALL SELECT 'paper entity links', count(DISTINCT (l_orderkey, l_suppkey)) FROM lineitem")
def migration_counts(c: Catalog) -> DataFrame:
    rows = _mentions(c)
    edges = c.edges("AUTHORED_BY").withColumn("rel", F.lit("AUTHORED_BY"))
    return summary.migration_counts(c.papers().select("paper"), rows.select("paper", "chunk").distinct(), rows.select("chunk", "entity"), edges)


@query("full_summaries", r"SELECT doc_id AS item_key, round(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0B\f]+'), lambda x: x <> '')) * 1.3)::BIGINT AS tokens FROM documents")
def full_summaries(c: Catalog) -> DataFrame:
    return c.items().select("item_key", summary.tokens_of(F.col("body")).alias("tokens"))
