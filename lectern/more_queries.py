"""More registered queries: library management, request understanding, indexing, searches as a whole. SQL twins are written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions import understanding as ask
from lectern.operators import graph, hits, indexing, library, summary
from lectern.plans.explore import explored
from lectern.plans.search import Search
from lectern.registry import CHUNKS, CITES, CONCEPT, CONCEPTS, ITEMS, LIST, MENTIONS, PAPER, PEOPLE, POSTINGS, STOP, TAGS, TOP, VECTORS, _knn, _mentions, _nearest, _ranked, query
from lectern.sources.catalog import Catalog

# Text

STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


@query("document_texts", f"""WITH {ITEMS}, n AS (SELECT conv_id AS item_key, string_agg(text, ' ' ORDER BY turn) AS note FROM conversations GROUP BY conv_id)
SELECT item_key, concat_ws(' ', nullif(trim(title), ''), nullif(trim(author), ''), nullif(trim(substring(body, 1, 200)), ''), nullif(trim(publication), ''), nullif(trim(concat_ws(' ', item_type, publication)), ''), nullif({STRIPPED.format('note')}, ''), nullif(trim(body), '')) AS text FROM it LEFT JOIN n USING (item_key)""")
def document_texts(c: Catalog) -> DataFrame:
    """Items with all their notes, in order."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    notes = c.table("conversations").groupBy(F.col("conv_id").alias("item_key")).agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("note"))
    rows, col = c.items().join(notes, "item_key", "left"), F.col
    made = t.document_text(col("title"), col("author"), F.substring("body", 1, 200), col("publication"), F.array_compact(F.array("item_type", "publication")), col("note"), col("body"))
    return rows.select("item_key", made.alias("text"))


@query("searchable_texts", f"WITH {ITEMS} SELECT item_key, concat_ws(chr(10) || chr(10), 'Title: ' || nullif(trim(title), ''), 'Authors: ' || nullif(trim(author), ''), 'Publication: ' || nullif(trim(publication), ''), 'Year: ' || nullif(substring(date, 1, 4), '')) AS text FROM it")
def searchable_texts(c: Catalog) -> DataFrame:
    col = F.col
    made = t.searchable_text({"Title": col("title"), "Authors": col("author"), "Publication": col("publication"), "Year": F.substring("date", 1, 4)})
    return c.items().select("item_key", made.alias("text"))


@query("truncated_texts", "SELECT doc_id AS item_key, substring(text, 1, 15000) AS text FROM documents")
def truncated_texts(c: Catalog) -> DataFrame:
    return c.items().select("item_key", t.truncated(F.col("body")).alias("text"))


@query("note_snippets", r"WITH n AS (SELECT conv_id || '-' || turn AS key, trim(regexp_replace(regexp_replace(text, '(?i)</p>|<br ?/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')) AS b FROM conversations) SELECT key, CASE WHEN length(b) > 200 THEN substring(b, 1, 200) || '...' ELSE b END AS snippet FROM n")
def note_snippets(c: Catalog) -> DataFrame:
    return c.children().select("key", t.snippet(F.col("body")).alias("snippet"))


@query("creator_round_trip", "SELECT c_custkey AS item_key, split_part(c_name, '#', 2) || ', ' || split_part(c_name, '#', 1) || '; ' || c_mktsegment AS creators, 2::BIGINT AS n, split_part(c_name, '#', 2) AS last FROM customer")
def creator_round_trip(c: Catalog) -> DataFrame:
    """Creators as text, and read back from it."""
    none = F.lit(None).cast("string")
    person = F.struct(F.split("c_name", "#")[0].alias("firstName"), F.split("c_name", "#")[1].alias("lastName"), none.alias("name"))
    group = F.struct(none.alias("firstName"), none.alias("lastName"), F.col("c_mktsegment").alias("name"))
    rows = c.table("customer").select(F.col("c_custkey").alias("item_key"), t.creators_text(F.array(person, group)).alias("creators"))
    parsed = t.creators_array(F.col("creators"))
    return rows.select("item_key", "creators", F.size(parsed).cast("long").alias("n"), parsed[0]["lastName"].alias("last"))


# Requests

def _intents(kind: str) -> str:
    tests = [(name, sure, " OR ".join("regexp_matches(q, '" + p.replace("'", "''") + "')" for p in patterns)) for name, sure, patterns in ask.GROUPS[kind]]
    case = lambda at, default: "CASE " + " ".join(f"WHEN {r[2]} THEN {at(r)}" for r in tests) + f" ELSE {default} END"
    name, low = ask.DEFAULTS[kind]
    return f"""SELECT key, {case(lambda r: f"'{r[0]}'", f"'{name}'")} AS intent, {case(lambda r: f"{r[1]}::DOUBLE", f"{low}::DOUBLE")} AS confidence FROM (SELECT conv_id || '-' || turn AS key, lower(trim(text)) AS q FROM conversations)"""


for _kind in ("graph", "collection", "tag", "note", "export"):

    def _asked_for(c: Catalog, kind: str = _kind) -> DataFrame:
        return c.children().select("key", ask.intent_column(F.col("body"), kind).alias("i")).select("key", "i.intent", "i.confidence")

    query(f"{_kind}_intents", _intents(_kind))(_asked_for)


@query("summary_intents", r"""SELECT key, CASE WHEN regexp_matches(q, '\b(full|entire|whole|complete) (text|paper|document)\b') OR regexp_matches(q, '\beverything\b') THEN 'full'
WHEN regexp_matches(q, '\b(comprehensive|detailed|in.depth|thorough)\b') OR regexp_matches(q, '\bsummar(y|i[sz]e)\b') THEN 'comprehensive' WHEN regexp_matches(q, '\b(abstract|overview|metadata|quick|brief(ly)?)\b') OR regexp_matches(q, '\bwhat is this\b') THEN 'quick'
WHEN regexp_matches(q, '\b(methods?|results?|findings?|conclusions?|limitations?|sample)\b') OR regexp_matches(q, '\?$') THEN 'targeted' WHEN regexp_matches(q, '^(what|how|why|who|when|where|which)\b') THEN 'targeted'
WHEN len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) <= 5 THEN 'quick' ELSE 'comprehensive' END AS intent FROM (SELECT conv_id || '-' || turn AS key, lower(trim(text)) AS q FROM conversations)""")
def summary_intents(c: Catalog) -> DataFrame:
    return c.children().select("key", ask.intent_column(F.col("body"), "summary")["intent"].alias("intent"))


@query("request_conjunctions", r"SELECT conv_id || '-' || turn AS key, regexp_matches(lower(text), '\sand\s') AS has_and, regexp_matches(lower(text), '\sor\s') AS has_or, regexp_matches(lower(text), '\sabout\s') AS has_about FROM conversations")
def request_conjunctions(c: Catalog) -> DataFrame:
    return c.children().select("key", ask.conjunctions(F.col("body")).alias("f")).select("key", "f.*")


@query("request_parameters", r"""WITH r AS (SELECT o_orderkey AS key, 'top ' || (o_orderkey % 50) || ' papers by ' || split_part(c_name, '#', 1) || ' from ' || year(o_orderdate) || ' to 2003 in "' || o_orderpriority || '" near KEY' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS q FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT key, nullif(regexp_extract(q, '"([^"]+)"', 1), '') AS quoted, nullif(regexp_extract(q, '\b([A-Z0-9]{8})\b', 1), '') AS key8, (key % 50)::INT AS "limit", regexp_extract(q, 'from (\d{4}) to', 1)::INT AS year_from, 2003 AS year_to, nullif(regexp_extract(q, 'by (\w+)', 1), '') AS author FROM r""")
def request_parameters(c: Catalog) -> DataFrame:
    orders = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = F.concat(
        F.lit("top "), F.col("o_orderkey") % 50, F.lit(" papers by "), F.split("c_name", "#")[0], F.lit(" from "), F.year("o_orderdate"), F.lit(' to 2003 in "'), "o_orderpriority",
        F.lit('" near KEY'), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"),
    )
    rows = orders.select(F.col("o_orderkey").alias("key"), ask.parameters(asked).alias("p"))
    return rows.select("key", "p.quoted", F.col("p.key").alias("key8"), "p.limit", "p.year_from", "p.year_to", "p.author")


# Library

@query("filtered_items", f"WITH {ITEMS} SELECT item_key, title FROM it WHERE item_type = 'en' AND publication = 'src1'")
def filtered_items(c: Catalog) -> DataFrame:
    return c.items().where(summary.parsed_filter('{"itemType": "en", "publication": "src1"}')).select("item_key", "title")


@query("item_by_key", f"WITH {ITEMS} SELECT item_key, title, publication, date FROM it WHERE item_key = 7")
def item_by_key(c: Catalog) -> DataFrame:
    return c.items().where(library.equals({"item_key": 7})).select("item_key", "title", "publication", "date")


@query("recent_papers", "SELECT o_orderkey AS paper, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) >= 2001 - 3")
def recent_papers(c: Catalog) -> DataFrame:
    return c.papers().where(library.since(3, 2001)).select("paper", "year")


@query("items_with_fallback", "SELECT doc_id AS item_key, 'labelled' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def items_with_fallback(c: Catalog) -> DataFrame:
    of = lambda table, origin: c.table(table).select(F.col("doc_id").alias("item_key"), F.lit(origin).alias("origin"))
    return library.with_fallback(of("labels", "labelled"), of("documents", "document"), "item_key")


@query("collection_named", "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE contains(lower(n_name), lower('nation_1')) ORDER BY lower(n_name) = lower('nation_1') DESC, n_nationkey LIMIT 1")
def collection_named(c: Catalog) -> DataFrame:
    return library.collection_match(c.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "nation_1").select("key", "name")


@query("collection_contents", f"""WITH {ITEMS}, {PEOPLE}, au AS (SELECT DISTINCT src AS item_key, s_name AS author FROM e JOIN supplier ON dst = s_suppkey), n AS (SELECT item_key, list_sort(list(DISTINCT author)) AS names FROM au GROUP BY item_key)
SELECT item_key, title, coalesce(array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END, '') AS authors, substring(date, 1, 4) AS year FROM it LEFT JOIN n USING (item_key) WHERE publication = 'src1'""")
def collection_contents(c: Catalog) -> DataFrame:
    links = c.table("documents").select(F.col("source").alias("collection_key"), F.col("doc_id").alias("item_key"))
    people = c.table("supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("author"))
    authors = c.edges("AUTHORED_BY").join(people, "dst").select(F.col("src").alias("item_key"), "author")
    return library.collection_items(links, c.items(), authors, "src1")


@query("batch_retag", f"WITH {TAGS}, ch AS (SELECT DISTINCT item_key FROM tg WHERE tag = 'Good') SELECT 'added' AS action, x AS tag, (SELECT count(*) FROM ch WHERE item_key NOT IN (SELECT item_key FROM tg WHERE lower(tag) = lower(x) AND NOT (lower(x) IN ('en', 'src1')))) AS n FROM (VALUES ('Reviewed'), ('EN')) v(x) WHERE x <> 'EN' UNION ALL SELECT 'added', 'EN', count(*) FROM ch UNION ALL SELECT 'removed', tag, count(DISTINCT item_key) FROM tg WHERE lower(tag) IN ('en', 'src1') AND item_key IN (SELECT item_key FROM ch) GROUP BY tag")
def batch_retag(c: Catalog) -> DataFrame:
    """Good items lose the tags en and src1 and gain Reviewed and EN."""
    tags = c.item_tags()
    return library.retag_counts(tags, library.retagged(tags, library.tagged(tags, ["Good"]), ["Reviewed", "EN"], ["en", "src1"]))


@query("index_status", "SELECT count(*) AS n, min(len(embedding))::INT AS least_dims, max(len(embedding))::INT AS most_dims FROM embeddings")
def index_status(c: Catalog) -> DataFrame:
    return library.index_status(c.vectors())


def _indexed(c: Catalog) -> DataFrame:
    """item_key, parent_item_key, has_fulltext: turns as chunks of their conversation."""
    return c.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_key"), F.when(F.col("role") != "system", F.col("conv_id")).alias("parent_item_key"), (F.length("text") >= 100).alias("has_fulltext"))


INDEXED = "x AS (SELECT conv_id * 1000 + turn AS item_key, CASE WHEN role <> 'system' THEN conv_id END AS parent_item_key, length(text) >= 100 AS has_fulltext FROM conversations)"


@query("paper_chunks", f"WITH {INDEXED} SELECT item_key, parent_item_key FROM x WHERE item_key = 3 OR parent_item_key = 3")
def paper_chunks(c: Catalog) -> DataFrame:
    return library.chunks_of(_indexed(c), 3).select("item_key", "parent_item_key")


@query("fulltext_keys", f"WITH {INDEXED} SELECT DISTINCT coalesce(parent_item_key, item_key) AS item_key FROM x WHERE has_fulltext")
def fulltext_keys(c: Catalog) -> DataFrame:
    return library.text_keys(_indexed(c))


@query("label_counts", f"WITH {MENTIONS} SELECT label, count(*) AS n FROM me GROUP BY label ORDER BY n DESC, label LIMIT 5")
def label_counts(c: Catalog) -> DataFrame:
    return summary.top_counts(_mentions(c).distinct(), "label", 5)


@query("members_changed", "SELECT source AS collection_key, doc_id AS item_key FROM documents WHERE NOT (source = 'src1' AND doc_id % 2 = 0) UNION SELECT 'new', doc_id FROM documents WHERE doc_id % 10 = 0")
def members_changed(c: Catalog) -> DataFrame:
    links = c.table("documents").select(F.col("source").alias("collection_key"), F.col("doc_id").alias("item_key"))
    new = c.table("documents").where("doc_id % 10 = 0").select(F.lit("new").alias("collection_key"), F.col("doc_id").alias("item_key"))
    return library.members_added(library.members_removed(links, links.where("collection_key = 'src1' AND item_key % 2 = 0")), new)


# Indexing

@query("rows_to_index", f"WITH {CHUNKS}, k AS (SELECT * FROM ch WHERE item_key % 5 <> 0) SELECT item_key, chunk_id::INT AS chunk_id, length(chunk)::INT AS chars FROM k WHERE length(trim(chunk)) > 0 UNION ALL SELECT doc_id, 0, length(text)::INT FROM documents WHERE doc_id NOT IN (SELECT item_key FROM k) AND length(trim(text)) > 0")
def rows_to_index(c: Catalog) -> DataFrame:
    return indexing.chunks_or_text(c.items(), c.chunks().where("item_key % 5 <> 0")).select("item_key", "chunk_id", F.length("chunk").alias("chars"))


@query("payload_repairs", "SELECT conv_id || '-' || turn AS key, conv_id::VARCHAR AS parent FROM conversations WHERE role = 'system' OR turn % 2 = 1")
def payload_repairs(c: Catalog) -> DataFrame:
    turns = c.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").cast("string").alias("right"), "role", "turn")
    was = F.when(F.col("role") == "system", F.lit(None).cast("string")).when(F.col("turn") % 2 == 1, F.concat("right", F.lit("x"))).otherwise(F.col("right"))
    return indexing.changed_parents(turns.select("key", was.alias("parent")), turns.select("key", F.col("right").alias("parent")))


@query("points_deleted", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def points_deleted(c: Catalog) -> DataFrame:
    return indexing.without_keys(c.vectors(), c.table("labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id").select("id")


@query("cache_maintained", """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'error' AND event_id % 7 <> 0),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_id % 3 = 0) WHERE r = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_id % 5 = 0) WHERE r = 1),
p AS (SELECT user_id, event_id, ts FROM n UNION ALL SELECT user_id, event_id, ts FROM o WHERE user_id NOT IN (SELECT user_id FROM n))
SELECT user_id, event_id FROM p WHERE ts >= TIMESTAMP '2024-01-10' AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 49 = 0 AND event_type = 'error')""")
def cache_maintained(c: Catalog) -> DataFrame:
    """Parsed rows are put by key onto those that are there, those of failed events invalidated, those before a date cleared."""
    rows = c.table("events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("made"))
    good = rows.where("event_type <> 'error' AND event_id % 7 <> 0")
    cache = indexing.last_rows(good.where("event_id % 3 = 0"), "user_id", ["made", "event_id"])
    put = indexing.cache_put(cache, indexing.last_rows(good.where("event_id % 5 = 0"), "user_id", ["made", "event_id"]), "user_id")
    valid = indexing.without_keys(put, rows.where("event_id % 49 = 0 AND event_type = 'error'"), "user_id")
    return indexing.cache_cleared(valid, F.to_timestamp(F.lit("2024-01-10"))).select("user_id", "event_id")


# Graph

@query("linked_chunks", "SELECT DISTINCT o_orderkey AS paper, o_orderkey * 10 + x AS chunk FROM orders, (VALUES (1), (2), (3)) v(x)")
def linked_chunks(c: Catalog) -> DataFrame:
    key = F.col("o_orderkey")
    return graph.linked(c.papers(), c.table("orders").select(key.alias("paper"), F.array(key * 10 + 1, key * 10 + 2, key * 10 + 3, key * 10 + 2).alias("chunks")))


#: Steps of a shortest path: the least neighbour one level nearer, from the far end back to the start.
STEPS = f"h AS (SELECT id, min(hops) AS hops FROM w GROUP BY id), v AS (SELECT b.id, b.hops, min(a.id) AS via FROM h b JOIN u ON u.dst = b.id JOIN h a ON a.id = u.src AND a.hops = b.hops - 1 GROUP BY b.id, b.hops), t AS (SELECT id, hops, [id] AS path, via FROM v UNION ALL SELECT t.id, t.hops, list_prepend(t.via, path), v.via FROM t LEFT JOIN v ON v.id = t.via WHERE t.via IS NOT NULL)"


@query("citation_paths", f"""WITH RECURSIVE {CITES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT {PAPER}::BIGINT AS id, 0 AS hops UNION SELECT u.dst, hops + 1 FROM w JOIN u ON u.src = w.id WHERE hops < 3), {STEPS},
n AS (SELECT o_orderkey AS id, year(o_orderdate)::INT AS year, coalesce(substring(split_part(text, chr(10), 1), 1, 60), 'paper ' || o_orderkey) AS title FROM orders LEFT JOIN documents ON doc_id = o_orderkey)
SELECT t.id, t.hops::INT AS hops, n.year, array_to_string(path, '>') AS path, (SELECT string_agg(m.title, ' > ' ORDER BY list_position(path, m.id)) FROM n m WHERE list_contains(path, m.id)) AS titles, row_number() OVER (ORDER BY t.hops, n.year, t.id) AS place FROM t JOIN n ON n.id = t.id WHERE via IS NULL""")
def citation_paths(c: Catalog) -> DataFrame:
    """Papers of a citation chain with the titles on their way, nearest first, then by year."""
    titles = c.table("documents").select(F.col("doc_id").alias("paper"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"))
    nodes = c.papers().join(titles, "paper", "left").select(F.col("paper").alias("id"), "title", "year")
    found = graph.titled(graph.paths(c.edges("CITES"), PAPER, 3), nodes)
    return graph.placed(found.select("id", "hops", "year", F.array_join("path", ">").alias("path"), F.array_join("titles", " > ").alias("titles")), ["hops", "year", "id"])


@query("graph_available", "SELECT count(*) > 0 AS available FROM orders")
def graph_available(c: Catalog) -> DataFrame:
    return graph.available(c.papers())


@query(
    "matched_chunks",
    rf"""WITH {CHUNKS}, s AS (SELECT item_key AS paper, chunk_id AS position, item_key || '-' || chunk_id AS chunk, chunk AS body FROM ch),
t AS (SELECT paper, CASE WHEN k = 2 THEN position + 1000 ELSE position END AS position, chunk AS text_id, CASE k WHEN 0 THEN body WHEN 1 THEN substring(body, 1, 150) || ' cut' ELSE substring(body, 1, 300) || ' and more' END AS text FROM (SELECT *, (paper + position) % 3 AS k FROM s)),
a AS (SELECT text_id, min(chunk) AS chunk, 1 AS tier FROM t JOIN s USING (paper) WHERE text = body GROUP BY text_id), l AS (SELECT * FROM t WHERE text_id NOT IN (SELECT text_id FROM a)),
b AS (SELECT text_id, min(chunk) AS chunk, 2 AS tier FROM l JOIN s USING (paper, position) WHERE contains(body, substring(text, 1, 100)) GROUP BY text_id),
w AS (SELECT text_id, chunk, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\s+')), list_distinct(regexp_split_to_array(lower(body), '\s+')))) / len(list_distinct(regexp_split_to_array(lower(text), '\s+'))) AS share FROM l JOIN s USING (paper) WHERE text_id NOT IN (SELECT text_id FROM b) AND contains(body, substring(text, 1, 200)))
FROM a UNION ALL FROM b UNION ALL SELECT text_id, arg_min(chunk, struct_pack(s := -share, c := chunk)), 3 FROM w WHERE share > 0.5 GROUP BY text_id""",
)
def matched_chunks(c: Catalog) -> DataFrame:
    """Texts that are chunks, that begin like the chunk of their place, or like another one."""
    rows = c.chunks().select(F.concat_ws("-", "item_key", "chunk_id").alias("chunk"), F.col("item_key").alias("paper"), F.col("chunk_id").alias("position"), F.col("chunk").alias("body"))
    kind = (F.col("paper") + F.col("position")) % 3
    text = F.when(kind == 0, F.col("body")).when(kind == 1, F.concat(F.substring("body", 1, 150), F.lit(" cut"))).otherwise(F.concat(F.substring("body", 1, 300), F.lit(" and more")))
    texts = rows.select(F.col("chunk").alias("text_id"), "paper", F.when(kind == 2, F.col("position") + 1000).otherwise(F.col("position")).alias("position"), text.alias("text"))
    return graph.matched_chunks(rows, texts)


@query("explored_paper", f"""WITH RECURSIVE {CONCEPTS}, {CITES.replace('e AS', 'ci AS', 1)}, u AS (SELECT src, dst FROM ci UNION SELECT dst, src FROM ci), w AS (SELECT {PAPER}::BIGINT AS id, 0 AS hops UNION SELECT u.dst, hops + 1 FROM w JOIN u ON u.src = w.id WHERE hops < 2)
SELECT * FROM (SELECT 'related' AS strategy, a.src AS id, count(DISTINCT a.dst)::DOUBLE AS score FROM e a JOIN e b USING (dst) WHERE b.src = {PAPER} AND a.src <> {PAPER} GROUP BY a.src ORDER BY score DESC, id LIMIT {TOP})
UNION ALL SELECT 'citation', id, min(hops)::DOUBLE FROM w GROUP BY id HAVING min(hops) > 0
UNION ALL SELECT * FROM (SELECT 'influence', o_orderkey AS id, count(src)::DOUBLE AS score FROM orders LEFT JOIN ci ON dst = o_orderkey GROUP BY 2 ORDER BY score DESC, id LIMIT {TOP})""")
def explored_paper(c: Catalog) -> DataFrame:
    return explored(c, "comprehensive", PAPER, n=TOP)


@query("explored_modes", f"""WITH {CONCEPTS}, {PEOPLE.replace('e AS', 'p AS', 1)}
SELECT * FROM (SELECT 'collaboration' AS strategy, a.dst AS id, count(DISTINCT a.src)::DOUBLE AS score FROM p a JOIN p b USING (src) WHERE b.dst = 1 AND a.dst <> 1 GROUP BY a.dst ORDER BY score DESC, id LIMIT {TOP})
UNION ALL SELECT * FROM (SELECT 'concept', a.dst AS id, count(DISTINCT a.src)::DOUBLE AS score FROM e a JOIN e b USING (src) WHERE b.dst = {CONCEPT} AND a.dst <> {CONCEPT} GROUP BY a.dst ORDER BY score DESC, id LIMIT {TOP})""")
def explored_modes(c: Catalog) -> DataFrame:
    return explored(c, "collaboration", 1, n=TOP).unionByName(explored(c, "concept", CONCEPT, n=TOP))


# Searches

@query("enriched_hits", f"WITH {VECTORS}, {ITEMS}, h AS ({_knn(0)}) SELECT id AS item_key, similarity, rank, coalesce(title, '') AS title, publication FROM h LEFT JOIN it ON id = item_key")
def enriched_hits(c: Catalog) -> DataFrame:
    found = hits.enriched(_nearest(c, 0).withColumnRenamed("id", "item_key"), c.items())
    return found.select("item_key", "similarity", "rank", F.coalesce("title", F.lit("")).alias("title"), "publication")


@query("compact_hits", f"""WITH {VECTORS}, h AS ({_knn(0)}) SELECT '{{"id":' || id || ',"rank":' || rank || '}}' AS value FROM h""")
def compact_hits(c: Catalog) -> DataFrame:
    return summary.compact(_nearest(c, 0), ["id", "rank"])


#: A request whose parts are searched apart.
REQUEST = "thor and ther ing"


@query("decomposed_search", f"""WITH {POSTINGS}, parts AS (SELECT * FROM (VALUES ('0', 'thor', 1.0::DOUBLE), ('1', 'ther ing', 1.0::DOUBLE)) v(list, q, importance)),
asked AS (SELECT list, importance, term, count(*) AS qtf FROM (SELECT list, importance, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM parts) WHERE term NOT IN ({STOP}) GROUP BY ALL),
s AS (SELECT list, importance, id, round(sum(tf * idf * qtf * idf), 4) AS score FROM p JOIN voc USING (term) JOIN asked USING (term) GROUP BY ALL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {2 * TOP}),
f AS (SELECT id, round(sum(score * importance / rank), 4) AS score FROM r GROUP BY id) {_ranked('f', TOP)}""")
def decomposed_search(c: Catalog) -> DataFrame:
    return Search(c).decomposed(REQUEST, TOP).select("id", "score", "rank")


@query("targeted_summary", f"WITH {CHUNKS}, " + r"""w AS (SELECT DISTINCT chunk_id, unnest(regexp_split_to_array(lower(chunk), '[^\p{L}\p{N}]+')) AS word FROM ch WHERE item_key = 7), s AS (SELECT chunk_id::INT AS chunk_id, count(*) AS score FROM w WHERE word IN ('the', 'thing', 'and', 'with') GROUP BY chunk_id)
SELECT 7::BIGINT AS item_key, chunk_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def targeted_summary(c: Catalog) -> DataFrame:
    return summary.targeted(c.chunks(), 7, "the thing and with of").select("item_key", "chunk_id", "score", "rank")


@query("quick_summary", f"WITH {ITEMS} SELECT item_key, title, substring(body, 1, 1000) AS abstract FROM it WHERE item_key = 7")
def quick_summary(c: Catalog) -> DataFrame:
    return summary.quick(c.items(), 7).select("item_key", "title", "abstract")


@query("iterative_search")
def iterative_search(c: Catalog) -> DataFrame:
    """A request with few hits, reformulated until it has enough."""
    return Search(c).iterative("memory thor", TOP)
