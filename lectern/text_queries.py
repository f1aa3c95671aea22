"""Registered queries of text structure: sections, sentence ends, paragraphs, references, TEI, parser chains, exports. Inputs are derived from the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import chunking
from lectern.functions import items as entries
from lectern.registry import CHUNKS, ITEMS, query
from lectern.session import ship
from lectern.sources import files
from lectern.sources.catalog import Catalog


@query(
    "sentence_repair",
    rf"""WITH {CHUNKS}, t AS (SELECT *, regexp_matches(chunk, '[.!?]["'')\]]*\s*\z') AS ended, lead(1) OVER o IS NULL AS last FROM ch WINDOW o AS (PARTITION BY item_key ORDER BY chunk_id)),
r AS (SELECT *, CASE WHEN ended OR last THEN '' ELSE regexp_extract(chunk, '(?s)\A.*[.!?]["'')\]]*\s+(.*)\z', 1) END AS rest FROM t),
b AS (SELECT *, coalesce(lag(rest) OVER (PARTITION BY item_key ORDER BY chunk_id), '') AS before, CASE WHEN rest = '' THEN chunk ELSE regexp_replace(substring(chunk, 1, length(chunk) - length(rest)), '\s+\z', '') END AS own FROM r)
SELECT item_key, chunk_id::INT AS chunk_id, CASE WHEN before = '' THEN own ELSE before || ' ' || own END AS chunk FROM b""",
)
def sentence_repair(c: Catalog) -> DataFrame:
    return chunking.repaired(c.chunks())


HEADED = "d AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 2 THEN '## ' || x WHEN i % 7 = 0 THEN '**PART ' || i || '**' ELSE x END), chr(10)) AS text FROM documents)"


@query(
    "section_split",
    rf"""WITH {HEADED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d),
h AS (SELECT *, regexp_matches(line, '^#{{1,4}}\s+\S|^\*\*[\p{{Lu}}\p{{N}} .:-]+\*\*\s*$') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN trim(replace(regexp_replace(line, '^#{{1,4}}\s+', ''), '**', '')) END) AS heading, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT head), '') AS body FROM s GROUP BY doc_id, section HAVING length(trim(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT head), ''))) > 0""",
)
def section_split(c: Catalog) -> DataFrame:
    line = lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x)).when(i % 7 == 6, F.concat(F.lit("**PART "), i + 1, F.lit("**"))).otherwise(x)
    docs = c.table("documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return chunking.sections(docs, "doc_id", "text").select("doc_id", "section", "heading", "body")


CITED = "d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '## References' || chr(10) || '[1] A' WHEN 1 THEN text || chr(10) || '[1] Aa' || chr(10) || chr(10) || 'x' || chr(10) || '2. Bb' || chr(10) || '[3] Cc' || chr(10) || 'rest' WHEN 2 THEN '1. One' || chr(10) || text || chr(10) || '[2] Two' ELSE text END AS text FROM documents)"


@query(
    "reference_filter",
    rf"""WITH {CITED}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d),
n AS (SELECT *, (no - lag(no) OVER (PARTITION BY doc_id ORDER BY no) > {chunking.GAP})::INT AS apart FROM l WHERE regexp_matches(line, '^\s*(\[\d+\]|\d+\.)\s+\S')), g AS (SELECT *, sum(coalesce(apart, 0)) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM n),
r AS (SELECT doc_id, no AS spot, first_value(no) OVER i AS cut, row_number() OVER i AS k FROM g WINDOW i AS (PARTITION BY doc_id, island ORDER BY no)),
e AS (SELECT doc_id, spot, cut FROM r WHERE k = {chunking.RUN} UNION ALL SELECT doc_id, no, no FROM l WHERE regexp_matches(line, '(?i)^\s*(#{{1,4}}\s*)?(\d+\.?\s*)?(references|bibliography|works cited|literature cited)\s*:?\s*$')), c AS (SELECT doc_id, arg_min(cut, spot) AS cut FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE array_to_string(string_split(text, chr(10))[1:cut], chr(10)) END AS text FROM d LEFT JOIN c USING (doc_id)""",
)
def reference_filter(c: Catalog) -> DataFrame:
    text, kind = F.col("text"), F.col("doc_id") % 4
    cited = F.when(kind == 0, F.concat(text, F.lit("\n## References\n[1] A"))).when(kind == 1, F.concat(text, F.lit("\n[1] Aa\n\nx\n2. Bb\n[3] Cc\nrest"))).when(kind == 2, F.concat(F.lit("1. One\n"), text, F.lit("\n[2] Two"))).otherwise(text)
    return chunking.without_references(c.table("documents").select("doc_id", cited.alias("text")), "doc_id", "text")


@query(
    "paragraph_chunks",
    r"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) ELSE text END AS text FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM d),
q AS (SELECT doc_id, flatten(list_transform(l, lambda x: CASE WHEN length(x) > 1000 THEN list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') ELSE [x] END)) AS l FROM p),
w AS (SELECT doc_id, 1 AS i, l, l[1] AS now, NULL::VARCHAR AS out FROM q WHERE len(l) > 0
  UNION ALL SELECT doc_id, i + 1, l, CASE WHEN length(now) + length(l[i + 1]) + 2 > 1000 THEN right(now, 100) ELSE now END || chr(10) || chr(10) || l[i + 1], CASE WHEN length(now) + length(l[i + 1]) + 2 > 1000 THEN now END FROM w WHERE i < len(l)),
o AS (SELECT doc_id, i, out AS chunk FROM w WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, now FROM w WHERE i = len(l))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_id, chunk FROM o""",
)
def paragraph_chunks(c: Catalog) -> DataFrame:
    spread = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n \n"))).otherwise(F.col("text"))
    return chunking.paragraph_chunks(c.table("documents").select("doc_id", spread.alias("text")), "doc_id", "text")


@query("heading_tracking", "SELECT conv_id AS item_key, turn AS chunk_id, last_value(CASE WHEN turn % 3 = 0 THEN substring(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations")
def heading_tracking(c: Catalog) -> DataFrame:
    turns = c.table("conversations").select(F.col("conv_id").alias("item_key"), F.col("turn").alias("chunk_id"), F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 20)).alias("heading"))
    return chunking.headings(turns)


@query(
    "tei_sections",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(substring(text, 1, 40), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS head, source, lang, doc_id % 2 = 0 AS refs FROM documents),
s AS (SELECT doc_id, 0 AS section, 'body' AS part, 'introduction' AS type, head AS heading, source || ' [1] & end' AS paragraphs, false AS is_reference FROM d UNION ALL SELECT doc_id, 1, 'body', 'unknown', '', lang || '|' || doc_id, false FROM d
  UNION ALL SELECT doc_id, 2, 'body', 'references', 'References', '', true FROM d WHERE refs UNION ALL SELECT doc_id, CASE WHEN refs THEN 3 ELSE 2 END, 'back', 'unknown', '', 'More', true FROM d)
SELECT doc_id, section::INT AS section, part, type, heading, paragraphs, is_reference FROM s""",
)
def tei_sections(c: Catalog) -> DataFrame:
    head = F.trim(F.regexp_replace(F.regexp_replace(F.substring("text", 1, 40), r"[^\p{L}\p{N} ]", " "), " +", " "))
    refs = F.when(F.col("doc_id") % 2 == 0, '<div type="references"><head>References</head></div>').otherwise("")
    body = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="introduction" coords="1,2"><head>'), head, F.lit("</head><p>"), "source", F.lit(' <ref target="#b0">[1]</ref> &amp; end</p><div><p>'), "lang",
        F.lit("</p><p>"), F.col("doc_id").cast("string"), F.lit("</p></div></div>"), refs, F.lit("</body><back><div><p>More</p></div></back></text></TEI>"),
    )
    found = files.tei_sections(c.table("documents").select("doc_id", body.alias("xml")), "doc_id", "xml")
    return found.select("doc_id", "section", "part", "type", "heading", F.array_join("paragraphs", "|").alias("paragraphs"), "is_reference")


def _stripped(html: str) -> str:
    return re.sub("[ \t\n\r\f]+", " ", re.sub(r"(?s)<[^>]*>", " ", html)).strip(" ")


def _lead(content: bytes) -> str:
    """The first paragraph; pages with a form, or without a paragraph, are refused."""
    html = content.decode()
    if "<form" in html:
        raise ValueError("form")
    found = re.search(r"(?s)<p[^>]*>(.*?)</p>", html)
    if found is None:
        raise ValueError("no paragraph")
    return _stripped(found[1])


def _article(content: bytes) -> str:
    return _stripped(re.search(r"(?s)<article[^>]*>(.*?)</article>", content.decode())[1])


CHAIN = [("lead", _lead, 250), ("article", _article, 900), ("page", lambda content: _stripped(content.decode()), 0)]
PLAIN = "trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(
    "parser_chain",
    f"""WITH p AS (SELECT page_id, contains(html, '<form') AS form, regexp_matches(html, '(?s)<p[^>]*>(.*?)</p>') AS has_lead, {PLAIN.format("regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1)")} AS lead, {PLAIN.format("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS article, {PLAIN.format("html")} AS page FROM pages)
SELECT page_id, parser, CASE parser WHEN 'lead' THEN lead WHEN 'article' THEN article ELSE page END AS text, CASE parser WHEN 'lead' THEN 1 WHEN 'article' THEN 2 ELSE 3 END::BIGINT AS links, CASE WHEN form THEN 'ValueError: form' WHEN NOT has_lead THEN 'ValueError: no paragraph' END AS error FROM (SELECT *, CASE WHEN NOT form AND length(lead) >= 250 THEN 'lead' WHEN length(article) >= 900 THEN 'article' ELSE 'page' END AS parser FROM p)""",
)
def parser_chain(c: Catalog) -> DataFrame:
    """Pages by their first paragraph, else their article, else all of the page."""
    ship(c.spark)
    pages = c.table("pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    found = files.chained(pages, CHAIN)
    return found.select(F.col("path").cast("long").alias("page_id"), "parser", "text", F.size("tried").cast("long").alias("links"), F.get("tried", 0)["error"].alias("error"))


KINDS = ("journalArticle", "book", "preprint", "conferencePaper")
FULL = f"""{ITEMS}, f AS (SELECT item_key, [{', '.join(f"'{entries.ENTRY_TYPES[k]}'" for k in KINDS)}][item_key % 4 + 1] AS kind, date, split_part(author, '#', 2) AS last, split_part(author, '#', 1) AS first, author, publication,
[title, publication, (item_key % 30)::VARCHAR, CASE WHEN item_key % 2 = 0 THEN 'n' || item_key END, '1--' || length(body), CASE WHEN item_key % 3 = 0 THEN 'House {{x}}' END, '10.1/' || item_key, '', substring(body, 1, 200)] AS v, ['title', 'journal', 'volume', 'number', 'pages', 'publisher', 'doi', 'url', 'abstract'] AS k FROM it)"""


@query(
    "bibtex_full",
    rf"""WITH {FULL} SELECT item_key, array_to_string(list_concat(['@' || kind || '{{' || coalesce(last, list_last(string_split(publication, ' ')), '') || coalesce(substring(date, 1, 4), 'nodate') || '_' || item_key],
list_transform(list_filter(list_zip(k, v), lambda z: z[2] IS NOT NULL AND z[2] <> ''), lambda z: '  ' || z[1] || ' = {{' || regexp_replace(z[2], '([{{}}])', '\\\1', 'g') || '}}'),
['  author = {{' || CASE WHEN author IS NOT NULL THEN last || ', ' || first || ' and ' ELSE '' END || publication || '}}'], CASE WHEN date IS NOT NULL THEN ['  year = {{' || substring(date, 1, 4) || '}}'] ELSE [] END), ',' || chr(10)) || chr(10) || '}}' AS entry FROM f""",
)
def bibtex_full(c: Catalog) -> DataFrame:
    col, none = F.col, F.lit(None).cast("string")
    person = F.struct(F.lit("author").alias("creatorType"), F.split("author", "#")[0].alias("firstName"), F.split("author", "#")[1].alias("lastName"), none.alias("name"))
    editor = F.struct(F.lit("editor").alias("creatorType"), F.lit("E").alias("firstName"), F.lit("Ed").alias("lastName"), none.alias("name"))
    group = F.struct(F.lit("author").alias("creatorType"), none.alias("firstName"), none.alias("lastName"), col("publication").alias("name"))
    creators = F.when(col("author").isNull(), F.array(group)).otherwise(F.array(person, editor, group))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (col("item_key") % 4 + 1).cast("int"))
    more = {
        "volume": (col("item_key") % 30).cast("string"), "number": F.when(col("item_key") % 2 == 0, F.concat(F.lit("n"), "item_key")), "pages": F.concat(F.lit("1--"), F.length("body")),
        "publisher": F.when(col("item_key") % 3 == 0, "House {x}"), "doi": F.concat(F.lit("10.1/"), "item_key"), "url": F.lit(""), "abstract": F.substring("body", 1, 200),
    }
    return c.items().select("item_key", entries.bibtex_full(kind, col("item_key"), creators, col("title"), col("date"), col("publication"), **more).alias("entry"))


@query("markdown_published", rf"""WITH {ITEMS} SELECT item_key, array_to_string(list_filter(['---' || chr(10) || 'title: "' || replace(coalesce(title, ''), '"', '\"') || '"' || chr(10) || 'authors: "' || replace(coalesce(author, ''), '"', '\"') || '"' || chr(10) || 'date: "' || coalesce(date, '') || '"' || chr(10) || 'type: "' || coalesce(item_type, '') || '"' || CASE WHEN publication <> '' THEN chr(10) || 'publication: "' || publication || '"' ELSE '' END || chr(10) || 'key: ' || item_key || chr(10) || '---', '# ' || coalesce(title, ''), CASE WHEN publication <> '' THEN '**Publication:** ' || publication END, coalesce(body, '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS document FROM it""")
def markdown_published(c: Catalog) -> DataFrame:
    col = F.col
    return c.items().select("item_key", entries.markdown(col("item_key"), col("title"), col("author"), col("date"), col("item_type"), col("body"), col("publication")).alias("document"))
