"""What a request asks for: intents with confidence, sub-queries, expansion and reformulation.

Pattern tables are data; the same tables give plain Python answers for one request and column expressions for a
table of requests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordered groups of patterns on the lower-cased request: intent, confidence, patterns. The first that matches wins.
SEARCH_INTENTS = (
    ("entity", 0.95, (r"\b(which|what) (methods?|techniques?|theories|concepts?|datasets?|tools?)\b", r"\bentit(y|ies)\b")),
    ("relationship", 0.9, (r"\b(related|connected|linked|similar) to\b", r"\b(cit(es|ed|ing|ation)|collaborat\w*|co-?authors?|influence[ds]?)\b", r"\brelationships?\b")),
    ("metadata", 0.8, (r"\b(by|from) [a-z]+ (in|et al)\b", r"\b(published|journal|author|year|doi|title)\b", r"\b(19|20)\d\d\b")),
)
GRAPH_INTENTS = (
    ("citation", 0.9, (r"\bcit(e[sd]?|ing|ations?)\b", r"\breferences?\b")),
    ("influence", 0.9, (r"\b(seminal|influential|foundational|landmark|important) (papers?|works?)\b", r"\binfluence\b")),
    ("content_similarity", 0.85, (r"\bsimilar (papers?|content|to)\b", r"\bpapers? like\b")),
    ("collaboration", 0.9, (r"\b(collaborat\w*|co-?authors?|worked with)\b",)),
    ("temporal", 0.85, (r"\b(evol\w+|trends?|over time|histor\w+|timeline)\b", r"\b(19|20)\d\d (to|-) (19|20)\d\d\b")),
    ("concept", 0.85, (r"\b(concepts?|topics?|themes?|ideas?)\b",)),
    ("venue", 0.85, (r"\b(venues?|journals?|conferences?|publish(ed|ing)? (in|where))\b",)),
    ("related", 0.8, (r"\brelated\b", r"\bconnect(ed|ions?)\b")),
)
SUMMARY_INTENTS = (
    ("full", 0.9, (r"\b(full|entire|whole|complete) (text|paper|document)\b", r"\beverything\b")),
    ("comprehensive", 0.85, (r"\b(comprehensive|detailed|in.depth|thorough)\b", r"\bsummar(y|i[sz]e)\b")),
    ("quick", 0.85, (r"\b(abstract|overview|metadata|quick|brief(ly)?)\b", r"\bwhat is this\b")),
    ("targeted", 0.8, (r"\b(methods?|results?|findings?|conclusions?|limitations?|sample)\b", r"\?$")),
)
COLLECTION_INTENTS = (
    ("recent", 0.9, (r"\b(recent(ly)?|latest|newest|last added)\b",)), ("list", 0.9, (r"\b(list|show|all)( all| my)? collections\b",)),
    ("create", 0.9, (r"\b(create|make|new)\b.*\bcollection\b",)), ("show", 0.85, (r"\b(show|items|contents|what('s| is)) .*\bcollection\b",)),
    ("add", 0.85, (r"\b(add|put|move)\b",)), ("remove", 0.85, (r"\b(remove|delete|take)\b",)),
)
TAG_INTENTS = (("add", 0.9, (r"\b(add|apply|attach)\b.*\btags?\b", r"\btag\b.*\b(as|with)\b")), ("remove", 0.9, (r"\b(remove|delete|drop)\b.*\btags?\b", r"\buntag\b")), ("search", 0.85, (r"\b(tagged|with( the)? tags?)\b",)), ("list", 0.85, (r"\b(list|show|all)\b.*\btags\b",)))
NOTE_INTENTS = (("create", 0.9, (r"\b(create|write|add|make)\b.*\bnotes?\b",)), ("search", 0.85, (r"\b(search|find)\b.*\bnotes?\b",)), ("annotations", 0.9, (r"\b(annotations?|highlights?)\b",)), ("notes", 0.8, (r"\bnotes?\b",)))
EXPORT_INTENTS = (("bibtex", 0.95, (r"\bbib(tex)?\b", r"\.bib\b")), ("graphml", 0.95, (r"\b(graphml|graph)\b",)), ("markdown", 0.95, (r"\b(markdown|obsidian)\b", r"\.md\b")))
DEFAULTS = {"search": ("semantic", 0.7), "graph": ("exploratory", 0.6), "export": ("markdown", 0.5), "collection": ("list", 0.5), "tag": ("list", 0.5), "note": ("notes", 0.5)}
GROUPS = {"search": SEARCH_INTENTS, "graph": GRAPH_INTENTS, "summary": SUMMARY_INTENTS, "collection": COLLECTION_INTENTS, "tag": TAG_INTENTS, "note": NOTE_INTENTS, "export": EXPORT_INTENTS}
#: Synonyms that widen a short request.
SYNONYMS = {"ml": ("machine learning", "statistical learning"), "nlp": ("natural language processing", "text mining"), "ai": ("artificial intelligence", "machine intelligence"), "memory": ("recall", "retention"), "learning": ("training", "acquisition"), "attention": ("focus", "salience"), "neural": ("brain", "network"), "review": ("survey", "overview")}


def intent(text: str, kind: str = "search") -> tuple[str, float]:
    """The intent of a request and a confidence."""
    lower = text.lower().strip()
    for name, confidence, patterns in GROUPS[kind]:
        if any(re.search(p, lower) for p in patterns):
            return name, confidence
    if kind == "summary":
        return ("targeted", 0.6) if re.match(r"(what|how|why|who|when|where|which)\b", lower) else ("quick", 0.6) if len(lower.split()) <= 5 else ("comprehensive", 0.6)
    return DEFAULTS[kind]


def intent_column(text: Column, kind: str = "search") -> Column:
    """intent() of a column of requests, as a struct of intent and confidence."""
    lower = F.lower(F.trim(text))
    found = None
    for name, confidence, patterns in GROUPS[kind]:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | lower.rlike(p)
        value = F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    if kind == "summary":
        asks, short = lower.rlike(r"^(what|how|why|who|when|where|which)\b"), F.size(F.array_remove(F.split(lower, r"\s+"), "")) <= 5
        name, confidence = F.when(asks, "targeted").when(short, "quick").otherwise("comprehensive"), 0.6
    else:
        name, confidence = F.lit(DEFAULTS[kind][0]), DEFAULTS[kind][1]
    return found.otherwise(F.struct(name.alias("intent"), F.lit(confidence).alias("confidence")))


def conjunctions(text: Column) -> Column:
    """Whether a request joins parts by and, or, about: a struct of three flags."""
    has = lambda w: F.lower(text).rlike(rf"\s{w}\s")
    return F.struct(has("and").alias("has_and"), has("or").alias("has_or"), has("about").alias("has_about"))


def parameters(text: Column) -> Column:
    """What a request names: quoted (in double quotes), key (8 capitals or digits), limit (a number after last, top, first or recent),
    year_from and year_to, author (after by or from). A struct; what is not named is null."""
    got = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(
        got(r"\"([^\"]+)\"").alias("quoted"), got(r"\b([A-Z0-9]{8})\b").alias("key"),
        got(r"(?i)\b(?:last|top|first|recent) ([0-9]{1,4})\b").cast("int").alias("limit"),
        F.array_min(years).alias("year_from"), F.array_max(years).alias("year_to"), got(r"\b(?:by|from) (\p{Lu}[\p{L}'-]+)").alias("author"),
    )


#: A name in double or single quotes, or a word.
NAMED = r"""(?:"([^"]+)"|'([^']+)'|([\p{L}\p{N}_-]+))"""
ITEM_KEY = r"\b([A-Z0-9]{8})\b"


def _first_of(text: Column, pattern: str, groups: int) -> Column:
    """What the first match's groups caught, of which one is filled; null without a match."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)])


def graph_parameters(text: Column) -> Column:
    """A struct of author (capitalised words after with, of, by or for), concept (words after of, on, about, to or around, up to a
    verb of change or a word that begins another part), start_year and end_year (the first and last of two years or more)."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    several = F.size(years) > 1
    author = _first_of(text, r"\b(?:with|of|by|for)\s+(\p{Lu}[\p{L}'-]+(?:\s+\p{Lu}[\p{L}'-]+)*)", 1)
    concept = _first_of(text, r"(?i)\b(?:of|on|about|to|around)\s+([\p{L}][\p{L} -]{2,29}?)(?=\s+(?:evolv|chang|develop|progress|emerg|from|since|over|between|by|with|in)\p{L}*\b|\s*[?.!,]|\s*$)", 1)
    return F.struct(author.alias("author"), concept.alias("concept"), F.when(several, F.element_at(years, 1)).alias("start_year"), F.when(several, F.element_at(years, -1)).alias("end_year"))


def collection_parameters(text: Column) -> Column:
    """A struct of name (in lower case: what is called or named so, else what follows into, to, from, in or of), keys of items, limit (a number beside recent, latest or last)."""
    called = _first_of(text, rf"(?i)\b(?:called|named)\s+{NAMED}", 3)
    there = _first_of(text, rf"(?i)\b(?:into|to|from|in|of)\s+(?:the\s+|my\s+)?(?:collection\s+)?{NAMED}", 3)
    limit = _first_of(text, r"(?i)\b([0-9]{1,4})\s+(?:most\s+)?(?:recent|latest|last)\b|\b(?:recent|latest|last)\s+([0-9]{1,4})\b", 2).cast("int")
    return F.struct(F.lower(F.coalesce(called, there)).alias("name"), F.regexp_extract_all(text, F.lit(ITEM_KEY), F.lit(1)).alias("keys"), limit.alias("limit"))


def tag_parameters(text: Column) -> Column:
    """A struct of tags (in lower case: names after tag or tags, with more after commas or and) and keys of items."""
    run = F.regexp_extract(text, rf"(?i)\btags?\s+((?:{NAMED}(?:\s*,\s*(?:and\s+)?|\s+and\s+(?=[\"'])))*{NAMED})", 1)
    words = F.regexp_extract_all(run, F.lit(r"""("[^"]+"|'[^']+'|[\p{L}\p{N}_-]+)"""), F.lit(1))
    tags = F.transform(F.filter(words, lambda w: F.lower(w) != "and"), lambda w: F.lower(F.regexp_replace(w, "[\"']", "")))
    return F.struct(tags.alias("tags"), F.regexp_extract_all(text, F.lit(ITEM_KEY), F.lit(1)).alias("keys"))


def years(text: str) -> tuple[int, int] | None:
    found = [int(y) for y in re.findall(r"\b((?:19|20)\d\d)\b", text)]
    return (min(found), max(found)) if found else None


@dataclass(frozen=True)
class SubQuery:
    text: str
    kind: str
    importance: float


def decompose(text: str) -> list[SubQuery]:
    """Parts of a request that are searched apart; a simple request gives one part, itself.

    Tried in order: AND (or with, plus) joins required parts, OR optional ones; a preposition adds what stands on its
    sides at 0.6, commas their parts at 0.5, two or more capitalised phrases those of several words at 0.4, three at
    most, each beside the full request at 1.
    """
    whole = text.strip()
    split = lambda p: [x.strip() for x in re.split(p, whole, flags=re.I) if x.strip()]
    for pattern, kind, importance in ((r"\s+(?:and|with|plus)\s+", "required", 1.0), (r"\s+or\s+", "optional", 0.7)):
        if len(parts := split(pattern)) > 1:
            return [SubQuery(p, kind, importance) for p in parts]
    full = SubQuery(whole, "full", 1.0)
    if len(parts := re.split(r"\s+(?:about|in|on|for|of|using|through)\s+", whole, maxsplit=1, flags=re.I)) == 2:
        return [full, *[SubQuery(p.strip(), "support", 0.6) for p in parts if p.strip()]]
    if len(parts := split(",")) > 1:
        return [full, *[SubQuery(p, "support", 0.5) for p in parts]]
    phrases = re.findall(r"\b[A-Z][\w-]*(?:\s+[A-Z][\w-]*)*", whole)
    if len(phrases) > 1:
        return [full, *[SubQuery(p, "phrase", 0.4) for p in phrases if " " in p][:3]]
    return [SubQuery(whole, "simple", 1.0)]


def decompose_column(text: Column) -> Column:
    """decompose() of a column of requests: an array of struct<text, kind, importance>."""
    whole = F.trim(text)

    def listed(found: Column, kind: str, importance: float) -> Column:
        kept = F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")
        return F.transform(kept, lambda p: F.struct(p.alias("text"), F.lit(kind).alias("kind"), F.lit(importance).alias("importance")))

    one = lambda kind: listed(F.array(whole), kind, 1.0)
    required, optional = listed(F.split(whole, r"(?i)\s+(and|with|plus)\s+"), "required", 1.0), listed(F.split(whole, r"(?i)\s+or\s+"), "optional", 0.7)
    sides, commas = F.split(whole, r"(?i)\s+(about|in|on|for|of|using|through)\s+", 2), listed(F.split(whole, ","), "support", 0.5)
    phrases = F.regexp_extract_all(whole, F.lit(r"\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)*"), F.lit(0))
    several = F.slice(F.filter(phrases, lambda p: p.contains(" ")), 1, 3)
    found = F.when(F.size(required) > 1, required).when(F.size(optional) > 1, optional)
    found = found.when(F.size(sides) == 2, F.concat(one("full"), listed(sides, "support", 0.6))).when(F.size(commas) > 1, F.concat(one("full"), commas))
    return found.when(F.size(phrases) > 1, F.concat(one("full"), listed(several, "phrase", 0.4))).otherwise(one("simple"))


def may_expand(text: str) -> bool:
    """At most four words, no operator, quote or bracket, and a word with synonyms."""
    words = text.lower().split()
    return len(words) <= 4 and not re.search(r"\b(and|or|not)\b|[\"'()]", text.lower()) and any(w in SYNONYMS for w in words)


def expand(text: str) -> str:
    """The request with the first two synonyms of each of its words that has some."""
    return " ".join([text, *[s for w in dict.fromkeys(text.lower().split()) for s in SYNONYMS.get(w, ())[:2]]])


def expand_column(text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+"))
    table = F.create_map(*[x for w, s in SYNONYMS.items() for x in (F.lit(w), F.lit(" ".join(s[:2])))])
    more = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda s: s.isNotNull())
    return F.concat_ws(" ", text, F.array_join(more, " ")) if more is not None else text


def expand_by_quality(text: str, confidence: str | None = None, coverage: float | None = None) -> str:
    """Expanded if results were poor (low confidence or coverage under 0.4); before any results, if it may be."""
    poor = confidence == "low" or (coverage is not None and coverage < 0.4) if confidence or coverage is not None else may_expand(text)
    return expand(text) if poor else text


def key_concepts(hits: DataFrame, text: str, stop: list[str], n: int = 10) -> DataFrame:
    """concept, n: capitalised words and hyphenated terms of the hits' texts, seen twice or more, most frequent first."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"\p{Lu}[\p{L}]{3,}|[\p{Ll}]+-[\p{Ll}]+"), F.lit(0))
    rows = hits.select(F.explode(words).alias("concept")).where(~F.lower("concept").isin(stop))
    return rows.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "concept").limit(n)


def key_concepts_by_query(hits: DataFrame, text: str, n: int = 3) -> DataFrame:
    """query, concepts: the n first of key_concepts() of each query's hits (query, text)."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"\p{Lu}[\p{L}]{3,}|[\p{Ll}]+-[\p{Ll}]+"), F.lit(0))
    counts = hits.select("query", F.explode(words).alias("concept")).groupBy("query", "concept").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = Window.partitionBy("query").orderBy(F.desc("n"), "concept")
    top = counts.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n)
    return top.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "concept"))), lambda x: x["concept"]).alias("concepts"))


def reformulate(text: str, concepts: list[str], n: int = 3) -> list[str]:
    """Other forms of a request: expanded, with its hits' concepts, the concepts alone, with a synonym put in."""
    forms = [expand(text)] if may_expand(text) else []
    forms += [f"{text} {c}" for c in concepts[:2]] + ([" ".join(concepts[:3])] if concepts else [])
    forms += [re.sub(rf"\b{w}\b", s[0], text, flags=re.I) for w, s in SYNONYMS.items() if re.search(rf"\b{w}\b", text, re.I)][:1]
    kept = {f.lower(): f for f in reversed(forms) if f.lower() != text.lower()}
    return [f for f in dict.fromkeys(forms) if kept.get(f.lower()) == f][:n]


def reformulate_column(text: Column, concepts: Column, n: int = 3) -> Column:
    """reformulate() of a column of requests with arrays of concepts."""
    words = F.split(F.lower(text), r"\s+")
    wide = (F.size(F.array_remove(words, "")) <= 4) & ~F.lower(text).rlike(r"\b(and|or|not)\b|[\"'()]") & F.arrays_overlap(words, F.array(*map(F.lit, SYNONYMS)))
    named = F.transform(F.slice(concepts, 1, 2), lambda c: F.concat(text, F.lit(" "), c))
    alone = F.when(F.size(concepts) > 0, F.array(F.array_join(F.slice(concepts, 1, 3), " "))).otherwise(F.array())
    swaps = [F.when(text.rlike(rf"(?i)\b{w}\b"), F.regexp_replace(text, rf"(?i)\b{w}\b", s[0])) for w, s in SYNONYMS.items()]
    forms = F.concat(F.when(wide, F.array(expand_column(text))).otherwise(F.array()), named, alone, F.array_compact(F.array(F.coalesce(*swaps))))
    lower = F.transform(forms, lambda f: F.lower(f))
    first = F.filter(forms, lambda f, i: (F.array_position(lower, F.lower(f)) == i + 1) & (F.lower(f) != F.lower(text)))
    return F.slice(first, 1, n)
