"""Column functions on library items: entries for export, tag sets, annotation positions and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entry types of BibTeX by item type; anything else is misc.
ENTRY_TYPES = {
    "journalArticle": "article", "book": "book", "bookSection": "incollection", "conferencePaper": "inproceedings",
    "thesis": "phdthesis", "report": "techreport", "webpage": "misc", "manuscript": "unpublished", "preprint": "misc",
}
#: Names of the usual highlight colours.
COLOURS = {"#ffd400": "Yellow", "#ff6666": "Red", "#5fb236": "Green", "#2ea8e5": "Blue", "#a28ae5": "Purple", "#e56eee": "Magenta", "#f19837": "Orange", "#aaaaaa": "Gray"}
#: JSON of an annotation's place.
POSITION = "struct<pageIndex: int, rects: array<array<double>>>"


def looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def escaped(text: Column) -> Column:
    """Braces made safe for BibTeX."""
    return F.regexp_replace(text, r"([{}])", r"\\$1")


#: Further fields of an entry, in order.
FIELDS = ("volume", "number", "pages", "publisher", "doi", "url", "abstract")


def joined_authors(creators: Column) -> Column:
    """`Last, First and Name and ...` of the authors in an array of creators (creatorType, firstName, lastName, name); null without any."""
    authors = F.filter(creators, lambda c: c["creatorType"] == "author")
    names = F.transform(authors, lambda c: F.coalesce(F.concat_ws(", ", F.nullif(c["lastName"], F.lit("")), F.when(c["lastName"] != "", F.nullif(c["firstName"], F.lit("")))), F.lit("")))
    named = F.filter(F.transform(F.arrays_zip(names.alias("n"), authors.alias("a")), lambda z: F.when(z["n"] != "", z["n"]).otherwise(F.coalesce(z["a"]["name"], F.lit("")))), lambda n: n != "")
    return F.when(F.size(named) > 0, F.array_join(named, " and "))


def bibtex_full(item_type: Column, key: Column, creators: Column, title: Column, date: Column, publication: Column, **more: Column) -> Column:
    """An entry with all fields: title, journal, those of FIELDS that are given, authors, year; empty ones are left out.

    Its key is the first creator's last name without blanks (of a single name the last word), the year or "nodate", and the item key.
    """
    first = F.get(creators, 0)
    word = F.coalesce(F.nullif(first["lastName"], F.lit("")), F.element_at(F.split(first["name"], r"\s+"), -1), F.lit(""))
    year = F.nullif(F.substring(date, 1, 4), F.lit(""))
    head = F.concat(F.lit("@"), looked_up(item_type, ENTRY_TYPES, "misc"), F.lit("{"), F.regexp_replace(word, " ", ""), F.coalesce(year, F.lit("nodate")), F.lit("_"), key.cast("string"))
    given = {"title": title, "journal": publication, **{name: more[name] for name in FIELDS if name in more}}
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    fields = [line(name, escaped(value)) for name, value in given.items()] + [line("author", joined_authors(creators)), line("year", year)]
    return F.concat(F.concat_ws(",\n", head, *fields), F.lit("\n}"))


def bibtex(item_type: Column, key: Column, author: Column, title: Column, year: Column, publication: Column) -> Column:
    """A short entry: its key is the first author's last word, the year and the item key; empty fields are left out."""
    word = F.regexp_extract(author, r"([\p{L}\p{N}#]+)[^\p{L}\p{N}#]*$", 1)
    head = F.concat(F.lit("@"), looked_up(item_type, ENTRY_TYPES, "misc"), F.lit("{"), F.coalesce(word, F.lit("")), F.coalesce(year, F.lit("")), F.lit("_"), key.cast("string"))
    field = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name} = {{"), escaped(value), F.lit("}")))
    fields = [field("title", title), field("author", author), field("year", year), field("journal", publication)]
    return F.concat(F.concat_ws(",\n", head, *fields), F.lit("\n}"))


def markdown(key: Column, title: Column, author: Column, date: Column, item_type: Column, body: Column, publication: Column | None = None) -> Column:
    """A document with YAML front matter, a heading and a body; the publication stands in both, where there is one."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '\\\\"'), F.lit('"'))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), quoted(title)), F.concat(F.lit("authors: "), quoted(author)), F.concat(F.lit("date: "), quoted(date)), F.concat(F.lit("type: "), quoted(item_type)), *([F.when(publication != "", F.concat(F.lit("publication: "), quoted(publication)))] if publication is not None else []), F.concat(F.lit("key: "), key.cast("string")), F.lit("---"))
    shown = [F.when(publication != "", F.concat(F.lit("**Publication:** "), publication))] if publication is not None else []
    return F.concat_ws("\n\n", front, F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), *shown, F.coalesce(body, F.lit("")))


def file_name(title: Column, key: Column, width: int = 50) -> Column:
    """A safe name: letters, digits, blanks and hyphens of the title, cut to width, with the key."""
    safe = F.trim(F.substring(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N} _-]", ""), 1, width))
    return F.concat_ws("_", F.nullif(F.regexp_replace(safe, r"\s+", "_"), F.lit("")), key.cast("string"))


def tags_added(tags: Column, new: Column) -> Column:
    """tags with those of new that are absent, whatever their case; the first of equal new ones."""
    lower = F.transform(tags, lambda t: F.lower(t))
    fresh = F.filter(new, lambda t, i: ~F.array_contains(lower, F.lower(t)) & ~F.exists(F.slice(new, 1, i), lambda o: F.lower(o) == F.lower(t)))
    return F.concat(tags, fresh)


def tags_removed(tags: Column, old: Column) -> Column:
    gone = F.transform(old, lambda t: F.lower(t))
    return F.filter(tags, lambda t: ~F.array_contains(gone, F.lower(t)))


def tag_condition(tags: Column, expressions: list[str]) -> Column:
    """All of expressions: 'a || b' needs one of its tags, '-a' must be absent."""
    met = F.lit(True)
    for expression in expressions:
        any_of = F.lit(False)
        for part in (p.strip() for p in expression.split("||")):
            has = F.array_contains(tags, part.removeprefix("-"))
            any_of = any_of | (~has if part.startswith("-") else has)
        met = met & any_of
    return met


def annotation(position: Column, colour: Column) -> Column:
    """Page from 1, left, bottom and colour name of an annotation's JSON position."""
    place = F.from_json(position, POSITION)
    rect = F.get(place["rects"], 0)
    return F.struct((place["pageIndex"] + 1).alias("page"), F.get(rect, 0).alias("x"), F.get(rect, 1).alias("y"), looked_up(F.lower(colour), COLOURS, "other").alias("colour"))
