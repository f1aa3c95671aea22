"""Column functions on text: tokens, markup, chunks, context, and the string forms of creators and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two characters or more; \w would be ASCII only in Java.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Frequent words left out of sparse vectors.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his if in into is it its no not of on or she so such than that the their then there these they this to was we"
    " were what when which who will with you aber als am an auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im in"
    " ist ja kein man mich mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """tokens() without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def stripped_html(markup: Column) -> Column:
    """Text of simple markup: scripts and styles go with their content, other tags become blanks, white space is squeezed."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def note_lines(markup: Column) -> Column:
    """A note's body with paragraph ends and breaks as line ends, other tags dropped."""
    text = F.regexp_replace(markup, r"(?i)</p>|<br ?/?>", "\n")
    return F.trim(F.regexp_replace(text, r"(?s)<[^>]*>", ""))


def note_title(body: Column, width: int = 50) -> Column:
    """First line, cut to width with an ellipsis."""
    line = F.substring_index(body, "\n", 1)
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


def slices(text: Column, width: int) -> Column:
    """The text cut into pieces of width characters, the last one shorter; none of an empty text."""
    n = F.ceil(F.length(text) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def token_windows(text: Column, most: int) -> Column:
    """The text's white-space tokens in consecutive windows of at most `most`, joined by blanks."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    n = F.ceil(F.size(words) / most).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * most + 1, most), " "))).otherwise(F.array().cast("array<string>"))


def in_context(text: Column, word: str, before: int = 100, after: int = 200) -> Column:
    """The text around the first hit of word (any case), the hit in ** **; null without a hit."""
    at = F.locate(word.lower(), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    hit = F.substring(text, at, F.lit(len(word)))
    found = F.concat(F.substring(text, start, at - start), F.lit("**"), hit, F.lit("**"), F.substring(text, at + len(word), F.lit(after - len(word))))
    return F.when(at > 0, found)


def filled(value: Column) -> Column:
    """The value without outer blanks, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def document_text(title: Column, creators: Column, abstract: Column, publication: Column, tags: Column, note: Column, fulltext: Column) -> Column:
    """What an item is indexed by: its fields in turn, tags (an array) joined, the note without markup; empty ones left out."""
    parts = [title, creators, abstract, publication, F.array_join(tags, " "), stripped_html(note), fulltext]
    return F.concat_ws(" ", *[filled(p) for p in parts])


def searchable_text(fields: dict[str, Column]) -> Column:
    """Labelled sections with a blank line between; empty fields are left out."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{label}: "), filled(value)) for label, value in fields.items()])


def snippet(body: Column, width: int = 200) -> Column:
    """A note's text without markup, cut to width with an ellipsis."""
    text = F.trim(note_lines(body))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def truncated(text: Column, tokens_most: int = 5000, chars_per_token: int = 3) -> Column:
    return F.substring(text, 1, tokens_most * chars_per_token)


def normal_key(text: Column) -> Column:
    """Lower case without white space, for comparing identifiers and titles."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def creators_text(creators: Column, missing: str = "No authors listed") -> Column:
    """array<struct<firstName, lastName, name>> as 'Last, First; Last, First'; a single name stays as it is."""

    def one(c: Column) -> Column:
        both = c["firstName"].isNotNull() & c["lastName"].isNotNull()
        return F.when(both, F.concat(c["lastName"], F.lit(", "), c["firstName"])).otherwise(F.coalesce(c["name"], c["lastName"], c["firstName"]))

    names = F.filter(F.transform(creators, one), lambda x: x.isNotNull())
    return F.when(F.size(names) > 0, F.array_join(names, "; ")).otherwise(F.lit(missing))


def creators_array(text: Column) -> Column:
    """The inverse of creators_text(): parts at ';', each split at the first ','."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        last, first = F.trim(F.substring_index(p, ",", 1)), F.trim(F.substring(p, F.locate(",", p) + 1, F.length(p)))
        return F.when(F.locate(",", p) > 0, F.struct(first.alias("firstName"), last.alias("lastName"), F.lit(None).cast("string").alias("name"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("firstName"), F.lit(None).cast("string").alias("lastName"), p.alias("name"))
        )

    return F.transform(parts, one)


def citation_key(extra: Column) -> Column:
    """The value of a 'Citation Key:' line; null without one."""
    found = F.regexp_extract(extra, r"(?im)^citation ?key:[ \t]*(\S+)", 1)
    return F.when(found != "", found)


def item_key(text: Column) -> Column:
    """An 8-character key from a URI, a URL or bare text; null if there is none."""
    forms = (r"items/([A-Z0-9]{8})(?![A-Z0-9])", r"[?&]key=([A-Z0-9]{8})(?![A-Z0-9])", r"^\s*([A-Z0-9]{8})\s*$")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, form, 1), F.lit("")) for form in forms])


def parent_key(key: Column, parent: Column) -> Column:
    """A chunk's paper: its parent, else its own key without the chunk suffix."""
    return F.coalesce(F.nullif(parent, F.lit("")), F.substring_index(key, "_chunk_", 1))


def uuid5(namespace: Column, name: Column) -> Column:
    """Name-based UUID (RFC 4122, version 5) of a namespace in its hyphenated form and a name."""
    digest = F.sha1(F.concat(F.unhex(F.regexp_replace(namespace, "-", "")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )
