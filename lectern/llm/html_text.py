"""Main text of web pages: flat blocks with word counts and link densities, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup or never shown text, skipped to their end tag.
RAW = frozenset("script style title textarea template iframe select button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements kept on the stack; the others, such as p, may stay open.
FRAME = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form head header hgroup html li main menu nav ol search section span table tbody td tfoot th thead tr ul".split()
)
BODY = frozenset(["article", "main"])
#: Elements beside the article, wherever they stand; header only outside it.
BESIDE = frozenset("aside dialog footer form head menu nav".split())
#: Last words of a name (a class, an id or a role) that mark what is beside the article; inside it they are not looked for. A name that only begins so (login-required) says something of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies copyright disclaimer"
    " disqus dialog footer gdpr header login masthead menu modal nav navbar navigation newsletter overlay pagination paywall popup promo promoted promotion respond"
    " sharing sidebar signup social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar widget".split()
)
#: Elements that hold parts of a page: of others, such as quotes, a name says nothing inside the article.
HOLDERS = frozenset("div ol section table ul".split())
#: Whole names of a class or an id that mark such a part inside the article too.
NAMES = frozenset("ad ads advert advertisement comment comments comment-list cookie-banner newsletter share share-buttons sidebar sponsored".split())
#: Words, outside of links, of a page all of whose parts have such names, from which they are its text.
ALONE = 50
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Features of a block: its words and link density, those of the block before and of the one after, marks, and whether it stands in the article's element.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "marks", "inside")
#: FEATURES of a block but the last, then whether it is main text. The first MEASURED rows are blocks of the test data's pages, measured by blocks() and
#: labelled by eye; the others are typical values, set by hand, of layouts those pages lack: plain div elements without marks, comments, sidebars.
MEASURED = 26
BLOCKS = (
    (13, 0.0, 6, 0.0, 68, 0.0, 0, 1), (6, 0.0, 8, 0.0, 13, 0.0, 0, 1), (68, 0.0, 13, 0.0, 92, 0.0, 0, 1), (8, 0.0, 26, 0.0, 11, 0.0, 0, 1),
    (1, 0.0, 61, 0.0, 1, 0.0, 0, 1), (1, 0.0, 1, 0.0, 48, 0.0, 0, 1), (48, 0.0, 1, 0.0, 24, 0.0, 0, 1), (4, 0.0, 34, 0.0, 15, 0.0, 0, 1),
    (2, 0.0, 64, 0.0, 5, 0.0, 0, 1), (5, 0.0, 41, 0.0, 11, 0.0, 0, 1), (17, 0.0, 83, 0.0, 14, 0.0, 0, 1), (218, 0.0, 10, 0.0, 72, 0.0, 0, 1),
    (142, 0.0, 122, 0.0, 12, 0.0, 0, 1), (10, 0.0, 9, 0.0, 50, 0.0, 0, 1), (3, 0.0, 49, 0.0, 40, 0.0, 0, 1), (15, 0.0, 4, 0.0, 64, 0.0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0), (1, 1.0, 1, 1.0, 8, 0.0, 2, 0), (8, 0.0, 1, 1.0, 6, 0.0, 2, 0),
    (12, 0.0, 1, 1.0, 8, 0.0, 2, 0), (7, 0.0, 1, 1.0, 7, 0.0, 2, 0), (11, 0.0, 5, 0.0, 0, 0.0, 2, 0), (14, 0.0, 17, 0.0, 0, 0.0, 2, 0),
    (10, 0.0, 46, 0.0, 0, 0.0, 2, 0), (12, 0.0, 142, 0.0, 0, 0.0, 2, 0), (40, 0.0, 30, 0.0, 25, 0.0, 1, 0), (60, 0.1, 4, 1.0, 70, 0.0, 1, 0),
    (30, 0.0, 0, 0.0, 8, 0.0, 1, 0), (25, 0.0, 40, 0.0, 12, 0.0, 2, 0), (4, 1.0, 0, 0.0, 2, 1.0, 0, 0), (2, 1.0, 4, 1.0, 2, 1.0, 0, 0),
    (1, 1.0, 2, 1.0, 3, 1.0, 0, 0), (6, 1.0, 3, 1.0, 9, 0.0, 0, 0), (2, 1.0, 0, 0.0, 35, 0.0, 0, 0), (1, 0.0, 6, 1.0, 4, 1.0, 0, 0),
    (2, 0.0, 4, 1.0, 5, 1.0, 0, 0), (3, 0.0, 5, 1.0, 3, 1.0, 0, 0), (1, 0.0, 2, 1.0, 8, 0.88, 0, 0), (2, 0.0, 7, 1.0, 2, 1.0, 0, 0),
    (7, 0.0, 3, 1.0, 60, 0.0, 0, 1), (9, 0.0, 1, 1.0, 44, 0.05, 0, 1), (5, 0.0, 6, 1.0, 12, 0.0, 0, 1), (35, 0.0, 2, 1.0, 1, 1.0, 0, 1),
    (44, 0.05, 9, 0.0, 80, 0.0, 0, 1), (30, 0.3, 44, 0.1, 52, 0.0, 0, 1), (12, 0.58, 40, 0.0, 66, 0.0, 0, 1), (6, 1.0, 52, 0.0, 70, 0.1, 0, 1),
    (3, 1.0, 38, 0.0, 45, 0.0, 0, 1), (40, 0.0, 55, 0.0, 3, 1.0, 0, 1), (4, 1.0, 60, 0.0, 5, 1.0, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 0),
    (6, 1.0, 5, 1.0, 0, 0.0, 0, 0), (8, 0.88, 6, 1.0, 3, 1.0, 0, 0), (9, 0.78, 4, 1.0, 0, 0.0, 0, 0), (5, 0.8, 20, 0.9, 0, 0.0, 0, 0),
    (1, 1.0, 35, 0.0, 0, 0.0, 0, 0), (20, 0.8, 6, 1.0, 30, 0.7, 0, 0), (2, 0.0, 80, 0.0, 0, 0.0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1), (3, 0.0, 2, 0.0, 4, 0.0, 0, 1), (6, 0.0, 1, 0.0, 2, 0.0, 0, 1), (2, 0.0, 5, 0.0, 3, 0.0, 0, 1),
    (9, 0.0, 4, 0.0, 7, 0.0, 0, 1), (5, 0.0, 3, 0.0, 0, 0.0, 0, 1), (4, 0.0, 0, 0.0, 3, 0.0, 0, 1), (30, 0.0, 2, 0.0, 1, 0.0, 0, 1),
    (80, 0.0, 1, 0.0, 3, 0.0, 0, 1), (25, 0.0, 6, 0.0, 4, 0.0, 0, 1), (12, 0.2, 3, 0.0, 5, 0.0, 0, 1), (2, 0.0, 0, 0.0, 90, 0.0, 0, 1),
    (12, 0.0, 90, 0.0, 80, 0.0, 1, 0), (50, 0.0, 60, 0.0, 70, 0.0, 2, 0), (9, 0.0, 40, 0.0, 120, 0.0, 1, 0), (3, 0.0, 50, 0.0, 60, 0.0, 1, 0),
    (3, 0.0, 40, 0.0, 4, 1.0, 0, 1), (8, 0.0, 25, 0.0, 2, 1.0, 0, 1), (12, 0.0, 60, 0.1, 5, 1.0, 0, 1), (5, 0.0, 4, 0.0, 3, 1.0, 0, 1),
    (3, 1.0, 2, 1.0, 60, 0.0, 0, 0), (4, 1.0, 3, 1.0, 120, 0.0, 0, 0), (2, 1.0, 0, 0.0, 80, 0.0, 0, 0), (5, 1.0, 30, 0.1, 42, 0.0, 0, 1),
    (2, 0.0, 3, 1.0, 60, 0.0, 0, 1), (1, 0.0, 4, 1.0, 35, 0.0, 0, 1), (3, 0.0, 1, 1.0, 20, 0.0, 0, 1), (2, 0.0, 2, 1.0, 5, 0.0, 0, 1),
)
#: FEATURES of blocks in an article's element, set by hand: linked paragraphs, lists of references, short lines beside them; and marked parts.
WITHIN = (
    (1, 0.0, 0, 0.0, 4, 1.0, 0, 1, 1), (4, 1.0, 1, 0.0, 1, 0.0, 0, 1, 1), (1, 0.0, 4, 1.0, 0, 0.0, 0, 1, 1), (3, 1.0, 2, 1.0, 60, 0.0, 0, 1, 1), (5, 1.0, 3, 1.0, 6, 1.0, 0, 1, 1), (2, 0.0, 0, 0.0, 5, 1.0, 0, 1, 1),
    (6, 1.0, 5, 1.0, 0, 0.0, 0, 1, 1), (20, 0.8, 6, 1.0, 30, 0.7, 0, 1, 1), (9, 0.78, 4, 1.0, 0, 0.0, 0, 1, 1), (12, 0.0, 90, 0.0, 80, 0.0, 1, 1, 0), (5, 1.0, 60, 0.0, 70, 0.0, 1, 1, 0), (40, 0.0, 60, 0.0, 12, 0.0, 2, 1, 0),
)
#: Of the measured rows without marks the blocks stand in an article's element; of the rows set by hand in none.
LABELLED = tuple((*r[:-1], int(i < MEASURED and not r[6]), r[-1]) for i, r in enumerate(BLOCKS)) + WITHIN
DEPTH = 6


@dataclass
class Block:
    """Text between two edges of block elements; marks: how many signs of its markup say that it is beside the article, named: how many of these are names."""

    text: str
    words: int
    linked: int
    marks: int
    inside: bool = False
    named: int = 0

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Frame:
    tag: str
    inside: bool
    marks: int
    named: int = 0


@dataclass
class Node:
    """A test of one feature, or a leaf with its verdict."""

    verdict: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = field(default=None, repr=False)
    high: Node | None = field(default=None, repr=False)

    def judge(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.verdict


def train(rows: tuple[tuple, ...] = LABELLED, depth: int = DEPTH) -> Node:
    """A decision tree by Gini impurity; the last value of a row is its label. Ties go to the first feature and lowest limit."""
    n, good = len(rows), sum(r[-1] for r in rows)
    leaf = Node(2 * good >= n)
    if depth == 0 or good in (0, n):
        return leaf
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            limit = (a + b) / 2
            sides = [[r for r in rows if (r[f] <= limit) is low] for low in (True, False)]
            impurity = sum((g := sum(r[-1] for r in s)) * (len(s) - g) / len(s) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, limit, sides
    if best is None:
        return leaf
    return Node(leaf.verdict, best[1], best[2], train(tuple(best[3][0]), depth - 1), train(tuple(best[3][1]), depth - 1))


def _frame(tag: str, attributes: str, above: Frame) -> Frame:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    body = tag in BODY or found.get("role") == "main" or "articleBody" in found.get("itemprop", "")
    if above.inside or body:
        named = tag in HOLDERS and not NAMES.isdisjoint(names.split())
    else:
        named = not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", name)[-1] for name in names.split())
    beside = tag in BESIDE or (tag == "header" and not above.inside)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
    if tag in ("body", "html"):
        return Frame(tag, above.inside or body, above.marks, above.named)
    return Frame(tag, above.inside or body, above.marks + beside + named + hidden, above.named + named)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; markup that never ends is ended where its parent or the page ends.

    What stands beside an article's element is marked, if that holds at least as many words outside of links. Names say
    nothing where they would leave no text of a page that has ALONE words or more under them.
    """
    found: list[Block] = []
    stack = [Frame("", False, 0)]
    text: list[str] = []
    linked: list[str] = []
    link = False
    raw = ""

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            top = stack[-1]
            found.append(Block(" ".join(words), len(words), len(html.unescape("".join(linked)).split()), top.marks, top.inside, top.named))
        text.clear()
        linked.clear()

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(piece)
            if link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
            link = link and tag != "li" and not (closing and tag in ("ul", "nav", "p"))
        if tag == "a":
            link = not closing
            linked.append(" ")
        elif tag == "br":
            text.append(" ")
        if tag in RAW and not closing and not attributes.endswith("/"):
            raw = re.compile(rf"</{tag}\b[^>]*>", re.I)
            end = raw.search(page, at)
            at = end.end() if end else len(page)
        elif tag in FRAME and not closing and not attributes.endswith("/"):
            if tag == "body":
                del stack[1:]
            stack.append(_frame(tag, attributes, stack[-1]))
        elif tag in FRAME:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                del stack[depth:]
    flush()
    if all(b.marks for b in found) and sum(b.words - b.linked for b in found if b.marks == b.named) >= ALONE:
        for b in found:
            b.marks -= b.named
    words = [sum(b.words - b.linked for b in found if not b.marks and b.inside is inside) for inside in (True, False)]
    if words[0] and words[0] >= words[1]:  # an article's element that is shorter than what stands beside it is not the article
        for b in found:
            b.marks += not b.inside
    return found


def features(rows: list[Block]) -> Iterator[tuple]:
    """FEATURES of each block; a block without neighbours has empty ones."""
    edge = Block("", 0, 0, 0)
    for before, b, after in zip([edge, *rows], rows, [*rows[1:], edge], strict=False):
        yield b.words, round(b.density, 2), before.words, round(before.density, 2), after.words, round(after.density, 2), b.marks, int(b.inside)


def main_text(page: str, tree: Node) -> str:
    """The text of the blocks that the tree takes for main text, one a line."""
    rows = blocks(page)
    return "\n".join(b.text for b, row in zip(rows, features(rows), strict=True) if tree.judge(row))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html: its main text, empty if it has none.

    Null and empty html give an empty text. One row per input row, repeated ones too; extra columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = train()
        for batch in batches:
            texts = [main_text(x.as_py().decode("utf-8", "replace"), tree) for x in batch.column(2)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("page_id", rows.schema[0].dataType), T.StructField("url", rows.schema[1].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(extract, schema)
