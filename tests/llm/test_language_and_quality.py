"""Language identification, quality rules and page texts."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import html_text, langid, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_held_out(spark, docs):
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identified(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows if len(r.text) > 200) == 0


def test_language_cases(spark, docs):
    model = langid.fit(docs)
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %", "x"), (None, "The thing of the other and that", "x"), (5, "The thing of the other and that", "y")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identified(rows, model).collect()]
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert {g[1] for g in got if g[0] in (None, 5)} == {"en"}
    assert langid.identified(rows.limit(0), model).count() == 0
    assert langid.fit(rows.limit(0).withColumnRenamed("lang_pred", "lang")).dictionaries == ()


def repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    return len({i + j for i, w in enumerate(windows) if w in twice for j in range(5)})


TEXTS = [None, "", "a b c d e f", "a b c d e a b c d e", "x a b c d e y a b c d e z a b c d e", "one.\none.\n\ntwo # $", "a " * 40, "\x0b tab\tthing\x0c ende  \r\n", "Home | About | Contact\n" + "This is a whole sentence of many plain words here. " * 3]


def test_quality_counts(spark):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, kept string")
    got = quality.clean_lines(rows).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        text = TEXTS[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(words))
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
    assert quality.clean_lines(rows.limit(0)).count() == 0


def test_quality_lines(spark):
    good, bad = "This is a whole sentence of ten plain words here now.", ["Home | About | Contact | Help", "BUY NOW AND SAVE BIG MONEY", "We use a cookie policy here.", "never ends with a mark of any kind at all", "a# b$ c% d&"]
    rows = spark.createDataFrame([(0, "\n".join([good, *bad])), (1, "\n".join([good, "Another line with other words that also ends well."]))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean_lines(rows).collect()}
    assert got[0].clean_text == good and got[0].n_failed_lines == 5 and not got[0].kept
    assert got[1].kept and got[1].n_failed_lines == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body class="page">
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies.</div>
<article class="post"><header class="entry-header"><h1>Title &lt;1&gt;</h1></header><p>First&nbsp;para with <b>bold</b> and <a href="x>y">a link</a>.<br>Second   line &eacute; &#233;</p>
<p>Unclosed <i>para<p>Te.<div class="ad">Buy!</div><form><input value="z"><p>Search</p></form><ul class="share"><li>Tweet</li></ul><blockquote>Quoted.</blockquote>
<section id="comments"><p>Nice post</p></section><footer>By me</footer></article><aside><p>Other things to read here and there.</p></aside><footer>&copy; x</footer></body></html>"""


def test_page():
    want = ["Title <1>", "First para with bold and a link. Second line é é", "Unclosed para", "Te.", "Quoted."]
    assert html_text.main_text(PAGE, html_text.train()).split("\n") == want


def test_page_cases(spark):
    cut = "<article><p>Whole.</p><p>Cut &am"
    plain_page = "<div><a href=x>Home</a> <a href=y>News</a></div><div>" + "Many words of running text stand here. " * 5 + "</div><div><a href=z>Next</a></div>"
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", cut, "x"), (3, "u", cut, "x"), (4, None, plain_page, "x"), (5, "u", "<p", "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extracted(rows).collect()]
    assert got[:4] == [(1, ""), (2, ""), (3, "Whole.\nCut &am"), (3, "Whole.\nCut &am")] and got[5] == (5, "")
    assert got[4][1].startswith("Many words") and "Home" not in got[4][1] and "Next" not in got[4][1]
    assert html_text.extracted(rows.limit(0)).count() == 0


LONG = "words of a story that goes on and on " * 12


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>one</p><p><a href=x>a linked paragraph here</a></p><p>two</p></article>", ["one", "a linked paragraph here", "two"]),
        (f"<article><h2>References</h2><ul><li><a href=1>First paper</a></li><li><a href=2>Second paper</a></li></ul><p>{LONG}</p></article>", ["References", "First paper", "Second paper", LONG.strip()]),
        (f'<article><p>{LONG}</p><blockquote id="comment">A quoted remark.</blockquote><p>More text.</p></article>', [LONG.strip(), "A quoted remark.", "More text."]),
        (f'<nav><a href=1>Home</a></nav><div class="legal"><h1>Terms</h1><p>{LONG}</p></div>', ["Terms", LONG.strip()]),
        (f'<nav><a href=1>Home</a></nav><div class="story login-required"><h1>Story</h1><p>{LONG}</p></div>', ["Story", LONG.strip()]),
        (f'<nav><a href=1>Home</a></nav><div class="sidebar"><p>{LONG}</p></div>', [LONG.strip()]),
        (f"<main><p>Short intro.</p></main><div><h1>Title of it</h1><p>{LONG}</p></div>", ["Short intro.", "Title of it", LONG.strip()]),
        (f'<article><p>{LONG}</p><div class="comments"><p>Readers say hello.</p></div></article><div class="ad">Buy.</div><footer>c</footer>', [LONG.strip()]),
        ('<div class="site-header"><p>Name</p></div><nav><a href=1>Home</a></nav>', [""]),
    ],
)
def test_article_text_stays(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.train()).split("\n") == want


def test_pages_against_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if inside:
            parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside[1])]
            assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_tree_fits_its_table():
    tree = html_text.train()
    assert sum(tree.judge(r[:-1]) == bool(r[-1]) for r in html_text.LABELLED) >= 0.95 * len(html_text.LABELLED)


def test_tree_looks_at_neighbours():
    """The same short block is a menu's heading between links and a heading of the text before a paragraph; without neighbours the tree can't tell."""
    tree, names = html_text.train(), html_text.FEATURES
    used = set()
    nodes = [tree]
    while nodes:
        node = nodes.pop()
        if node.feature >= 0:
            used.add(names[node.feature])
            nodes += [node.low, node.high]
    assert used & {"words_before", "density_before"} and used & {"words_after", "density_after"} and used >= {"density", "marks"}
    soup = "<div><a href=a>Home page</a></div><div><a href=b>All our news</a></div><div>Topics</div><div><a href=c>Art and life</a></div><div><a href=d>Sport of today</a></div>"
    soup += "<div>The heading</div><div>" + "Many words of running text stand here. " * 5 + "</div><div><a href=e>More of this</a></div><div><a href=f>Imprint</a></div>"
    got = html_text.main_text(soup, tree).split("\n")
    assert got[0] == "The heading" and len(got) == 2
    alone = [(*r[:2], *[0] * 4, *r[6:]) for r in html_text.LABELLED]
    assert "Topics" in html_text.main_text(soup, html_text.train(tuple(alone)))


def test_article_text_is_kept_whole():
    page = """<article><h2>A title</h2><section id="related-work"><p>Related work.</p></section><div class="legal"><p>The law says so.</p></div><p>Let <math><mi>x</mi></math> be one.</p>
<div class="search-methods"><p>Searching well.</p></div><noscript><p>Told without scripts.</p></noscript><object><p>Of an object.</p></object></article>"""
    want = ["A title", "Related work.", "The law says so.", "Let x be one.", "Searching well.", "Told without scripts.", "Of an object."]
    assert html_text.main_text(page, html_text.train()).split("\n") == want


def test_language_margin(spark, docs):
    import random

    rng = random.Random(1)
    dutch = "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen"
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (200, 2_000, 20_000, 100_000)]
    texts = [dutch, dutch * 8, polish, polish * 8, *junk]
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert [r.doc_id for r in found.where("NOT rejected").collect()] == []


def test_repeated_texts_do_not_hide_a_language(spark):
    """A language of few distinct texts, each many times, or of texts that differ in a number only, is learned."""
    spanish = "Todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón"
    english = [f"All human beings are born free and equal in dignity and rights, said number {i} of the {i % 7} speakers" for i in range(300)]
    rows = [("es", spanish)] * 3000 + [("en", t) for t in english]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert {lang for lang, _ in model.dictionaries} == {"es", "en"}
    many = langid.fit(spark.createDataFrame([(f"l{i}", f"words of the language {i} " * 3) for i in range(400)], "lang string, text string"))
    assert len(many.dictionaries) == 400


def test_quality_equals_sql_on_odd_texts(spark):
    """CRLF texts, sentence ends of other scripts, trailing tabs and lone CRs mean the same in Spark and in SQL."""
    import duckdb

    line = "This is a whole sentence of ten plain words here now"
    hindi = "यह एक पूरा वाक्य है जिसमें दस सादे शब्द हैं।"
    texts = [f"{line}.\r\n" * 8, "".join(" ".join(f"w{i}x{j}" for j in range(10)) + ".\t\r\n" for i in range(9)), hindi, "\n".join(" ".join(f"शब्द{i}{j}" for j in range(9)) + "।" for i in range(6)), f"{line}\x85 and on.\n" * 3, f"{line}. {line}\r{line}.", None, "", "یہ ایک مکمل جملہ ہے جس میں دس سادہ الفاظ ہیں۔\n" * 2, "SIGN UP TO Our list\nａｂ ｃ！", "A 1 B 2 C 3", "ПРИВЕТ ВСЕМ ЛЮДЯМ\nпривет всем людям на этой большой и старой земле."]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    got = sorted(tuple(r) for r in quality.clean_lines(df).selectExpr(*columns.split(", ")).collect())
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({quality.ORACLE_SQL})").fetchall())
    kept = {r[0] for r in got if r[-1]}
    assert {1, 3} <= kept


def test_notices_of_four_languages(spark):
    prose = "This is a sentence of the text that says something of its own."
    notices = ["All rights reserved.", "Alle Rechte vorbehalten.", "Bitte akzeptieren Sie die Cookies.", "Tous droits réservés.", "Veuillez accepter les cookies.", "Todos los derechos reservados.", "Lea nuestra política de privacidad."]
    df = spark.createDataFrame([(1, "\n".join([prose, *notices, prose + " More."])), (2, "\n".join(notices))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.clean_lines(df).collect()}
    assert got[1].clean_text == f"{prose}\n{prose} More." and got[1].n_failed_lines == len(notices)
    assert not got[2].kept and got[2].clean_text == ""
