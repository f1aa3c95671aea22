"""Line-first cleaning: rules per line drop lines, then documents that lost too much text are rejected."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
GAPS = r"[\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r "
#: A character of a word, and one that counts as a symbol.
INK, SYMBOL = r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
#: A sentence end in any script (Latin, Arabic, Urdu, Devanagari, Ethiopic, Khmer, Burmese, Armenian, CJK), then closing quotes or brackets.
SENTENCE_END = r"[.!?:;\x{2026}\x{037E}\x{0589}\x{061B}\x{061F}\x{06D4}\x{0964}\x{0965}\x{104A}\x{104B}\x{1362}\x{1367}\x{17D4}\x{203C}\x{203D}\x{3002}\x{FF01}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF61}][\x22'\x{201D}\x{2019}\x{BB}\x{300D}\x{300F}\x{FF09})\]]*\z"
#: Lines of at least so many words must end a sentence.
PROSE_WORDS = 8
#: Separators between the entries of a menu or breadcrumb line, of which a line has two.
SEPARATOR = r"[|\x{BB}\x{203A}\x{2022}\x{B7}]"
#: Words of a notice, at most: a longer line that holds such a phrase is a paragraph that speaks of it.
NOTICE_WORDS = 30
#: Phrases of notices in English, German, French and Spanish, in lower case.
BOILERPLATE = (
    "all rights reserved", "javascript is", "javascript must be", "cookie policy", "cookies policy", "cookie settings", "cookies settings", "cookie notice", "cookies notice",
    "privacy policy", "terms of use", "terms of service", "lorem ipsum", "sign in to", "sign in for", "sign up to", "sign up for", "subscribe to our", "click here to",
    "share this", "share on ", "powered by ",
    "alle rechte vorbehalten", "javascript ist", "javascript muss", "akzeptieren sie die cookies", "cookie-einstellungen", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "melden sie sich an", "newsletter abonnieren", "klicken sie hier",
    "tous droits réservés", "javascript est désactivé", "accepter les cookies", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "inscrivez-vous à", "abonnez-vous à", "cliquez ici",
    "todos los derechos reservados", "javascript está desactivado", "aceptar las cookies", "política de privacidad", "política de cookies", "términos de uso", "condiciones de uso", "suscríbete a", "regístrate para", "haz clic aquí",
)
#: Symbol characters per word, and runs of exclamation marks per word, from which a line is noise.
NOISE_PER_WORD = 0.3
#: Documents keep at least this share of their non-blank characters.
KEPT_SHARE = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 5-word window which occurs twice or more in the array; windows compare by XXH64."""
    windows = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5))))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            def at(e: Column, i: Column) -> Column:
                near = lambda j: F.coalesce(F.get(s, j).getField("h") == e.getField("h"), F.lit(False))
                return F.when(near(i - 1) | near(i + 1), e.getField("i"))

            return F.sort_array(F.filter(F.transform(s, at), lambda p: p.isNotNull()))

        def spans(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return _let(_let(placed, twins), spans)

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule: noise, shouting, navigation, boilerplate, or no sentence end.

    White space at the line's end, such as the CR of a CRLF text, is no part of it. Cheap rules come first.
    """
    noise = F.regexp_count(line, F.lit(rf"{SYMBOL}|!!+"))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    notice = _let(F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    by_words = lambda words: (
        (noise > NOISE_PER_WORD * words)
        | ((words >= PROSE_WORDS) & ~F.rtrim(line, F.lit(BLANKS)).rlike(SENTENCE_END))
        | ((words >= 3) & (capitals > 0.7 * letters))
        | ((words <= NOTICE_WORDS) & notice)
    )
    return (
        (F.regexp_count(line, F.lit(SEPARATOR)) >= 2)
        | _let(F.regexp_count(line, F.lit(rf"{INK}+")), by_words)
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_share: float = KEPT_SHARE) -> DataFrame:
    """doc_id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines.

    The base counts are over the whole text; base_failed: fewer than 10 words, or more than 20 % of them in
    repeated 5-word windows. clean_text has the lines that pass line_fails(), in order (blank ones stay).
    kept: not base_failed, and the clean text has kept_share of the text's non-blank characters. Null texts
    count as empty and so fail. One row per input row, repeated ids too; extra columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", words_of(F.col("__text"))).withColumn("__lines", F.split("__text", "\n"))
    inked = lambda c: F.length(F.regexp_replace(c, GAPS, ""))
    good = F.filter("__lines", lambda line: ~line.rlike(INK) | ~line_fails(line))
    inked_lines = F.filter("__lines", lambda line: line.rlike(INK))
    rows = rows.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        inked(F.col("__text")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _let(inked_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        good.alias("__good"),
    )
    rows = rows.withColumn("clean_text", F.array_join("__good", "\n"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = inked(F.col("clean_text")) >= kept_share * F.col("word_chars")
    return rows.select(
        "doc_id", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce("n_repeat_words", F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(failed, F.col("n_words") < 10).alias("base_failed"),
        (~F.coalesce(failed, F.col("n_words") < 10) & left).alias("kept"),
        (F.col("__n_lines") - F.size("__good")).cast("long").alias("n_failed_lines"),
    )


PHRASES = " OR ".join("contains(lower(x), '" + p.replace("'", "''") + "')" for p in BOILERPLATE)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(t, chr(10)) AS lines FROM d
), base AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words, words, lines,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS inked
  FROM w
), win AS (
  SELECT rid, i, array_to_string(list_slice(words, i, i + 4), ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM base)
), rep AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (
    SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
  ) GROUP BY rid
), ln AS (
  SELECT rid, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT rid, unnest(inked) AS x FROM base)
), good AS (
  SELECT rid, sum(chars) AS chars FROM ln
  WHERE NOT (
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) + len(regexp_extract_all(x, '!!+')) > 0.3 * n
    OR (n >= 3 AND length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) > 0.7 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g')))
    OR length(x) - length(regexp_replace(x, '[|\x{{BB}}\x{{203A}}\x{{2022}}\x{{B7}}]', '', 'g')) >= 2
    OR (n <= {NOTICE_WORDS} AND ({PHRASES}))
    OR (n >= 8 AND NOT regexp_matches(regexp_replace(x, '[\x20\x09-\x0D]+\z', ''), '{SENTENCE_END.replace("'", "''")}'))
  ) GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(inked) - len(list_distinct(inked)))::BIGINT AS n_dup_lines,
       coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words) AND coalesce(good.chars, 0) >= 0.5 * word_chars AS kept
FROM base LEFT JOIN rep USING (rid) LEFT JOIN good USING (rid)
"""
