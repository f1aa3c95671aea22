"""Language identification by compression: the language whose dictionary compresses a text best."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import small

#: Distinct texts sampled per language to fill its dictionary, and characters taken of each, from anywhere in it.
SAMPLE_TEXTS, SAMPLE_CHARS = 512, 1_024
#: Bytes of a language's dictionary, and of all together: with many languages each has fewer.
DICT_BYTES, ALL_BYTES = 96 << 10, 24 << 20
#: A text is compressed in pieces of so many characters, each against the whole dictionary.
PIECE_CHARS = 2_048
LEVEL = 13
#: Share of the smallest size by which the second language's must be larger; else the text is rejected. In labelled rows
#: that are not held out 0.99 of the texts have 0.1 or more, texts of a language without a dictionary 0.023 at most.
MARGIN = 0.025
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, the one with most rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        made = []
        for lang, content in self.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            made.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)))
        return made


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def plain(text: str) -> str:
    """Lower case, and one space for white space, digits and marks."""
    return " ".join(re.findall(r"[^\W\d_]+", text.lower()))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A dictionary per non-null language of docs, from SAMPLE_CHARS characters of each of at most SAMPLE_TEXTS texts.

    The sample is the distinct texts with the smallest hashes, found by a threshold per language from its number of
    distinct texts, so that about 2 x SAMPLE_TEXTS of each language reach the driver, however often a text is
    repeated; the hash tells also where in a text its part begins. Lines that the sample repeats, such as
    licences, say little of a language and are left out, unless nothing else is left. Null and empty texts teach nothing.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text <> ''")
    span = 1 << 30
    hashed = known.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(span)))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.xxhash64("text")).alias("texts")).collect()
    limits = [(r.lang, math.ceil(min(1.0, 2 * SAMPLE_TEXTS / r.texts) * span)) for r in counts]
    below = small(docs.sparkSession.createDataFrame(limits, "__lang string, __below long"), len(limits), 64)
    sampled = hashed.join(below, F.col("lang").cast("string") == F.col("__lang")).where("h < __below")
    part = F.substring("text", F.pmod("h", F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text")
    texts: dict[str, list] = defaultdict(list)
    for r in sampled.select("lang", "h", part).distinct().collect():
        texts[r.lang].append((r.h, r.text))
    lines = {lang: [line for _, t in sorted(sample)[:SAMPLE_TEXTS] for line in map(plain, t.split("\n"))] for lang, sample in texts.items()}
    often = Counter(line for own in lines.values() for line in own)
    most = min(DICT_BYTES, ALL_BYTES // max(1, len(counts)))
    made = []
    for r in sorted(counts, key=lambda r: (-r.n, r.lang)):
        own = lines.get(r.lang, [])
        content = " ".join(line for line in own if often[line] == 1).encode()
        content = content if len(content) >= 8 else " ".join(dict.fromkeys(own)).encode()
        made.append((r.lang, content[-most:]))
    return LanguageModel(tuple((lang, content) for lang, content in made if len(content) >= 8))


def sizes(text: str, compressors: list) -> list[int]:
    """Compressed bytes of the whole text by language."""
    pieces = [text[i : i + PIECE_CHARS].encode() for i in range(0, len(text), PIECE_CHARS)]
    return [sum(len(c.compress(p)) for p in pieces) for _, c in compressors]


def language_of(text: Column, model: LanguageModel) -> Column:
    """lang_pred, score and rejected of a whole text, as a struct; see identified()."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for batch in batches:
            found = []
            for data in batch:
                words = (data or b"").decode("utf-8", "replace")
                if not compressors or not LETTER.search(words):
                    found.append((UNKNOWN, 0.0, True))
                    continue
                ranked = sorted(zip(sizes(plain(words), compressors), range(len(compressors)), strict=True))
                least = ranked[0][0]
                gap = ranked[1][0] - least if len(ranked) > 1 else least
                found.append((compressors[ranked[0][1]][0], 1 - math.exp(-gap / 8), gap < MARGIN * least))
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    return predict(text.cast("binary"))


def identified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row's whole text.

    lang_pred is the language of the smallest size, of equals the one with most rows; und (score 0, rejected) if
    the text is null or has no letter, or nothing was learned. score, 0 to 1: 1 - exp(-d / 8), d the bytes to the
    second language. rejected: d is less than MARGIN of the smallest size, however
    long the text. Only the text matters: repeated rows get equal values.
    Extra columns are left out; an empty table gives an empty one.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), language_of(F.col(text_col), model).alias("__found"))
    return found.select("doc_id", "__found.*")
