"""Token ids of whole texts by a public tokenizer, a batch at a time: each distinct word of a batch is tokenized once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: The tokenizer file that the queries use; a path is a parameter everywhere.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of text that are tokenized together; a longer text is tokenized alone.
BATCH_BYTES = 8 << 20
#: Words whose normal form is their lower case; the tokenizer cuts an apostrophe's word by other rules.
PLAIN = "^[!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"
WORD_END = "</w>"
#: Characters that stand for the 256 bytes, and for bytes that end a piece; the frequent ones take one byte of UTF-8.
SYMBOLS, ENDS = np.arange(0x100, 0x200, dtype="<u2"), np.arange(0x200, 0x300, dtype="<u2")
SYMBOLS[97:123], ENDS[97:123] = np.arange(97, 123), np.arange(65, 91)
#: Kinds of bytes of PLAIN words: marks, digits, letters.
DIGIT = 1
KINDS = np.array([DIGIT if chr(b).isdigit() else 2 * (chr(b).isalpha() or b > 127) for b in range(128)] + [2] * 128, np.uint8)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def runs(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of counts[i] values of flat from starts[i] on, one after the other."""
    ahead = np.cumsum(counts) - counts
    return flat[np.arange(counts.sum()) + np.repeat(starts - ahead, counts)]


def as_strings(texts: pa.Array) -> pa.Array:
    """Binary UTF-8 as strings; bytes that are none become replacement characters."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())


def symbols(token: str, of_letter: dict[str, int]) -> str:
    """A vocabulary entry in the alphabet of SYMBOLS; if it ends a word, its last byte in that of ENDS."""
    body, end = (token[: -len(WORD_END)], ENDS) if token.endswith(WORD_END) else (token, SYMBOLS)
    data = [of_letter[c] for c in body]
    return "".join(chr(SYMBOLS[b]) for b in data[:-1]) + chr(end[data[-1]])


class WordTokens:
    """Ids of texts.

    The tokenizer drops white space and never joins what stands on its two sides, so a text's ids are those of
    its words in turn. Distinct words of ASCII or Latin-1 letters are cut into pieces as the tokenizer does
    (letters, single digits, other marks) and merged by tiktoken's compiled code, with the same vocabulary: its
    entries' numbers are the merges' ranks, and an entry's own letters always merge to it. A word with an
    apostrophe or other letters goes through the whole tokenizer.
    """

    def __init__(self, path: str, literal: bool = False) -> None:
        """literal: special tokens' strings in a text are ordinary text."""
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = literal
        form = json.loads(Path(path).read_text())
        model = form["model"]
        if form["normalizer"]["normalizers"][-1]["type"] != "Lowercase" or model["end_of_word_suffix"] != WORD_END or self.whole.get_vocab_size() > 1 << 16:
            raise ValueError(f"a lower-casing tokenizer with {WORD_END} and at most 65,536 ids is needed")
        special = [t["content"] for t in form["added_tokens"]]
        self.special = "" if literal else "|".join(map(re.escape, special))
        of_letter = {c: b for b, c in byte_letters().items()}
        ranks = {symbols(token, of_letter): i for token, i in model["vocab"].items() if token not in special}
        self.merges = tiktoken.Encoding("pieces", pat_str="[a-z\u0100-\u01ff]*[A-Z\u0200-\u02ff]", mergeable_ranks={t.encode(): i for t, i in ranks.items()}, special_tokens={})
        self.lengths = np.zeros(1 << 16, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]

    def _of_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of PLAIN words in turn, and how many each has."""
        ends = np.cumsum(pc.binary_length(words).to_numpy())
        data = np.frombuffer("".join(words.to_pylist()).lower().encode(), np.uint8)
        kind = KINDS[data]
        last = np.append(kind[1:] != kind[:-1], True) | (kind == DIGIT)
        last[ends - 1] = True
        codes = np.where(last, ENDS[data], SYMBOLS[data])
        ids = self.merges.encode_to_numpy(codes.tobytes().decode("utf-16-le"), disallowed_special=())
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="right")
        return ids.astype("<u2"), np.diff(upto, prepend=0)

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where each word's begin, and how many it has."""
        plain = pc.match_substring_regex(words, PLAIN)
        if self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(words, self.special)))
        counts = np.zeros(len(words), np.int64)
        at = plain.to_numpy(zero_copy_only=False)
        parts = []
        if at.any():
            ids, counts[at] = self._of_plain(pc.filter(words, plain))
            parts.append(ids)
        rest = [self.whole.encode(w, add_special_tokens=False).ids for w in pc.filter(words, pc.invert(plain)).to_pylist()]
        counts[~at] = [len(ids) for ids in rest]
        parts += [np.array(ids, "<u2") for ids in rest]
        order = np.append(np.flatnonzero(at), np.flatnonzero(~at))
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts) if parts else np.zeros(0, "<u2"), starts, counts

    def _of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        flat, starts, counts = self._of_words(coded.dictionary)
        codes = coded.indices.to_numpy()
        ids = runs(flat, starts[codes], counts[codes])
        upto = np.append(0, np.cumsum(counts[codes]))[ends - ends[0]]
        return np.split(ids, upto[1:-1])

    def of_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (16 bits each) of each of an Arrow array's whole texts (UTF-8 bytes, none null), BATCH_BYTES of them at a time."""
        sizes = pc.binary_length(texts).to_numpy()
        first = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > BATCH_BYTES:
                yield from self._of_texts(as_strings(texts.slice(first, i - first)))
                first, held = i, 0
            held += size
        if len(sizes):
            yield from self._of_texts(as_strings(texts.slice(first)))

    def ids(self, text: str) -> np.ndarray:
        return next(self.of_texts(pa.array([text.encode("utf-8", "replace")], pa.binary())))


@cache
def word_tokens(path: str = WORD_BPE, literal: bool = False) -> WordTokens:
    """One per Python worker."""
    return WordTokens(path, literal)
