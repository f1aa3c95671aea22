"""Tokens, packing, token files, audio: exact round trips and brute force."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import audio, packing, token_files, tokens
from lectern.llm.scratch import folder

DATA = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(tokens.WORD_BPE)
ROWS = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "<|endoftext|> It's 1st"), (5, "wörd " * 5000), (6, "日本語 ½ I'll\x1cgo\xa0on")]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300)
@given(st.text(max_size=40) | st.text(alphabet="aZ'é1. \n\x1c\xa0<|>ßİ$", max_size=30))
def test_word_tokens(text):
    assert tokens.word_tokens().ids(text).tolist() == ids_of(text)


@given(st.lists(st.integers(1, 5000), max_size=40))
def test_windows(lengths):
    pieces = [(n, i, 0) for i, n in enumerate(lengths)]
    full, left = packing.windows(list(pieces))
    assert all(sum(p[0] for p in parts) == tier for tier, parts in full) and sum(p[0] for p in left) < 2048
    more, none = packing.windows(list(pieces), last=True)
    assert none == [] and sum(sum(p[0] for p in parts) != tier for tier, parts in more) <= 1
    for made in (full + [(0, left)], more):
        found = sorted((doc, start, n) for _, parts in made for n, doc, start in parts)
        at = dict.fromkeys(range(len(lengths)), 0)
        for doc, start, n in found:
            assert at[doc] == start
            at[doc] += n
        assert at == dict(enumerate(lengths))


def check_packed(rows, got):
    by_doc, by_sequence = {}, {}
    for r in sorted(got, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in sorted(got, key=lambda r: r.offset):
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, text in rows:
        want = np.array(ids_of(text) + [1], "<u4")
        at = 0
        for r in by_doc[key]:
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 2048
    return sizes


def test_packing_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = check_packed([(r.doc_id, r.text) for r in docs.collect()], packing.packed(docs).collect())
    assert sum(n & (n - 1) != 0 for n in sizes) <= 1


def test_packing_cases(spark):
    once = [r for i, r in enumerate(ROWS) if i != 3]
    df = spark.createDataFrame([(k, t, 9) for k, t in once], "doc_id long, text string, tier int").coalesce(1)
    check_packed(once, packing.packed(df).collect())
    with_ids = packing.packed(df, with_ids=True).where("doc_id = 3").first()
    assert with_ids.ids == ids_of("a") + [1]
    assert packing.packed(df.limit(0)).count() == 0
    twice = spark.createDataFrame(ROWS, "doc_id long, text string").where("doc_id = 3")
    assert sorted(r.length for r in packing.packed(twice).collect()) == [2, 2]


@pytest.mark.parametrize("block", [8, 4 << 20])
def test_token_files(spark, block):
    literal = Tokenizer.from_file(tokens.WORD_BPE)
    literal.encode_special_tokens = True
    df = spark.createDataFrame([(k, t, "f") for k, t in ROWS], "doc_id long, text string, file string").repartition(3)
    at = folder(spark)
    manifest = token_files.stored(token_files.written(df, at))
    scan = token_files.scanned(spark, at, block_bytes=block)
    got = manifest.join(scan, ["file", "ordinal"]).collect()
    assert scan.count() == len(ROWS) and all(r.ended for r in got)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((k, len(literal.encode(t or "", add_special_tokens=False).ids)) for k, t in ROWS), key=repr)


def test_token_scan_of_unended_files(spark, tmp_path):
    (tmp_path / "tokens-0.bin").write_bytes(struct.pack("<6H", 7, 49407, 49407, 8, 9, 10))
    (tmp_path / "tokens-1.bin").write_bytes(struct.pack("<2H", 7, 8))
    (tmp_path / "tokens-2.bin").write_bytes(b"")
    got = token_files.scanned(spark, f"file://{tmp_path}", block_bytes=4).collect()
    assert sorted((r.file[7], r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == [("0", 0, 0, 1, True), ("0", 1, 2, 0, True), ("0", 2, 3, 3, False), ("1", 0, 0, 2, False)]


def test_token_counts_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_files.counted(docs).collect()}
    assert got == {r.doc_id: len(ids_of(r.text)) for r in docs.collect()}
    assert token_files.counted(docs.limit(0)).count() == 0


def plain_ima(block):
    sample, step = struct.unpack("<hB", block[:3])
    step, out = min(step, 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            size = int(audio.IMA_STEPS[step])
            change = (size >> 3) + (size >> 2 if code & 1 else 0) + (size >> 1 if code & 2 else 0) + (size if code & 4 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            step = max(0, min(88, step + int(audio.IMA_MOVES[code & 7])))
            out.append(sample)
    return out


@given(st.binary(min_size=2 * audio.UNIT, max_size=2 * audio.UNIT))
@settings(max_examples=20)
def test_ima(data):
    want = [plain_ima(data[: audio.UNIT]), plain_ima(data[audio.UNIT :])]
    assert audio.decode_ima(np.frombuffer(data, np.uint8).reshape(2, -1)).tolist() == want


def test_g711_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a.max(), a.min()) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def test_resampled():
    assert audio.resampled(np.array([0, 10, -10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]


@pytest.mark.parametrize("codec", [audio.MULAW, audio.ALAW, audio.IMA_ADPCM])
def test_audio_round_trip(spark, codec):
    df = spark.createDataFrame([(k, t, b"x") for k, t in ROWS], "doc_id long, text string, media binary")
    got = audio.expanded(audio.stored_audio(df, codec)).collect()
    assert len(got) == len(ROWS)
    for r, (key, text) in zip(got, ROWS, strict=True):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (key, len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        media = audio.wav(payload, codec)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.pcm == audio.resampled(audio.decode(payload, codec), 8000, 16000).tobytes()
    assert got[2].feature == got[3].feature
    assert audio.expanded(audio.stored_audio(df.limit(0), codec)).count() == 0


def test_tiers_and_step_groups(spark):
    """Mixed lengths use every tier, and the step groups of a tier differ by one window, across partitions."""
    lengths = [(i * 7919) % 2500 + 1 if i % 4 else (i * 31) % 120 + 1 for i in range(600)]
    full, _ = packing.windows([(n, i, 0) for i, n in enumerate(lengths)])
    used = {t: sum(t == tier for tier, _ in full) for t in packing.TIERS}
    assert min(used.values()) >= 4
    df = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(5)
    got = packing.with_steps(token_files.stored(packing.packed(df)), 4096).where("offset = 0").groupBy("tier", "step_id").count().collect()
    for tier in packing.TIERS:
        sizes = {r.step_id: r["count"] for r in got if r.tier == tier}
        assert sorted(sizes) == list(range(-(-sum(sizes.values()) * tier // 4096))) and max(sizes.values()) - min(sizes.values()) <= 1


def test_tokens_of_a_batch():
    """Texts of all kinds tokenized together, bytes that are no UTF-8 among them, give each text's own ids."""
    import pyarrow as pa

    texts = [t or "" for _, t in ROWS] + ["CAFÉ 12th-century naïve!!! x'll", " \n ", "Ünïcode ÿ×÷ß µ"]
    got = list(tokens.word_tokens().of_texts(pa.array([t.encode() for t in texts], pa.binary())))
    assert [g.tolist() for g in got] == [ids_of(t) for t in texts]
    assert next(tokens.word_tokens().of_texts(pa.array([b"a \xff b"], pa.binary()))).tolist() == ids_of("a � b")
