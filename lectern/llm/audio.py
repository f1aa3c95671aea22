"""Telephony audio columns: 8-bit codes in WAV containers, expanded to resampled 16-bit PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: WAV format tags.
MULAW, ALAW, IMA_ADPCM = 7, 6, 17
RATE = 8_000
PCM_RATE = 16_000
#: Payloads are padded with PAD to a positive multiple of UNIT bytes, which is also an ADPCM block.
UNIT, PAD = 192, b" "
#: Payload bytes decoded together; a longer recording is decoded alone.
BATCH_BYTES = 4 << 20

# Fixed values of IMA ADPCM.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, low + 264 << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next step number, by 16 x step number + code."""
    step, code = IMA_STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
    after = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_MOVES[code & 7], 0, len(IMA_STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
IMA_CHANGE, IMA_AFTER = ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, one row per block, of mono IMA ADPCM blocks (uint8, one row per block).

    A block has its first sample (2 bytes), its step number (1, above 88 taken as 88), a spare byte, then codes,
    low half first. One step of the loop decodes one sample of all blocks.
    """
    n = blocks.shape[0]
    codes = np.empty((blocks.shape[1] - 4) * 2 * n, np.uint8).reshape(-1, n)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    sample = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = sample
    for i, code in enumerate(codes):
        at += code
        sample += IMA_CHANGE[at]
        np.clip(sample, -32768, 32767, out=sample)
        out[i + 1] = sample
        at = IMA_AFTER[at]
    return out.T


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """pcm at another rate, by linear interpolation in whole numbers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    low, part = at // to, at % to
    wide = pcm.astype(np.int64)
    return ((wide[low] * (to - part) + wide[np.minimum(low + 1, len(pcm) - 1)] * part) // to).astype(np.int16)


def wav(codes: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit codes (mu-law or A-law) or of IMA ADPCM blocks of UNIT bytes; codes have even length."""
    if codec == IMA_ADPCM:
        per = (UNIT - 4) * 2 + 1
        form = struct.pack("<HHIIHHHH", codec, 1, rate, rate * UNIT // per, UNIT, 4, 2, per)
        samples = len(codes) // UNIT * per
    else:
        form, samples = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), len(codes)
    head = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(codes))
    return b"RIFF" + struct.pack("<I", len(head) + len(codes)) + head + codes


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Codec, rate and data of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(codes: bytes, codec: int) -> np.ndarray:
    if codec == IMA_ADPCM:
        return decode_ima(np.frombuffer(codes, np.uint8).reshape(-1, UNIT)).ravel()
    return TABLES[codec][np.frombuffer(codes, np.uint8)]


def stored_audio(docs: DataFrame, codec: int = MULAW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, padded to UNIT, as the codes of a WAV file.

    A null text is empty and makes one unit of padding. One row per input row; extra columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for data in (x.as_py() for x in batch.column(1)):
                sizes.append(len(data))
                media.append(wav(data + PAD * (-len(data) % UNIT if data else UNIT), codec))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    schema = T.StructType([T.StructField("doc_id", rows.schema[0].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return rows.mapInArrow(store, schema)


def _loudness(pcm: np.ndarray, starts: np.ndarray) -> Iterator[str]:
    """Mean square, peak and sign changes of each recording; starts: where each begins in pcm."""
    wide = pcm.astype(np.int64)
    ends = np.append(starts[1:], len(pcm))
    power = np.add.reduceat(wide * wide, starts) // (ends - starts)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    turn = np.diff(np.signbit(pcm), prepend=np.signbit(pcm[:1])).astype(np.int64)
    turn[starts] = 0
    return (f"{a}/{b}/{c}" for a, b, c in zip(power, peak, np.add.reduceat(turn, starts), strict=True))


def expanded(media: DataFrame, rate: int = PCM_RATE, with_pcm: bool = True) -> DataFrame:
    """media's rows (doc_id, n_bytes, media) with what their WAV files hold, read back:

    payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256; feature: mean
    square / peak / sign changes of the payload expanded as mu-law, A-law and IMA ADPCM, then the length and
    CRC-32 of the PCM; pcm: the file's own codec, resampled to rate, as little-endian 16-bit samples (if
    with_pcm). A null file gives nulls. Memory: some ten times BATCH_BYTES or the longest file.
    """
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm", pa.binary())]
    fields = fields if with_pcm else fields[:-1]

    def expand(files: list[bytes]) -> Iterator[dict]:
        parts = [read_wav(x) for x in files]
        lengths = np.array([len(x[2]) for x in parts])
        starts = np.append(0, np.cumsum(lengths)[:-1])
        joined = np.frombuffer(b"".join(x[2] for x in parts), np.uint8)
        kinds = [_loudness(TABLES[MULAW][joined], starts), _loudness(TABLES[ALAW][joined], starts)]
        if not (lengths % UNIT).any():
            per = (UNIT - 4) * 2 + 1
            kinds.append(_loudness(decode_ima(joined.reshape(-1, UNIT)).ravel(), starts // UNIT * per))
        for file, (codec, was, codes), *loud in zip(files, parts, *kinds, strict=True):
            pcm = resampled(decode(codes, codec), was, rate).astype("<i2").tobytes()
            yield {
                "payload_bytes": len(codes), "payload_sha256": hashlib.sha256(codes).hexdigest(), "tail_crc32": zlib.crc32(codes[-16:]),
                "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(),
                "feature": " ".join([*loud, f"{len(pcm) // 2}/{zlib.crc32(pcm):08x}"]),
            } | ({"pcm": pcm} if with_pcm else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[dict] = []
            group: list[bytes] = []
            sizes = 0
            for x in [*batch.column(2), None]:
                file = x.as_py() if x is not None else None
                if group and (file is None or sizes + len(file) > BATCH_BYTES):
                    done += expand(group)
                    group, sizes = [], 0
                if file is not None:
                    group.append(file)
                    sizes += len(file)
                elif x is not None:
                    done.append({})
            columns = [pa.array([r.get(name) for r in done], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", *[f[0] for f in fields]])

    spark_type = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([*media.schema.fields[:2], *[T.StructField(name, spark_type[kind]) for name, kind in fields]])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)
