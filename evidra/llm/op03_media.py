"""Telephony audio columns: mu-law, A-law and IMA ADPCM.

Bytes are stored as RIFF/WAVE files with 8-bit samples (mu-law, A-law: one byte a sample) or
ADPCM blocks of 36 bytes (a 4-byte header, then 64 four-bit steps). Reading back expands mu-law
and A-law by tables of 256 entries and decodes ADPCM with numpy across all blocks of a batch,
one step of every block at a time. The 8 kHz PCM is resampled to 16 kHz (every sample is kept,
a four-tap midpoint (-1, 9, 9, -1)/16 goes between) and is stored as 16-bit PCM in a chunk of
the same file, so a reader has both the payload without loss and samples to train on.

All work is map-only, over batches bounded in bytes; a document is read whole. A RIFF file holds
less than 4 GiB, which ADPCM reaches at a text of about 590 MB: such a text is stored as mu-law or A-law (the
codec is still taken from the checksum), which hold twice as much, more than a string column does.

Edge cases: null and empty text give 576 bytes of padding. Blocks whose header names a step
above 88 use 88. Texts that are equal have equal values, as the codec is taken from the payload's
checksum alone. Repeated rows and null ids are carried through; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, flat, slices

UNIT, RATE, BLOCK, BATCH = 576, 8000, 36, 2 << 20
CODECS = ("mulaw", "alaw", "adpcm")
#: Payload bytes from which ADPCM's samples would not fit a RIFF file.
ADPCM_MOST = 1 << 29
#: WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: Fixed values of IMA ADPCM: step sizes, and the change of the step index by code.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte: bits inverted, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    b = ~np.arange(256) & 255
    size = (((b & 15) * 2 + 33) << ((b >> 4) & 7)) - 33
    return (np.where(b & 128, -size, size) * 4).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte: even bits inverted, sign, 3 bits of exponent, 4 of mantissa."""
    b = np.arange(256) ^ 0x55
    exponent, size = (b >> 4) & 7, (b & 15) * 16 + 8
    size = np.where(exponent, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(b & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
_DELTA = np.array([[(s >> 3) + (s * (c & 1) >> 2) + (s * (c >> 1 & 1) >> 1) + s * (c >> 2 & 1) for c in range(8)] for s in map(int, STEPS)], np.int32)
_DELTA = np.concatenate([_DELTA, -_DELTA], axis=1).ravel()
_NEXT = np.array([[min(88, max(0, i + int(m))) for m in (*MOVES, *MOVES)] for i in range(89)], np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (n, 65) of n blocks of 36 bytes: all blocks take each step together."""
    n = len(blocks)
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (BLOCK - 4) + 1, n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(BLOCK - 4):
        for half, code in enumerate((codes[i] & 15, codes[i] >> 4)):
            at = (index << 4) + code
            value = np.clip(value + _DELTA[at], -32768, 32767)
            index = _NEXT[at]
            out[1 + 2 * i + half] = value
    return np.ascontiguousarray(out.T)


def decode(codec: str, payload: np.ndarray) -> np.ndarray:
    """16-bit PCM at 8 kHz of a payload (whole ADPCM blocks)."""
    if codec == "adpcm":
        return decode_adpcm(payload.reshape(-1, BLOCK)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[payload]


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the midpoint to the next; edges are held."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    between = (9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def store(codec: str, payload: bytes, pcm: np.ndarray) -> bytes:
    """A RIFF/WAVE file: format, coded samples (data), and 16-bit samples at 16 kHz (chunk pc16)."""
    adpcm = codec == "adpcm"
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * BLOCK // 65 if adpcm else RATE, BLOCK if adpcm else 1, 4 if adpcm else 8) + extra
    chunks = [(b"fmt ", fmt), (b"data", payload), (b"pc16", struct.pack("<I", 2 * RATE) + pcm.astype("<i2").tobytes())]
    body = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def load(media: bytes) -> tuple[str, bytes, np.ndarray]:
    """Codec, coded samples and 16 kHz samples of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, chunks = 12, {}
    while at < len(media):
        (n,) = struct.unpack_from("<I", media, at + 4)
        chunks[media[at : at + 4]] = (at + 8, n)
        at += 8 + n + n % 2
    tag = struct.unpack_from("<H", media, chunks[b"fmt "][0])[0]
    start, n = chunks[b"data"]
    samples, m = chunks[b"pc16"]
    return {t: c for c, t in TAGS.items()}[tag], media[start : start + n], np.frombuffer(media, "<i2", (m - 4) // 2, samples + 4)


def feature(codec: str, pcm: np.ndarray) -> str:
    """Integer features of 16 kHz samples, so that they are the same everywhere."""
    x = pcm.astype(np.int64)
    sign = pcm < 0
    mean_square = int(np.dot(x, x) // len(x))
    crossings = int(np.count_nonzero(sign[1:] != sign[:-1]))
    return f"{codec};rate={2 * RATE};samples={len(pcm)};peak={int(np.abs(x).max())};ms={mean_square};mean={int(x.sum()) // len(x)};crossings={crossings};crc={zlib.crc32(pcm.tobytes())}"


def stored(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """The stored file and the unpadded size of each row's bytes; a batch's blocks are decoded together."""
    sizes = np.diff(offsets)
    padded = np.maximum(-(-sizes // UNIT) * UNIT, UNIT)
    to = np.concatenate([[0], np.cumsum(padded)])
    every = np.full(to[-1], 255, np.uint8)
    rows = np.repeat(to[:-1] - offsets[:-1], sizes)
    every[np.arange(len(raw)) + rows] = raw
    payloads = [every[a:b].tobytes() for a, b in zip(to[:-1], to[1:], strict=True)]
    codecs = [CODECS[zlib.crc32(p) % (3 if len(p) < ADPCM_MOST else 2)] for p in payloads]
    is_adpcm = np.array([c == "adpcm" for c in codecs])
    blocks = every[np.repeat(is_adpcm, padded)]
    samples = decode("adpcm", blocks)
    done = 0
    for k, (codec, payload) in enumerate(zip(codecs, payloads, strict=True)):
        if codec == "adpcm":
            n = int(padded[k]) // BLOCK * 65
            pcm, done = samples[done : done + n], done + n
        else:
            pcm = decode(codec, np.frombuffer(payload, np.uint8))
        yield store(codec, payload, resample(pcm)), int(sizes[k])


def media_column(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, media (the stored file of the text's bytes): the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, BATCH):
            media = [m for m, _ in stored(*flat(part.column(text)))]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(media, pa.binary())], ["doc_id", "media"])

    return df.select(key, text).mapInArrow(run, f"doc_id {dict(df.dtypes)[key]}, media binary")


def media_digest(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each stored file and of what is read back from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, BATCH):
            rows: list[tuple] = []
            for media, size in stored(*flat(part.column(text))):
                codec, payload, pcm = load(media)
                rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(codec, pcm)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([part.column(key), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])

    return df.select(key, text).mapInArrow(run, f"doc_id {dict(df.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))
