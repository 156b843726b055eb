"""Media columns: telephony audio in a binary column.

A payload of bytes is kept as a WAV file in one of three telephony codecs. Reading expands mu-law and A-law by lookup
tables, decodes IMA ADPCM with numpy one sample step at a time across all blocks of many files, resamples the PCM and
stores it in a column beside the file.

ADPCM blocks hold a 4-byte header (predictor 0, index 0) and 64 payload bytes, two 4-bit codes each, low nibble first.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import slices, table

CODECS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
NAMES = {v: k for k, v in CODECS.items()}
UNIT, HEADER, RATE, STORED_RATE = 64, 4, 8000, 16000
#: A file's payload is decoded in pieces of this many bytes, so memory doesn't follow a file's length.
PIECE = 1 << 20

STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767], np.int32)
SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, low + 0x108 << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index and code: the change of the predictor and the next index."""
    code, step = np.arange(16, dtype=np.int32)[None], STEPS[:, None]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + SHIFT[None], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


CHANGE, NEXT = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, HEADER + UNIT) bytes to (n, 1 + 2 * UNIT) samples: a loop over steps, vectors over blocks."""
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, HEADER:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = predictor
    for k, byte in enumerate(codes):
        for half, code in enumerate((byte & 15, byte >> 4)):
            cell = at + code
            predictor += CHANGE.take(cell)
            np.clip(predictor, -32768, 32767, out=predictor)
            at = NEXT.take(cell)
            out[1 + 2 * k + half] = predictor
    return np.ascontiguousarray(out.T)


def padded(payload: bytes) -> bytes:
    """The payload with zeros appended up to a positive multiple of UNIT."""
    return payload + bytes(UNIT - len(payload) % UNIT if len(payload) % UNIT or not payload else 0)


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file whose samples are the payload's bytes (ADPCM: its nibbles)."""
    tag, extra, align, bits, data = CODECS[codec], b"", 1, 8, payload
    if codec == "ima_adpcm":
        blocks = np.zeros((len(payload) // UNIT, HEADER + UNIT), np.uint8)
        blocks[:, HEADER:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        align, bits, data, extra = HEADER + UNIT, 4, blocks.tobytes(), struct.pack("<HH", 2, 1 + 2 * UNIT)
    form = struct.pack("<HHIIHH", tag, 1, RATE, RATE * align // (1 + 2 * UNIT) if bits == 4 else RATE, align, bits) + (extra or b"\0\0")
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Sound(NamedTuple):
    """A WAV file's codec, samples a second, channels, bytes of a block, and data chunk."""

    codec: str
    rate: int
    channels: int
    align: int
    data: memoryview


def sound(stored: bytes | None) -> Sound:
    """What a WAV file holds; raises ValueError for anything but a whole file in one of CODECS (ADPCM: mono)."""
    view = memoryview(stored or b"")
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if at + 8 + size > len(view):
            raise ValueError("cut off")
        if name == b"fmt " and size >= 14:
            form = struct.unpack_from("<HHIIH", view, at + 8)
        if name == b"data":
            if form is None or form[0] not in NAMES:
                raise ValueError("unknown codec")
            tag, channels, rate, _, align = form
            adpcm = NAMES[tag] == "ima_adpcm"
            if not rate or not channels or (adpcm and (channels > 1 or align <= HEADER)) or size % (align if adpcm else channels):
                raise ValueError("damaged header or data")
            return Sound(NAMES[tag], rate, channels, align if adpcm else channels, view[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(given: Sound) -> bytes:
    """The bytes that ``wav`` was given."""
    if given.codec != "ima_adpcm":
        return bytes(given.data)
    return np.frombuffer(given.data, np.uint8).reshape(-1, given.align)[:, HEADER:].tobytes()


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in integers: output k lies at k * source / target; the last sample holds."""
    if source == target or not len(pcm):
        return pcm
    if target == 2 * source:
        out, nearby = np.empty(2 * len(pcm), np.int16), pcm.astype(np.int32)
        out[::2] = pcm
        out[1:-1:2] = nearby[:-1] + nearby[1:] >> 1
        out[-1] = pcm[-1]
        return out
    k = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    left, part = k // target, k % target
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (target - part) + pcm[right].astype(np.int64) * part) // target).astype(np.int16)


def decoded(files: list[Sound]) -> list[np.ndarray]:
    """PCM of data chunks, one channel (the mean of several); ADPCM blocks of all files are decoded together."""
    out: list = [None] * len(files)
    together: dict[int, list[int]] = {}
    for i, f in enumerate(files):
        if f.codec == "ima_adpcm":
            together.setdefault(f.align, []).append(i)
            continue
        out[i] = TABLES[f.codec][np.frombuffer(f.data, np.uint8)]
        if f.channels > 1:
            out[i] = (out[i].reshape(-1, f.channels).astype(np.int32).sum(1) // f.channels).astype(np.int16)
    for align, which in together.items():
        pcm, at = decode_adpcm(np.concatenate([np.frombuffer(files[i].data, np.uint8).reshape(-1, align) for i in which])), 0
        for i in which:
            n = len(files[i].data) // align
            out[i] = pcm[at : at + n].reshape(-1)
            at += n
    return out


def pieces(given: Sound) -> Iterator[Sound]:
    """The sound in pieces of about PIECE bytes, which end with a block."""
    step = max(1, PIECE // given.align) * given.align
    for at in range(0, max(1, len(given.data)), step):
        yield given._replace(data=given.data[at : at + step])


def pcm_of(files: list[bytes | None], rate: int) -> list[bytes | None]:
    """16-bit little-endian PCM at ``rate`` of each file; None for what is no such file."""
    opened: list[Sound | None] = []
    for f in files:
        try:
            opened.append(sound(f))
        except (ValueError, struct.error):
            opened.append(None)
    small = [i for i, s in enumerate(opened) if s and len(s.data) <= PIECE]
    pcm = dict(zip(small, decoded([opened[i] for i in small]), strict=True))
    for i, s in enumerate(opened):
        if s and i not in pcm:
            pcm[i] = np.concatenate([decoded([p])[0] for p in pieces(s)])
    return [resample(pcm[i], s.rate, rate).astype("<i2").tobytes() if s else None for i, s in enumerate(opened)]


class Summary:
    """Count, energy, peak and sign changes of a signal that comes in pieces."""

    def __init__(self) -> None:
        self.n = self.energy = self.peak = self.turns = 0
        self.sign: bool | None = None

    def add(self, pcm: np.ndarray) -> None:
        if not len(pcm):
            return
        wide, signs = pcm.astype(np.int64), pcm < 0
        self.n += len(pcm)
        self.energy += int(np.dot(wide, wide))
        self.peak = max(self.peak, int(np.abs(wide).max()))
        self.turns += int(np.count_nonzero(signs[1:] != signs[:-1])) + (self.sign is not None and self.sign != signs[0])
        self.sign = bool(signs[-1])

    def text(self, codec: str, rate: int) -> str:
        return f"{codec};rate={rate};n={self.n};energy={self.energy // max(1, self.n)};peak={self.peak};turns={self.turns}"


def codec_of(payload: bytes) -> str:
    """The codec a payload is stored in, by its checksum, so that equal payloads get equal files."""
    return list(CODECS)[zlib.crc32(payload) % len(CODECS)]


def to_media(df: DataFrame, text_col: str = "text", media_col: str = "media", length_col: str = "n_bytes") -> DataFrame:
    """Add ``media_col``, the WAV file of the text's padded UTF-8, and ``length_col``, its unpadded length.

    Null text counts as empty and becomes one unit of zeros. The text column is dropped, others are kept; a column
    already named like an added one is replaced.
    """
    added = {media_col: pa.binary(), length_col: pa.int64()}
    kept = [c for c in df.columns if c not in added]
    out = df.select(*kept, F.lit(None).cast("binary").alias(media_col), F.lit(None).cast("bigint").alias(length_col)).drop(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                raw = [(x or "").encode() for x in part.column(text_col).to_pylist()]
                files = [wav(p, codec_of(p)) for p in map(padded, raw)]
                columns = [part.column(c) for c in kept if c != text_col]
                columns += [pa.array(files, pa.binary()), pa.array([len(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c for c in kept if c != text_col] + list(added))

    return df.select(*kept).mapInArrow(run, out.schema)


def to_pcm(df: DataFrame, media_col: str = "media", rate: int = STORED_RATE, pcm_col: str = "pcm") -> DataFrame:
    """Add ``pcm_col``: the file's samples at ``rate`` as 16-bit little-endian PCM; null where it is no such file."""
    kept = [c for c in df.columns if c != pcm_col]
    out = df.select(*kept, F.lit(None).cast("binary").alias(pcm_col))

    def run(batches):
        for batch in batches:
            for part in slices(batch, media_col, 1 << 20):
                pcm = pa.array(pcm_of(part.column(media_col).to_pylist(), rate), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pcm], names=[*kept, pcm_col])

    return df.select(*kept).mapInArrow(run, out.schema)


def described(stored: bytes | None, pcm: bytes | None, rate: int) -> tuple:
    """Of a stored file and its stored PCM, read back: payload length, hash, tail checksum, the file's length and hash,
    PCM's length and hash, features. Nulls where the file or its PCM is damaged or missing."""
    try:
        given = sound(stored)
    except (ValueError, struct.error):
        return (None, None, None, len(stored) if stored is not None else None, hashlib.sha256(stored).hexdigest() if stored is not None else None, None, None, None)
    payload, own, signal = payload_of(given), Summary(), np.frombuffer(pcm or b"", "<i2")
    for a in range(0, len(signal), PIECE):
        own.add(signal[a : a + PIECE])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(stored), sha(stored),
        None if pcm is None else len(pcm), None if pcm is None else sha(pcm), None if pcm is None else own.text(given.codec, rate),
    )


DESCRIBED = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, pcm_bytes bigint, pcm_sha256 string, feature string"


def describe(df: DataFrame, media_col: str = "media", pcm_col: str = "pcm", rate: int = STORED_RATE) -> DataFrame:
    """Replace the stored file and its PCM by payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    pcm_bytes, pcm_sha256 and feature (of the PCM). Columns of those names are replaced, others kept. A file that is
    damaged or null has null values but for its own length and hash."""
    names = [x.split()[0] for x in DESCRIBED.split(", ")]
    kept = [c for c in df.columns if c not in (media_col, pcm_col, *names)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [DESCRIBED])
    types = [pa.int64() if "bigint" in x else pa.string() for x in DESCRIBED.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, pcm_col):
                rows = [described(x.as_py(), y.as_py(), rate) for x, y in zip(part.column(media_col), part.column(pcm_col), strict=True)]
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + found, names=[*kept, *names])

    return df.select(*kept, media_col, pcm_col).mapInArrow(run, schema)


def op2_media(spark, sf_dir: str) -> DataFrame:
    media = to_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return describe(to_pcm(media)).select("doc_id", "n_bytes", *[x.split()[0] for x in DESCRIBED.split(", ")])
