"""Media columns: telephony audio in WAV containers.

A payload of bytes is kept as the codes of one of three telephone codecs: G.711 mu-law and A-law,
one sample a byte, and IMA ADPCM, two samples a byte in blocks of 576 code bytes behind a header
of four, which holds the block's first sample and step index. Codes are stored as they are, so the payload comes back bit for bit. Decoding expands
the two laws by tables of 256 entries made from their rules, and runs ADPCM one step at a time over
the blocks of a whole batch with numpy, each from the state in its header. Decoded sound is resampled from 8 to 16 kHz by linear
interpolation in integers and stored as 16-bit PCM by ``store_pcm``.

Cases: null and empty payloads are padded to one block of bytes 255; a file that isn't one of the
three formats, has more than one channel, or is cut off, raises; files are decoded ``BATCH_BYTES`` or one file at a time, a file
in some 16 bytes of memory for each of its own; repeated rows give repeated rows; empty input gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

UNIT, PAD, RATE = 576, b"\xff", 8000
CODECS = ("mulaw", "alaw", "adpcm")
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
HEADER = 4
#: Bytes of payload that are decoded at once, and samples whose squares are summed at once.
BATCH_BYTES, SUMMED = 4 << 20, 1 << 16

# Step sizes and index moves of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
    279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026,
    4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    """G.711 mu-law: the code's complement is sign, exponent, mantissa; bias 132."""
    c = ~np.arange(256, dtype=np.uint8)
    size = ((((c & 15).astype(np.int32) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    """G.711 A-law: even bits are inverted; segments of 16 steps, the first two linear."""
    c = np.arange(256, dtype=np.uint8) ^ 0x55
    part, seg = (c & 15).astype(np.int32) << 4, (c >> 4) & 7
    size = np.where(seg == 0, part + 8, (part + 264) << np.maximum(seg.astype(np.int32) - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


LAWS = {"mulaw": _mulaw(), "alaw": _alaw()}


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return payload + PAD * (-len(payload) % UNIT or UNIT * (not payload))


def codec_of(payload: bytes) -> str:
    """Equal payloads get equal codecs: by the number of units."""
    return CODECS[len(payload) // UNIT % len(CODECS)]


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file whose samples are the payload's codes. ADPCM blocks begin at zero with the smallest step."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, HEADER + UNIT), np.uint8)
        blocks[:, HEADER:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, per = blocks.tobytes(), HEADER + UNIT, 4, 2 * UNIT + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * align // per, align, bits, 2, per)
        samples = len(blocks) * per
    else:
        data, samples = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = b"WAVE" + chunk(b"fmt ", fmt) + chunk(b"fact", struct.pack("<I", samples)) + chunk(b"data", data)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Sound:
    """Codes of a file; of ADPCM (blocks, bytes) with each block's first sample and step index. samples: how many count."""

    codec: str
    rate: int
    codes: np.ndarray
    value: np.ndarray | None = None
    index: np.ndarray | None = None
    samples: int | None = None

    @property
    def payload(self) -> bytes:
        return self.codes.tobytes()


def unwav(media: bytes) -> Sound:
    """What a stored file holds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or len(media) < 8 + struct.unpack_from("<I", media, 4)[0]:
        raise ValueError("not a whole WAV file")
    at, fmt, samples = 12, b"", None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut off")
        body = memoryview(media)[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = bytes(body)
        elif name == b"fact":
            samples = struct.unpack_from("<I", body)[0]
        elif name == b"data":
            if len(fmt) < 14:
                raise ValueError("no format chunk before the data")
            tag, channels, rate, _, align = struct.unpack_from("<HHIIH", fmt)
            codec = next((c for c, t in TAGS.items() if t == tag), None)
            if codec is None or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels is none of {CODECS} with one")
            codes = np.frombuffer(body, np.uint8)
            if codec != "adpcm":
                return Sound(codec, rate, codes, samples=samples)
            if align <= HEADER or size % align:
                raise ValueError("a block is cut off")
            blocks = codes.reshape(-1, align)
            value, index = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32), blocks[:, 2].astype(np.int32)
            if (index >= len(STEPS)).any():
                raise ValueError("a step index is out of range")
            return Sound(codec, rate, blocks[:, HEADER:], value, index, samples)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(codes: np.ndarray, value: np.ndarray, index: np.ndarray) -> np.ndarray:
    """(blocks, bytes) of code bytes, low nibble first -> (blocks, 1 + 2 * bytes) samples, the first of them value: every step runs over all blocks."""
    n = len(codes)
    nibbles = np.empty((codes.shape[1] * 2, n), np.uint8)
    nibbles[0::2], nibbles[1::2] = (codes & 15).T, (codes >> 4).T
    out = np.zeros((len(nibbles) + 1, n), np.int16)
    value, index = value.astype(np.int32), index.astype(np.int32)
    out[0] = value
    for i, c in enumerate(nibbles):
        step = STEPS[index]
        diff = (step >> 3) + np.where(c & 4, step, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 1, step >> 2, 0)
        value = np.clip(value + np.where(c & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + MOVES[c & 7], 0, len(STEPS) - 1)
        out[i + 1] = value
    return np.ascontiguousarray(out.T)


def decode_all(sounds: list[Sound]) -> list[np.ndarray]:
    """16-bit samples of each file; the ADPCM blocks of equal width of all of them are decoded together."""
    out = [LAWS[s.codec][s.codes] if s.codec in LAWS else None for s in sounds]
    for width in {s.codes.shape[1] for s in sounds if s.codec == "adpcm"}:
        which = [i for i, s in enumerate(sounds) if s.codec == "adpcm" and s.codes.shape[1] == width]
        pcm = decode_adpcm(*(np.concatenate([getattr(sounds[i], x) for i in which]) for x in ("codes", "value", "index")))
        at = 0
        for i in which:
            n = len(sounds[i].codes)
            out[i] = pcm[at : at + n].reshape(-1)
            at += n
    return [x if s.samples is None else x[: s.samples] for x, s in zip(out, sounds)]


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 to 16 kHz: every other sample is the mean of its neighbours, rounded down; the last is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def feature(codec: str, pcm: np.ndarray, up: np.ndarray) -> str:
    """Of the decoded sound: samples, peak, integer RMS, zero crossings; of the resampled: samples and CRC-32."""
    power = peak = 0
    for i in range(0, len(pcm), SUMMED):
        part = pcm[i : i + SUMMED].astype(np.int64)
        power, peak = power + int(part @ part), max(peak, int(np.abs(part).max()))
    rms = int(np.sqrt(power / len(pcm))) if len(pcm) else 0
    cross = int(np.count_nonzero((pcm[:-1] < 0) != (pcm[1:] < 0)))
    return f"codec={codec};samples={len(pcm)};peak={peak};rms={rms};crossings={cross};pcm16k={len(up)};pcm_crc32={zlib.crc32(up.tobytes())}"


def _split(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= BATCH_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each whole text's UTF-8 bytes as telephone audio."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raw = [bytes(b) for b in pdf["__b"]]
            for a, b in _split([len(x) for x in raw]):
                padded = [pad(x) for x in raw[a:b]]
                yield pd.DataFrame({"__k": pdf["__k"].iloc[a:b].to_numpy(), "n_bytes": [len(x) for x in raw[a:b]], "media": [wav(p, codec_of(p)) for p in padded]})

    # keys go as strings: pandas has no whole numbers beside nulls
    rows = docs.select(F.col(key).cast("string").alias("__k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__b"))
    out = rows.mapInPandas(run, "__k string, n_bytes long, media binary")
    return out.select(F.col("__k").cast(docs.schema[key].dataType).alias(key), "n_bytes", "media")


DECODED = "codec string, rate int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decoded(table: DataFrame, media: str = "media", key: str = "doc_id", pcm: bool = False) -> DataFrame:
    """key, n_bytes, what the stored bytes hold, and with ``pcm`` the resampled sound as 16-bit little-endian PCM."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            files = [bytes(m) for m in pdf["__m"]]
            for a, b in _split([len(x) for x in files]):
                got = [unwav(m) for m in files[a:b]]
                rows = []
                for m, g, s in zip(files[a:b], got, decode_all(got)):
                    p, up = g.payload, resample(s)
                    rows.append((g.codec, g.rate, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(g.codec, s, up), *([up.astype("<i2").tobytes()] if pcm else [])))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in DECODED.split(", ")] + ["pcm"] * pcm)
                out.insert(0, "n_bytes", pdf["n_bytes"].iloc[a:b].to_numpy())
                out.insert(0, "__k", pdf["__k"].iloc[a:b].to_numpy())
                yield out

    rows = table.select(F.col(key).cast("string").alias("__k"), "n_bytes", F.col(media).alias("__m"))
    out = rows.mapInPandas(run, f"__k string, n_bytes long, {DECODED}" + ", pcm binary" * pcm)
    return out.select(F.col("__k").cast(table.schema[key].dataType).alias(key), *out.columns[1:])


def store_pcm(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores every text as media, decodes it and writes it with its resampled PCM as Parquet below path; the table that was written.

    PCM at 16 kHz takes four bytes for each byte of payload under the two laws and eight under ADPCM.
    """
    scratch = Scratch(docs.sparkSession, "audio")
    table = scratch.table(stored(docs, text, key), "media")
    decoded(table, "media", key, pcm=True).write.parquet(path)
    scratch.drop(table)
    return docs.sparkSession.read.parquet(path)


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores every text as media, reads the stored table back and computes features."""
    scratch = Scratch(docs.sparkSession, "audio")
    table = scratch.table(stored(docs, text, key), "media")
    return decoded(table, "media", key).drop("codec", "rate")
