"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; a reader of the wire format takes its pieces with scores and types,
the trainer's model type and byte fallback, and the normaliser's flags. From these a Tokenizer is
built: the normaliser (NFKC rules that the file names, white-space removal, dummy prefix, U+2581 as
the metaspace marker), a split in front of markers where no piece reaches across one, the model
(Unigram with the file's scores, or BPE with merges ranked by the scores of what they make), and
a decoder that fuses byte pieces and undoes the marker. ``parity`` compares it with the
sentencepiece library.

Cases: null counts as empty; an empty text has no ids; ids of control pieces are never made from
text; repeated rows are encoded again; empty input gives no rows; other columns are not read by
``encode``. A marker character that a text has itself decodes to a space, as in the library. The
model's path is read on the driver; its bytes, a file of fixed size, go with the task.

Where no piece reaches from one word into the next, which ``apart`` checks in the vocabulary, words
are encoded once and their ids kept: the words of a batch that are not yet known go to the
library's threads together, and a text's ids are its words' ids in a row.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A model file larger than this is refused: it is sent with every task.
MODEL_BYTES = 64 << 20
#: Texts go to the tokenizer's threads in batches of about this many bytes.
BATCH_BYTES = 1 << 19
#: A worker keeps the ids of the words of a generation, which ends at this number, and of the one before it.
KNOWN_WORDS = 100_000
#: New words that go through the library as one text.
JOINED = 500
WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, everything else as its bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False
    unk: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                m.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                m.kind, m.byte_fallback, m.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
            elif number == 3:
                f = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.trim, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        m.unk = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        if m.kind not in (UNIGRAM, BPE) or m.suffix or not m.escape:
            raise ValueError("only unigram and BPE models with a marker before words are read")
        return m


def merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, in the order in which the library would merge: by the made piece's score."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    found = []
    for order, (piece, s, kind) in enumerate(model.pieces):
        if kind in (NORMAL, UNUSED):
            pairs = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
            found += [(-s, order, score_order, a, b) for score_order, (a, b) in enumerate(pairs)]
    return [(a, b) for *_, a, b in sorted(found)]


@lru_cache(maxsize=2)
def tokenizer(data: bytes):
    """The Tokenizer of a model file's bytes."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = Model.parse(data)
    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    if m.kind == UNIGRAM:
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        unk = m.pieces[m.unk][0]
        t = Tokenizer(models.Unigram([(p, s if p != unk else low - 10) for p, s, _ in m.pieces], m.unk, m.byte_fallback))
    else:
        t = Tokenizer(models.BPE(vocab, merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if apart(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    t.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, k in m.pieces if k == USER])
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if m.dummy_prefix else back)
    return t


def apart(m: Model) -> bool:
    """Whether no piece has a marker behind another character and none is cut out of the text before encoding."""
    return not any(k == USER or k in (NORMAL, UNUSED) and MARK in p.lstrip(MARK) for p, _, k in m.pieces)


class WordEncoder:
    """Ids of whole texts. With ``apart`` models, each word goes through the library once while it is kept."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.whole = Model.parse(data), tokenizer(data)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words = None
        if apart(self.model):
            self.words, self.single = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
            self.words.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
            self.find = re.compile(WORD).findall
            self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.plain = not self.model.charsmap and not self.model.trim
        back = [p.replace(MARK, " ").encode() if k != BYTE else bytes([int(p[3:-1], 16)]) for p, _, k in self.model.pieces]
        self.back = back.__getitem__

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.whole.normalizer.normalize_str(text)
        return (MARK * (self.model.dummy_prefix and text != "") + text).replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words is None:
            return [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.find(self.normal(t)) for t in texts]
        if len(self.young) > KNOWN_WORDS:
            self.young, self.old = {}, self.young
        missing = set().union(*parts).difference(self.young)
        seen = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in seen)
        self._learn(list(missing - seen))
        return [np.frombuffer(b"".join(map(self.young.__getitem__, p)), np.int32) for p in parts]

    def _learn(self, new: list[str]) -> None:
        """Ids of new words. Words with one marker, in front, go through many at a time: a piece that begins with a marker begins the next word."""
        plain, other = [], []
        for w in new:
            (plain if w.rfind(MARK) == 0 else other).append(w)
        if other:  # without a split: runs of markers and first words without one
            self.young.update(zip(other, (np.array(e.ids, np.int32).tobytes() for e in self.single.encode_batch_fast(other, add_special_tokens=False))))
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, e in zip(groups, self.words.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            cuts = (4 * np.r_[np.flatnonzero(self.begins[ids]), len(ids)]).tolist()
            if len(cuts) != len(group) + 1:
                raise ValueError("pieces don't follow words")
            data = ids.tobytes()
            self.young.update(zip(group, (data[i:j] for i, j in zip(cuts, cuts[1:]))))

    def decode(self, ids: np.ndarray) -> str:
        """What the library decodes, for ids that it made: the pieces' bytes without the dummy prefix."""
        data = b"".join(map(self.back, ids.tolist()))
        return (data[1:] if self.model.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def load(path: str = MODEL) -> bytes:
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def parity(texts: list[str], path: str = MODEL) -> list[tuple[str, list[int], list[int]]]:
    """The texts whose ids differ from the sentencepiece library's, with both."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    ours = [e.ids for e in tokenizer(load(path)).encode_batch(texts, add_special_tokens=False)]
    return [(t, a, b) for t, a, b in zip(texts, ours, theirs) if a != b]


def _batches(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= BATCH_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL, verify: bool = True) -> DataFrame:
    """(key, ids array<int>, n_tokens, n_bytes, n_byte_pieces, n_unknown, round_trip): every whole text.

    round_trip: decoding the ids gives the text again; null with ``verify`` off.
    """
    data = load(path)
    out = "__k string, ids array<int>, n_tokens int, n_bytes long, n_byte_pieces int, n_unknown int, round_trip boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        coder = WordEncoder(data)
        m = coder.model
        byte = np.array([k == BYTE for _, _, k in m.pieces])
        for batch in it:
            keys, texts = batch.column(0), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in _batches(sizes):  # a part of the batch at a time is Python objects
                part = texts.slice(a, b - a).to_pylist()
                ids = coder.encode(part)
                flat, stops = np.concatenate(ids), np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = {
                    "__k": keys.slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(stops), pa.array(flat, pa.int32())),
                    "n_tokens": pa.array([len(i) for i in ids], pa.int32()), "n_bytes": pa.array(sizes[a:b], pa.int64()),
                    "n_byte_pieces": pa.array([int(byte[i].sum()) for i in ids], pa.int32()), "n_unknown": pa.array([int((i == m.unk).sum()) for i in ids], pa.int32()),
                    "round_trip": pa.array([coder.decode(i) == x if verify else None for i, x in zip(ids, part)], pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    # keys go as strings, as elsewhere in this subpackage
    rows = docs.select(F.col(key).cast("string").alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    got = rows.mapInArrow(run, out)
    return got.select(F.col("__k").cast(docs.schema[key].dataType).alias(key), *got.columns[1:])


def decode(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """(key, text) from ids; null ids give an empty text."""
    data = load(path)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(data)
        for pdf in it:
            yield pd.DataFrame({"__k": pdf["__k"], "text": t.decode_batch([list(map(int, i)) for i in pdf["__i"]], skip_special_tokens=False)})

    rows = encoded.select(F.col(key).cast("string").alias("__k"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("__i"))
    return rows.mapInPandas(run, "__k string, text string").select(F.col("__k").cast(encoded.schema[key].dataType).alias(key), "text")
