"""Substring dedup by hashing units of text.

Units are lines, and the sentences of lines that have several, so a passage is also met within a
line, and a line may equal a sentence elsewhere. A unit is normalised (white space collapsed, trimmed, lower case) and hashed.
Of equal units of ``MIN_WORDS`` words or more, the earliest in the order of (doc_id, hash of the text, row, offset)
stays; the others are removed, a line together with its sentences. Offsets count characters of the original text.

Digests are counted by partial aggregation and only repeated ones go on, so a passage that a
third of all documents share reaches its group as one row per task; joining occurrences to their
first is a plain equi-join that AQE may split.

Cases: null and empty texts have no units; shorter units stay; of repeated rows all but the first
lose their units; null ids come last; a document's units are made one at a time, so a document must fit a task; ``dedup`` drops a document that loses every word; empty
input gives no rows; other columns are carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch
from quire.llm.text import free

MIN_WORDS = 8
SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
EDGE = " \t\r\v\f"
UNIT = "rid long, id string, hash long, kind int, line int, start int, stop int, words int, d1 long, d2 long"
#: Units that a worker gathers before it hands them on.
HANDED_ON = 50_000


def units(text: str) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(kind, line, start, stop, words): kind 0 a line, 1 a sentence of a line that has several. Offsets are those of the unit without outer white space."""
    at = 0
    for n, line in enumerate(text.split("\n")):
        yield 0, n, *_trimmed(line, at)
        parts = SENTENCE.findall(line)
        if sum(p.strip(EDGE) != "" for p in parts) > 1:
            here = at
            for p in parts:
                yield 1, n, *_trimmed(p, here)
                here += len(p)
        at += len(line) + 1


def _trimmed(part: str, at: int) -> tuple[int, int, list[str]]:
    core = part.strip(EDGE)
    start = at + part.find(core) if core else at
    return start, start + len(core), re.split(r"[ \t\r\v\f]+", core.lower()) if core else []


def hashed(docs: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """The units of (__rid, key, text) with the two halves of a 128-bit BLAKE2b of the normalised text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in UNIT.split(", ")][:-2]
        for pdf in it:
            rows, digests = [], []
            for rid, key_, hash_, t in zip(pdf["rid"], pdf["id"], pdf["hash"], pdf["t"]):
                for kind, line, start, stop, words in units(t):
                    if len(words) >= min_words:
                        rows.append((rid, key_, hash_, kind, line, start, stop, len(words)))
                        digests.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
                if len(rows) >= HANDED_ON:
                    yield _frame(rows, digests, names)
                    rows, digests = [], []
            yield _frame(rows, digests, names)

    # ids go as strings: pandas has no whole numbers beside nulls
    rows = docs.select(F.col("__rid").alias("rid"), F.col(key).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInPandas(run, UNIT).withColumn("id", F.col("id").cast(docs.schema[key].dataType))


def _frame(rows: list, digests: list[bytes], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return out.assign(d1=halves[:, 0], d2=halves[:, 1])


def removed(units_: DataFrame, scratch: Scratch) -> DataFrame:
    """The occurrences that go, with those that stay: (rid, id, kind, start, stop, words, keep_id, keep_rid, keep_start)."""
    often = units_.groupBy(F.col("d1").alias("__a"), F.col("d2").alias("__b")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    u = units_.join(often, (F.col("d1") == F.col("__a")) & (F.col("d2") == F.col("__b"))).drop("__a", "__b")
    u = scratch.table(u, "repeated")
    who = F.struct(F.col("id").isNull().alias("no"), "id", "hash", "rid", "start")
    first = u.groupBy(F.col("d1").alias("__a"), F.col("d2").alias("__b")).agg(F.min(who).alias("first"))
    # written, so that the join reads both sides from an exchange and AQE can split a passage that very many share
    first = scratch.table(first, "first")
    j = u.join(first, (F.col("d1") == F.col("__a")) & (F.col("d2") == F.col("__b")))
    j = j.where((F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start")))
    # a line that goes takes its sentences along
    j = j.withColumn("__whole", F.min("kind").over(Window.partitionBy("rid", "line"))).where((F.col("kind") == 0) | (F.col("__whole") == 1))
    return j.select("rid", "id", "kind", "start", "stop", "words", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), F.col("first.start").alias("keep_start"))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: key, kind, start_char, end_char, words, keep_doc_id, keep_start."""
    scratch = Scratch(docs.sparkSession, "units")
    d = docs.select(F.col(key), text).withColumn("__rid", F.monotonically_increasing_id())
    u = scratch.table(hashed(d, text, key, min_words), "units")
    r = removed(u, scratch)
    return r.select(
        F.col("id").alias(key), F.when(F.col("kind") == 0, "line").otherwise("sentence").alias("kind"),
        F.col("start").alias("start_char"), F.col("stop").alias("end_char"), "words", F.col("keep_id").alias("keep_doc_id"), "keep_start",
    )


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the removed units cut out; a document that loses every word is dropped."""
    scratch = Scratch(docs.sparkSession, "units")
    rid, own, spans_, new = (free(docs, x) for x in ("__rid", "__r", "__spans", "__new"))
    whole = scratch.table(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    narrow = whole.select(F.col(rid).alias("__rid"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    r = removed(scratch.table(hashed(narrow, "__text", "__key", min_words), "units"), scratch)
    spans = r.groupBy(F.col("rid").alias(own)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans_))
    j = whole.join(spans, F.col(rid) == F.col(own), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if s is None or not len(s):
                out.append(t)
                continue
            keep, at = [], 0
            for x in s:
                keep.append(t[at : max(at, x["start"])])
                at = max(at, x["stop"])
            out.append("".join([*keep, t[at:]]))
        return pd.Series(out, dtype=object)

    j = j.withColumn(new, cut(F.col(text), F.col(spans_)))
    j = j.where(F.col(spans_).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    return j.select(*(F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
