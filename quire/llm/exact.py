"""Exact dedup with a cuckoo-filter index over digests.

The index has ``n`` buckets; a digest belongs to the bucket of its hash. A bucket holds a cuckoo
filter of 16-bit tags in cells of four slots, and beside each slot its stored content: a live digest (SHA-256 of the
normalised text, 32 bytes) with its first row and its count. A lookup compares tags in the digest's two
cells and reads the content of slots with an equal tag only; the stored digest verifies the hit, so a tag that two
digests share makes no false match. There is no other way to the content. A delete clears slot and content. When an
insert finds no room after ``KICKS`` moves, the filter is built anew at twice the size from the stored digests.

Copies are merged before anything is shuffled: each partition runs its rows through an index of
its own and sends one row per digest. A group of copies, however large, therefore reaches its
bucket as one row per partition. The number of buckets follows the number of digests, so a
bucket stays near ``PER_BUCKET`` digests at every size.

An ``Index`` that is to be updated also has a table of its members, one row per digest and id with the number of
rows. Rows are taken away by digest and id; what is left of the touched digests, summed up from the members,
then changes, empties or fills their slots.

Cases: null text counts as empty; empty texts are equal to each other; a null doc_id is larger
than any other; a repeated row counts again, and of rows that share text and doc_id the first in the order of the scan stays;
a delete of a row that isn't there does nothing; empty input gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch
from quire.llm.text import free, one_space

KICKS, SLOTS, PER_BUCKET = 200, 4, 200_000
#: Digests that one map-side index holds before it is sent on and begun anew.
LOCAL_ROWS = 200_000
NO_ID = 2**63 - 1


class CuckooIndex:
    """Digest -> [smallest id, its row, count], in the slots of a cuckoo filter of 16-bit tags."""

    def __init__(self, cells: int = 1 << 10):
        self.live = 0
        self._clear(cells)

    def _clear(self, cells: int) -> None:
        self.mask = cells - 1
        self.tags = [0] * (cells * SLOTS)  # 0: free
        self.content: list[tuple[bytes, list[int]] | None] = [None] * (cells * SLOTS)

    def _place(self, digest: bytes) -> tuple[int, int]:
        """Tag (never 0) and first cell, from bytes of the digest that choose no index bucket."""
        return int.from_bytes(digest[8:10], "big") or 1, int.from_bytes(digest[10:18], "big") & self.mask

    def _other(self, tag: int, at: int) -> int:
        return at ^ (tag * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes) -> int | None:
        tag, a = self._place(digest)
        for at in (a, self._other(tag, a)):
            lo = at * SLOTS
            if tag in self.tags[lo : lo + SLOTS]:
                for i in range(lo, lo + SLOTS):
                    if self.tags[i] == tag and self.content[i][0] == digest:
                        return i
        return None

    def _put(self, tag: int, entry: tuple, at: int) -> bool:
        for i in range(at * SLOTS, at * SLOTS + SLOTS):
            if not self.tags[i]:
                self.tags[i], self.content[i] = tag, entry
                return True
        return False

    def _add(self, entry: tuple) -> tuple | None:
        """Stores an entry; what is left over if there is no room."""
        tag, a = self._place(entry[0])
        at = self._other(tag, a)
        if self._put(tag, entry, a) or self._put(tag, entry, at):
            return None
        for kick in range(KICKS):
            i = at * SLOTS + kick % SLOTS
            tag, self.tags[i] = self.tags[i], tag
            entry, self.content[i] = self.content[i], entry
            at = self._other(tag, at)
            if self._put(tag, entry, at):
                return None
        return entry

    def _grow(self, left: tuple) -> None:
        """Twice the cells, filled from the stored digests and the one left over; again if that overflows too."""
        entries, cells = [*filter(None, self.content), left], (self.mask + 1) * 2
        while True:
            self._clear(cells)
            if all(self._add(e) is None for e in entries):
                return
            cells *= 2

    def find(self, digest: bytes) -> list[int] | None:
        """[smallest id, its row, count] of a live digest."""
        return None if (i := self._slot(digest)) is None else self.content[i][1]

    def insert(self, digest: bytes, key: int, row: int = 0, count: int = 1) -> None:
        """``count`` more rows of a digest, the first of them ``key`` and ``row``."""
        if (seen := self.find(digest)) is not None:
            if (key, row) < (seen[0], seen[1]):
                seen[0], seen[1] = key, row
            seen[2] += count
            return
        self.live += 1
        if (left := self._add((digest, [key, row, count]))) is not None:
            self._grow(left)

    def delete(self, digest: bytes) -> bool:
        """Takes a live digest out; False if it isn't live."""
        if (i := self._slot(digest)) is None:
            return False
        self.tags[i], self.content[i] = 0, None
        self.live -= 1
        return True

    def rows(self) -> pd.DataFrame:
        found = [e for e in self.content if e is not None]
        out = {"digest": [d for d, _ in found]}
        return pd.DataFrame(out | {n: np.array([v[i] for _, v in found], "int64") for i, n in enumerate(("keep_id", "keep_rid", "n"))})


ENTRY = "digest binary, keep_id long, keep_rid long, n long"


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for pdf in batches:
        for digest, key, row in zip(pdf["digest"], pdf["id"], pdf["rid"]):
            index.insert(bytes(digest), key, row)
        if index.live >= LOCAL_ROWS:
            yield index.rows()
            index = CuckooIndex()
    yield index.rows()


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One index bucket: what is stored (change 0) goes in, then changes (1) replace, empty (n = 0) or fill slots."""
    index = CuckooIndex(1 << max(4, (len(pdf) // 3).bit_length()))
    order = np.argsort(pdf["change"].to_numpy(), kind="stable")
    rows = [pdf[n].to_numpy()[order] for n in ("digest", "keep_id", "keep_rid", "n", "change")]
    for digest, key, row, n, change in zip(*rows):
        if change:
            index.delete(bytes(digest))
        if n:
            index.insert(bytes(digest), key, row, n)
    return index.rows()


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest): SHA-256 of the normalised text's UTF-8 bytes."""
    return docs.select(F.col(key), F.unhex(F.sha2(one_space(F.col(text)), 256)).alias("digest"))


def _merged(entries: DataFrame) -> DataFrame:
    buckets = max(1, -(-entries.count() // PER_BUCKET)) * 12
    b = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    return entries.groupBy(b.alias("bucket")).applyInPandas(_bucket, ENTRY)


def live(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per live digest of (digest, id, rid): digest, keep_id, keep_rid, n."""
    local = scratch.table(rows.select("digest", "id", "rid").mapInPandas(_local, ENTRY), "local")
    out = scratch.table(_merged(local.withColumn("change", F.lit(0))), "index")
    scratch.drop(local)
    return out


@dataclass
class Index:
    """live: digest, keep_id, n of every live digest; members: digest, id, n of every text and id."""

    live: DataFrame
    members: DataFrame


def _numbered(digested: DataFrame, key: str) -> DataFrame:
    return digested.select("digest", F.coalesce(F.col(key), F.lit(NO_ID)).cast("long").alias("id"))


def build(digested: DataFrame, scratch: Scratch, key: str = "doc_id") -> Index:
    """The index of all rows of (key, digest)."""
    rows = scratch.table(_numbered(digested, key), "rows")
    found = live(rows.withColumn("rid", F.lit(0).cast("long")), scratch).drop("keep_rid")
    members = scratch.table(rows.groupBy("digest", "id").agg(F.count("*").alias("n")), "members")
    scratch.drop(rows)
    return Index(found, members)


def update(index: Index, inserted: DataFrame | None, deleted: DataFrame | None, scratch: Scratch, key: str = "doc_id") -> Index:
    """An index with further rows of (key, digest) inserted and others deleted, row by row."""
    changes = [_numbered(df, key).withColumn("n", F.lit(n).cast("long")) for df, n in ((inserted, 1), (deleted, -1)) if df is not None]
    if not changes:
        return index
    delta = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    delta = scratch.table(delta.groupBy("digest", "id").agg(F.sum("n").alias("n")), "delta")
    members = index.members.unionByName(delta).groupBy("digest", "id").agg(F.sum("n").alias("n")).where("n > 0")
    members = scratch.table(members, "members")
    touched = scratch.table(delta.select(F.col("digest").alias("__d")).distinct(), "touched")
    left = members.join(touched, F.col("digest") == F.col("__d"), "left_semi").groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("n").alias("n"))
    left = touched.join(left, F.col("digest") == F.col("__d"), "left").select(F.col("__d").alias("digest"), F.coalesce("keep_id", F.lit(0)).alias("keep_id"), F.coalesce("n", F.lit(0)).alias("n"))
    entries = index.live.withColumn("change", F.lit(0)).unionByName(left.withColumn("change", F.lit(1))).withColumn("keep_rid", F.lit(0).cast("long"))
    found = scratch.table(_merged(scratch.table(entries, "entries")).drop("keep_rid"), "index")
    return Index(found, members)


def _digested(docs: DataFrame, rid: Column, text: str, key: str, scratch: Scratch) -> DataFrame:
    """(rid, id, digest) of every row."""
    return scratch.table(docs.select(rid.alias("rid"), F.coalesce(F.col(key), F.lit(NO_ID)).cast("long").alias("id"), F.unhex(F.sha2(one_space(F.col(text)), 256)).alias("digest")), "digests")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256. One row of each group is kept."""
    scratch = Scratch(docs.sparkSession, "exact")
    d = _digested(docs, F.monotonically_increasing_id(), text, key, scratch)
    found = live(d, scratch).withColumnRenamed("digest", "__digest")
    j = d.join(found, F.col("digest") == F.col("__digest"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(docs.schema[key].dataType)
    return j.select(real("id").alias(key), real("keep_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without later copies."""
    scratch, rid = Scratch(docs.sparkSession, "exact"), free(docs, "__rid")
    whole = scratch.table(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    d = _digested(whole, F.col(rid), text, key, scratch)
    stay = scratch.table(live(d, scratch).select(F.col("keep_rid").alias(rid)), "stay")
    scratch.drop(d)
    return whole.join(stay, rid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
