"""SimHash near-dedup with bit-sliced comparison.

A fingerprint is the 64-bit majority over the XXH64 values of a text's 3-word shingles. Two
fingerprints link at ``RADIUS`` or fewer differing bits. Equal fingerprints are one vertex from the
start. Of five blocks of bits, a linked pair agrees in at least two, so each vertex enters ten
tables, one for each pair of blocks, keyed by those bits. Within a table's bucket the fingerprints
are stored vertically: plane b holds bit b of 64 of them in each word. One XOR compares a plane with its
neighbours or with a query bit; two carry-save counter planes and a sticky overflow plane count
differing bits of 64 pairs at once, and a block of words is abandoned once all of its pairs
exceed the radius. A bucket reports a spanning forest of its links, never its pairs.

A bucket of more than ``CELL`` vertices is dealt into cells, and each pair of cells is a task's
unit of work, so no bucket is capped and none is gathered whole.

Cases: null counts as empty; texts without words have fingerprint zero and link like any other;
texts of one or two words are one shingle; a component_id is the smallest doc_id reachable, null
ids aside; repeated rows share their component; empty input gives no rows; other columns are not
read by ``classes`` and are carried by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.scratch import Scratch
from quire.llm.text import free

SEED, WORDS, RADIUS = 42, 3, 3
#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CELL = 4096
#: Buckets up to this size are compared by shifting planes, larger ones by query bits.
SHIFTED = 64
#: Sorted rows that are compared at once, and hashes whose bits are counted at once.
CHUNK, COUNTED = 1 << 16, 1 << 15
#: 64-bit words of a fingerprint that is to tell a similarity of 0.8, and anchors of a text.
WIDE, TABLES = 4, 8
#: Shingle sets, and shingles in them, of a cell of suspects; bits of the map of suspects.
SETS, SHINGLES, SLOTS = 1024, 1 << 21, 1 << 23


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the bits of all shingles' XXH64. bytes.lower and bytes.split know ASCII only, as wanted."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), COUNTED):
        ones += np.unpackbits(h[i : i + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _signed(v: np.ndarray) -> np.ndarray:
    return v.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(key, fp): the fingerprint's bits as a signed long."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(bytes(t), words) for t in pdf["__t"]], np.uint64)
            yield pd.DataFrame({"__k": pdf["__k"], "fp": _signed(fp)})

    # keys go as strings: pandas has no whole numbers beside nulls
    rows = docs.select(F.col(key).cast("string").alias("__k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__t"))
    return rows.mapInPandas(scored, "__k string, fp long").select(F.col("__k").cast(docs.schema[key].dataType).alias(key), "fp")


def planes(fp: np.ndarray) -> np.ndarray:
    """(64 * k, words) of (n, k) or (n,) fingerprints: bit b of fingerprint i is bit i % 64 of word i // 64 of plane b. The rest is zero."""
    fp = fp.reshape(len(fp), -1)
    n = -(-len(fp) // 64) * 64
    bits = np.zeros((n, 64 * fp.shape[1]), np.uint8)
    bits[: len(fp)] = _bits(fp)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def _pack(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _within(diff, live: np.ndarray, n_planes: int, radius: int) -> np.ndarray:
    """Which pairs differ in at most ``radius`` planes. diff(b, at): plane b's differences at the blocks ``at``; live: the pairs that count.

    A carry-save counter has one bit plane for each binary digit of the radius. It begins so far up
    that one difference more than the radius carries out of its last plane, and that sticks in ``over``.
    Every eight planes, blocks without a pair that is still within are abandoned.
    """
    near = np.zeros_like(live)
    at = np.flatnonzero(live.any(axis=0) if live.ndim == 2 else live)
    alive = live[..., at]
    digits = max(1, radius.bit_length())
    head = (1 << digits) - 1 - radius
    count = [np.full_like(alive, ~np.uint64(0) if head >> i & 1 else 0) for i in range(digits)]
    over = ~alive
    for b in range(n_planes):
        carry = diff(b, at)
        for i in range(digits):
            up = count[i] & carry
            count[i] ^= carry
            carry = up
        over |= carry
        if b % 8 == 7:
            stay = over != ~np.uint64(0)
            stay = stay.any(axis=0) if stay.ndim == 2 else stay
            if not stay.all():
                at, over, count = at[stay], over[..., stay], [c[..., stay] for c in count]
            if not len(at):
                return near
    near[..., at] = ~over
    return near


def _lanes(near: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=-1, bitorder="little", count=n)


def shifted_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows with equal keys; rows are sorted by key. Lane i meets lane i + d at every distance d."""
    p, n, found = planes(fp), len(fp), []
    wide = np.concatenate([p, np.zeros((len(p), 2), np.uint64)], axis=1)
    for d in range(1, n):
        same = key[:-d] == key[d:]
        if not same.any():
            break
        live = np.zeros(p.shape[1], np.uint64)
        packed = _pack(same)
        live[: len(packed)] = packed
        q, r = divmod(d, 64)

        def diff(b, at, q=q, r=np.uint64(r)):
            w = wide[b]
            ahead = w[np.minimum(at + q, len(w) - 1)]
            if r:
                ahead = (ahead >> r) | (w[np.minimum(at + q + 1, len(w) - 1)] << np.uint64(64 - int(r)))
            return p[b][at] ^ ahead

        i = np.flatnonzero(_lanes(_within(diff, live, len(p), radius), n))
        found.append((i, i + d))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of pairs: larger roots hang under smaller ones until every pair has one root."""
    while len(a):
        while True:  # shorten paths to the roots
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def query_links(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int = RADIUS, queries: int = 64) -> np.ndarray:
    """Parent of each row in a forest of the links between the rows ``left`` and ``right`` of one bucket."""
    parent, lanes = np.arange(len(fp)), planes(fp[right])
    ok = _pack(np.ones(len(right), bool))
    for i in range(0, len(left), queries):
        q = left[i : i + queries]
        bit = np.where(_bits(fp[q]), ~np.uint64(0), np.uint64(0))
        near = _within(lambda b, at: lanes[b][at] ^ bit[:, b, None], np.repeat(ok[None], len(q), axis=0), len(lanes), radius)
        r, lane = np.nonzero(_lanes(near, len(right)))
        _join(parent, q[r], right[lane])
    return parent


def _edges(key: np.ndarray, cell: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links of whole buckets. key: sorted; cell: 0, or -1 and 1 for the two sides of a pair of cells."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat((sizes > 1) & (sizes <= SHIFTED), sizes) & (cell == 0)
    if small.any():
        k, f = key[small], fp[small]
        parent = np.arange(len(f))
        _join(parent, *shifted_links(k, f, radius))
        yield f, f[_roots(parent)]
    for s, n in zip(starts, sizes):
        if n > 1 and not small[s]:
            f, c = fp[s : s + n], cell[s : s + n]
            left, right = (np.flatnonzero(c < 0), np.flatnonzero(c > 0)) if (c != 0).any() else (np.arange(n), np.arange(n))
            if len(left) and len(right):
                yield f, f[_roots(query_links(f, left, right, radius))]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _compare(batches: Iterator[pd.DataFrame], words: int, radius: int) -> Iterator[pd.DataFrame]:
    """Edges of a partition that is sorted by key. A key's rows may come in several batches; they are at most two cells."""
    held, names = None, [f"f{i}" for i in range(words)]

    def done(pdf):
        key, cell = pdf["key"].to_numpy(), pdf["side"].to_numpy()
        fp = np.ascontiguousarray(pdf[names].to_numpy().astype(np.int64)).view(np.uint64)
        for a, b in _edges(key, cell, fp, radius):
            if (d := (a != b).any(axis=1)).any():
                yield pd.DataFrame(np.concatenate([_signed(a[d]), _signed(b[d])], axis=1), columns=_ends(words))

    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(held) >= CHUNK:
            last = held["key"].to_numpy() == held["key"].iloc[-1]
            yield from done(held[~last])
            held = held[last].reset_index(drop=True)
    if held is not None:
        yield from done(held)


def _ends(words: int) -> list[str]:
    return [f"{side}{i}" for side in "ab" for i in range(words)]


def table_keys(fp: Column) -> Column:
    """The keys of a fingerprint in the ten tables: table number, then the bits of its two blocks."""
    part = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in BLOCKS]
    keys = [F.lit(t << 26).cast("long") + F.shiftleft(part[i], 13) + part[j] for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return F.array(*keys)


def links(fps: DataFrame, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """(a, b): a forest of the links between distinct fingerprints fp, of each bucket of each table."""
    rows = fps.select(F.col("fp").alias("f0"), F.explode(table_keys(F.col("fp"))).alias("bucket"))
    return _bucket_links(rows, 1, RADIUS, scratch, cell).toDF("a", "b")


def _bucket_links(rows: DataFrame, words: int, radius: int, scratch: Scratch, cell: int) -> DataFrame:
    """(a0.., b0..) from (bucket, f0..): a forest of the links of each bucket."""
    names = [f"f{i}" for i in range(words)]
    # usually none; Spark broadcasts it only where its written size is small
    large = rows.groupBy(F.col("bucket").alias("__b")).agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = scratch.table(large.select("__b", F.ceil(F.col("n") / cell).cast("int").alias("cells")), "large")
    r = rows.join(large, F.col("bucket") == F.col("__b"), "left")
    own = F.pmod(F.xxhash64(*names), F.col("cells")).cast("int")
    spread = r.where("cells is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(i == j, 0).otherwise(F.when(F.col("own") == i, -1).otherwise(1))
    spread = spread.select(F.xxhash64("bucket", i, j).alias("key"), side.cast("int").alias("side"), *names)
    plain = r.where("cells is null").select(F.col("bucket").alias("key"), F.lit(0).alias("side"), *names)
    both = plain.unionByName(spread)
    out = ", ".join(f"{x} long" for x in _ends(words))
    return both.repartition("key").sortWithinPartitions("key").mapInPandas(lambda it: _compare(it, words, radius), out)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    d = scratch.table(fingerprints(docs, text, key, words), "fingerprints")
    return _classes(d, scratch, key).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(d: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(.., fp) with component_id."""
    each = scratch.table(d.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    found = components(links(each, scratch), scratch)
    m = scratch.table(each.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("__fp"), "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = m.groupBy(F.col("root").alias("__root")).agg(F.min("first").alias("component_id"))
    m = m.join(least, F.col("root") == F.col("__root")).select("__fp", "component_id")
    return d.join(m, F.col("fp") == F.col("__fp")).drop("__fp")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def sketch(h: np.ndarray, rng: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(wide fingerprint of WIDE words, TABLES anchors) of a shingle set.

    Each further word of the fingerprint is the majority over another mix of the same shingle hashes.
    An anchor joins the least values of two mixes: texts of similarity s share it with chance s * s.
    """
    if not len(h):
        return np.zeros(WIDE, np.uint64), np.zeros(1, np.uint64)
    factor, shift = rng
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), COUNTED // WIDE):
        part = h[i : i + COUNTED // WIDE, None] * factor[None, :WIDE] + shift[None, :WIDE]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        ones += _bits(part).sum(axis=0, dtype=np.int64)
    fp = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)
    least = np.array([(h * f + s).min() for f, s in zip(factor[WIDE:], shift[WIDE:])])
    pairs = least.reshape(TABLES, 2)
    return fp, (pairs[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ pairs[:, 1] ^ np.arange(TABLES, dtype=np.uint64)


def sketches(docs: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(key, f0.., anchors, shingles, digest): the digest is that of the shingle set, shingles its size."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = np.random.default_rng(SEED)
        rng = gen.integers(0, 2**63, WIDE + 2 * TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), gen.integers(0, 2**63, WIDE + 2 * TABLES, dtype=np.uint64)
        for pdf in batches:
            got = []
            for t in pdf["__t"]:
                h = shingle_set(bytes(t), words)
                got.append((*sketch(h, rng), len(h), blake2b(h.tobytes(), digest_size=16).hexdigest()))
            fp = _signed(np.array([g[0] for g in got], np.uint64).reshape(-1, WIDE))
            yield pd.DataFrame({"__k": pdf["__k"], **{f"f{i}": fp[:, i] for i in range(WIDE)}, "anchors": [_signed(g[1]) for g in got], "shingles": [g[2] for g in got], "digest": [g[3] for g in got]})

    rows = docs.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__t"))
    out = "__k long, " + ", ".join(f"f{i} long" for i in range(WIDE)) + ", anchors array<long>, shingles long, digest string"
    return rows.mapInPandas(scored, out).withColumnRenamed("__k", key)


def radius_of(similarity: float) -> int:
    """Bits of a wide fingerprint in which texts of this Jaccard similarity differ, and four standard deviations more.

    Small sets differ in more bits than the arc cosine says, at 0.8 in 3 of 16 (four shingles of five).
    """
    p = max(float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 3 / 16)
    bits = 64 * WIDE
    return int(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def _verified(pdf: pd.DataFrame, similarity: float, radius: int) -> pd.DataFrame:
    """(a, b) digests: a spanning forest of the pairs of one cell, or of two cells' sides, whose sets have this Jaccard similarity."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    size, side, group, out = pdf["shingles"].to_numpy(), pdf["side"].to_numpy(), np.arange(len(pdf)), []
    fp = np.ascontiguousarray(pdf[[f"f{i}" for i in range(WIDE)]].to_numpy().astype(np.int64)).view(np.uint64)
    for q in np.flatnonzero(side <= 0):
        r = np.flatnonzero(side > 0) if side[q] else np.arange(q + 1, len(pdf))
        r = r[(group[r] != group[q]) & (np.minimum(size[r], size[q]) / np.maximum(size[r], size[q]) >= similarity)]
        r = r[np.bitwise_count(fp[r] ^ fp[q]).sum(axis=1) <= radius]
        while len(r):
            both = len(np.intersect1d(sets[q], sets[r[0]], assume_unique=True))
            if both / (size[q] + size[r[0]] - both) >= similarity:
                out.append((q, r[0]))
                group[group == group[r[0]]] = group[q]
            r = r[1:][group[r[1:]] != group[q]]
    name = pdf["digest"].to_numpy()
    return pd.DataFrame({"a": [name[i] for i, _ in out], "b": [name[j] for _, j in out]}, dtype=object)


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose __rid is one of ids, and few others: a bitmap of fixed size is broadcast, so no text is shuffled."""
    slot = F.pmod(F.xxhash64("__rid"), F.lit(SLOTS)) + 1
    bits = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    near = rows.withColumn("__s", slot).join(F.broadcast(bits), F.bitmap_bucket_number("__s") == F.col("__n")).withColumn("__p", F.bitmap_bit_position("__s"))
    bit = "getbit(cast(conv(hex(substring(__bits, cast(__p div 8 as int) + 1, 1)), 16, 10) as int), cast(__p % 8 as int))"
    return near.where(f"{bit} = 1").select(*(F.col(f"`{c}`") for c in rows.columns))


def verified_links(suspects: DataFrame, texts: DataFrame, text: str, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): a forest of the links between shingle sets of this Jaccard similarity, of each group of suspects.

    suspects: (root, digest, __rid, shingles, f0..), one row for each distinct set; texts: (__rid, text). A group is
    dealt into cells like a bucket, and each pair of cells compares all of its sets that no link joins yet.
    """
    n = suspects.groupBy(F.col("root").alias("__root")).agg(F.count("*").alias("n"), F.sum("shingles").alias("total")).where("n > 1")
    cells = F.ceil(F.greatest(F.col("n") / SETS, F.col("total") / SHINGLES)).cast("int").alias("cells")
    s = suspects.join(n.select("__root", cells), F.col("root") == F.col("__root")).drop("__root")
    s = scratch.table(s, "suspects")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"__r": pdf["__rid"], "hashes": [shingle_set(bytes(t), words).tobytes() for t in pdf["__t"]]})

    rows = texts.select("__rid", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__t"))
    sets = _of(rows, s.select("__rid")).mapInPandas(hashed, "__r long, hashes binary")
    r = s.join(sets.hint("merge"), F.col("__rid") == F.col("__r")).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("cells")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    r = r.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    side = F.when(F.col("i") == F.col("j"), 0).otherwise(F.when(F.col("own") == F.col("i"), -1).otherwise(1))
    r = r.select("root", "i", "j", side.alias("side"), "digest", "shingles", *(f"f{i}" for i in range(WIDE)), "hashes")
    radius = radius_of(similarity)
    return r.groupBy("root", "i", "j").applyInPandas(lambda pdf: _verified(pdf, similarity, radius), "a string, b string")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest key, and of its repeated rows the first.

    Three differing bits of 64 are a similarity near 0.99, so at 0.8 the fingerprint has ``WIDE`` words,
    and buckets are made by anchors, which similar texts share and others don't, instead of
    blocks of bits. Comparison within buckets is the same bit-sliced one, at ``radius_of``. Its links make groups
    of suspects; near copies are those that links of exact Jaccard similarity between their shingle sets join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    names = [f"f{i}" for i in range(WIDE)]
    rid = free(docs, "__rid")
    whole = scratch.table(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    ids = whole.select(F.col(rid).alias("__r"), F.col(key).alias("__id"))
    texts = whole.select(F.col(rid).alias("__rid"), F.col(text).alias("text"))
    ranked = F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__rid").alias("rid"))
    d = sketches(texts, "text", "__rid", words).join(ids, F.col("__rid") == F.col("__r"))
    d = scratch.table(d.select(ranked.alias("who"), *names, "anchors", "shingles", "digest"), "sketches")
    # equal fingerprints are one vertex before any bucket is made
    rows = d.select(F.explode("anchors").alias("bucket"), *names).distinct()
    edges = _bucket_links(rows, WIDE, radius_of(similarity), scratch, CELL)
    name = lambda side: F.concat_ws("", *(F.lpad(F.hex(f"{side}{i}"), 16, "0") for i in range(WIDE)))
    found = components(edges.select(name("a").alias("a"), name("b").alias("b")), scratch)
    # equal shingle sets are one vertex of the exact links
    each = scratch.table(d.groupBy("digest", "shingles", *names).agg(F.min("who").alias("who")), "sets")
    group = each.join(found, name("f") == F.col("node"), "left").select(F.coalesce("root", name("f")).alias("root"), "digest", F.col("who.rid").alias("__rid"), "shingles", *names)
    links_ = verified_links(group, texts, "text", words, similarity, scratch)
    same = components(links_, scratch).toDF("__node", "__set")
    stay = each.join(same, F.col("digest") == F.col("__node"), "left").groupBy(F.coalesce("__set", "digest").alias("root")).agg(F.min("who").alias("who"))
    stay = scratch.table(stay.select(F.col("who.rid").alias(rid)), "stay")
    return whole.join(stay.hint("shuffle_hash"), rid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
