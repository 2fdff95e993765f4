"""Exact and SimHash dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import exact, simhash
from quire.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, fp string, keep_id string, digest string"


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["é", "Ünter", " x"]
    rows = [None, "", " ", "one", "one two", "one  two", "one two", "a b c", "A B C", "a\tb\nc"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", "  "]).join(copy))
    rows.append(" ".join(rng.choice(words) for _ in range(40_000)))
    out = [(i, t, "en", "x", "y", "z") for i, t in enumerate(rows)]
    rng.shuffle(out)
    return out + [(None, "one two", "en", "x", "y", "z"), out[3], out[3]]


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(set(fps))
    parent = {f: f for f in ids}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in ids}


def test_simhash_against_brute_force(spark):
    rows = corpus()
    got = simhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fp(r[1]) for r in rows]
    root = brute_components(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps))
    assert sorted((str(g.doc_id), g.fingerprint, g.component_id) for g in got) == want
    assert len({w[2] for w in want}) < len(want) - 20


@pytest.mark.parametrize("cell", [3, 20, 4096])
def test_links_in_large_buckets(spark, cell):
    """A ball of near fingerprints shares buckets; every cell size finds the same components."""
    rng = random.Random(cell)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in simhash.links(df, Scratch(spark, "t"), cell).collect():
        parent[root(a % 2**64)] = root(b % 2**64)
    want = brute_components(fps)
    groups = lambda r: sorted(sorted(f for f in fps if r(f) == x) for x in {r(f) for f in fps})
    assert groups(root) == groups(want.get)


def test_kernels_agree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(15), base[:50] ^ np.uint64(1 << 40)]))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 3}
    key = np.zeros(len(fp), np.int64)
    a, b = simhash.shifted_links(key, fp)
    assert set(zip(a.tolist(), b.tolist())) == want
    key = np.sort(rng.integers(0, 40, len(fp)))
    a, b = simhash.shifted_links(key, fp)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if key[i] == key[j]}


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([" ".join(w)]) if w else frozenset())


def near_groups(texts, least=0.8, unsure=0.62):
    """(root of each text under Jaccard >= least, whether no two groups have a pair between unsure and least)."""
    sets, parent, unclear = [shingles(t) for t in texts], list(range(len(texts))), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            s = len(a & b) / len(a | b) if a | b else 1.0
            if s >= least:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
            elif s >= unsure:
                unclear.append((i, j))
    return [root(i) for i in range(len(texts))], all(root(i) == root(j) for i, j in unclear)


def near_corpus():
    """Groups of copies with a tenth of their shingles or fewer changed, among texts of their own."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, " ", "a b", "a  b", "a b c d e f", "A B C D E F"]
    for _ in range(50):
        base = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_simhash_dedup_at_similarity(spark):
    texts = near_corpus()
    root, clear = near_groups(texts)
    assert clear and len(set(root)) < len(texts) - 60
    rows = [(i, t, "en", "x", "y", "z") for i, t in enumerate(texts)] + [(None, texts[0], "en", "x", "y", "z"), (3, texts[3], "en", "x", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("__rid", F.lit(7)).withColumn("root", F.lit(8))
    kept = simhash.dedup(df)
    assert kept.columns == df.columns and {(r["__rid"], r.root) for r in kept.collect()} == {(7, 8)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_recall_at_the_threshold(spark):
    """Of pairs of similarity 0.8 to 0.85, nearly all are linked; of pairs below 0.5 none."""
    rng, texts, near = random.Random(6), [], []
    words = [f"w{i}" for i in range(2000)]
    for i in range(150):
        base = [rng.choice(words) for _ in range(300)]
        copy = list(base)
        for at in rng.sample(range(300), 6 if i % 2 else 40):
            copy[at] = rng.choice(words)
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        near.append(len(a & b) / len(a | b))
        texts += [" ".join(base), " ".join(copy)]
    kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = [(s, 2 * i + 1 not in kept) for i, s in enumerate(near)]
    close = [x for s, x in linked if s >= 0.8]
    assert len(close) > 50 and sum(close) >= 0.95 * len(close) and not any(x for s, x in linked if s < 0.5)


def test_pairs_below_the_threshold_stay(spark):
    """Texts of similarity 0.6 to 0.79, short and long, and their chains are kept; links of 0.8 go by the exact sets."""
    rng, texts = random.Random(8), []
    words = [f"w{i}" for i in range(3000)]
    for n in [8, 9, 10, 12, 14, 20, 24, 84] * 12:
        base = [rng.choice(words) for _ in range(n)]
        copy = list(base)
        for at in range(n - 1, 0, -1):  # the end differs until the pair is below 0.8
            copy[at] = rng.choice(words) + "x"
            a, b = shingles(" ".join(base)), shingles(" ".join(copy))
            if len(a & b) / len(a | b) < 0.8:
                break
        texts += [" ".join(base), " ".join(copy)]
    texts += [f"{' '.join(words[:20])} {x} {' '.join(words[20:40])}" for x in ("one", "two", "three")]  # pairs of 0.76
    texts += [" ".join(words[100:120]), " ".join(words[100:121]), " ".join(words[100:122]), " ".join(words[100:126])]  # a chain, the last at 18 of 22
    root, _ = near_groups(texts)
    assert len(set(root)) == len(texts) - 3
    kept = simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))


@pytest.mark.parametrize("cell", [2, 5, 1024])
def test_verified_links_in_cells(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", cell)
    texts = near_corpus()[:120]
    root, _ = near_groups(texts)
    kept = simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root))


@pytest.mark.parametrize("radius", [0, 3, 7, 50])
def test_wide_kernels(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (60, 4), dtype=np.uint64)
    flips = rng.random((240, 256)) < 0.1
    fp = np.concatenate([base, np.repeat(base, 4, axis=0) ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)])
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if d[i, j] <= radius}
    a, b = simhash.shifted_links(np.zeros(len(fp), np.int64), fp, radius)
    assert set(zip(a.tolist(), b.tolist())) == want
    parent = simhash._roots(simhash.query_links(fp, np.arange(len(fp)), np.arange(len(fp)), radius))
    root = list(range(len(fp)))
    for _ in range(len(fp)):
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    assert parent.tolist() == root


def test_exact_against_brute_force(spark):
    rows = corpus()
    got = exact.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    want, seen = [], set()
    for r, t in zip(rows, norm):
        ids = [x[0] for x, u in zip(rows, norm) if u == t]
        least = min((i for i in ids if i is not None), default=None)
        want.append((str(r[0]), least, len(ids), r[0] == least and t not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen |= {t} if r[0] == least else set()
    assert sorted((str(g.doc_id), g.keep_id, g.group_size, g.kept, g.text_sha256) for g in got) == sorted(want)
    assert sum(g.kept for g in got) == len(set(norm))


def test_exact_dedup_rows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__rid", F.lit(77))
    kept = exact.dedup(df).collect()
    norm = {re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", k.text or "") for k in kept) == sorted(norm)
    assert all(k["__rid"] == 77 for k in kept)


def test_cuckoo_insert_delete_grow():
    index = exact.CuckooIndex(4)
    d = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, x in enumerate(d):
        index.insert(x, i + 5, 1)
        index.insert(x, i, 2)
    assert all(index.find(x) == [i, 2, 2] for i, x in enumerate(d)) and index.mask > 700
    for x in d[::2]:
        assert index.delete(x) and not index.delete(x)
    assert all((index.find(x) is None) == (i % 2 == 0) for i, x in enumerate(d))
    assert sum(t > 0 for t in index.tags) == sum(c is not None for c in index.content) == index.live == 1500


def test_cuckoo_tags_that_collide():
    """Digests with one tag and one cell: the stored digest tells them apart; the filter without its tag finds nothing."""
    index = exact.CuckooIndex(16)
    d = [bytes([i]) + bytes(7) + b"\x01\x02" + bytes(8) + bytes(14) for i in range(6)]
    for i, x in enumerate(d[:5]):
        index.insert(x, i)
    assert [index.find(x) for x in d] == [[i, 0, 1] for i in range(5)] + [None]
    assert index.delete(d[2]) and index.find(d[2]) is None and index.find(d[3]) == [3, 0, 1]
    index.tags = [0] * len(index.tags)
    assert not any(map(index.find, d))


def test_update_against_brute_force(spark):
    """Rounds of inserts and deletes, of rows that are there and that aren't, against a multiset."""
    rng, scratch, held = random.Random(4), Scratch(spark, "t"), []
    df = lambda rows: exact.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    first = [(rng.randrange(40), rng.choice("abcdefgh")) for _ in range(80)] + [(None, "a"), (None, "z")]
    index, held = exact.build(df(first), scratch), list(first)

    def brute():
        by = {}
        for i, t in held:
            by.setdefault(hashlib.sha256(t.encode()).digest(), []).append(exact.NO_ID if i is None else i)
        return sorted((d, min(x), len(x)) for d, x in by.items())

    assert sorted((bytes(r.digest), r.keep_id, r.n) for r in index.live.collect()) == brute()
    for n in range(3):
        new = [(rng.randrange(40), rng.choice("abcdefghij")) for _ in range(10 * n)]
        old = rng.sample(held, len(held) // 2) + [(i, t) for i, t in held if t == "b"] + [(99, "q")]
        index = exact.update(index, df(new) if new else None, df(old), scratch)
        held += new
        for r in old:
            if r in held:
                held.remove(r)
        assert sorted((bytes(r.digest), r.keep_id, r.n) for r in index.live.collect()) == brute()
    assert exact.update(index, None, None, scratch) is index


def test_update_keeps_no_deleted_row(spark):
    scratch = Scratch(spark, "t")
    df = lambda rows: exact.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = exact.build(df([(1, "a"), (2, "a")]), scratch)
    index = exact.update(index, None, df([(1, "a")]), scratch)
    assert [(r.keep_id, r.n) for r in index.live.collect()] == [(2, 1)]
    empty = exact.update(exact.build(df([]), scratch), df([]), df([(1, "a")]), scratch)
    assert empty.live.collect() == empty.members.collect() == []


def test_scratch_folders(spark, tmp_path, monkeypatch):
    """A cluster without a shared folder raises, a session's checkpoint folder is honoured; tables of a released block go, others stay."""
    from types import SimpleNamespace as Fake

    from quire.llm import scratch

    fake = lambda given, master: Fake(conf=Fake(get=lambda *_: None), sparkContext=Fake(master=master, applicationId="x", _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: given))))
    none, some = Fake(isDefined=lambda: False), Fake(isDefined=lambda: True, get=lambda: "hdfs://a/b/")
    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(fake(none, "spark://host:7077"))
    assert scratch.shared_dir(fake(some, "spark://host:7077")) == "hdfs://a/b"
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"{tmp_path}/shared")
    outer = Scratch(spark, "outer").table(spark.range(3), "t")
    with scratch.released():
        Scratch(spark, "inner").table(spark.range(3), "t")
        assert len(list(tmp_path.glob("shared/*"))) == 2
    assert [p.name[:5] for p in tmp_path.glob("shared/*")] == ["outer"] and outer.count() == 3


@pytest.mark.parametrize("f", [exact.classes, exact.dedup, simhash.classes, simhash.dedup])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).collect() == []
