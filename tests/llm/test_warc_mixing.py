"""WARC round trips and mixing to target weights."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing, warc
from quire.llm.scratch import Scratch

PAGES = "page_id long, url string, html string, type string, digest string"


def pages():
    rng = random.Random(5)
    rows = [(i, f"http://h/{i % 7}", rng.choice(["<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\nb", "x" * 100_000, f"<b>{i}</b>\r\n"]), "t", "d") for i in range(200)]
    rng.shuffle(rows)
    return rows + [(None, None, "<p>é</p>", "t", "d"), (None, "u\r\nv: w", "only", None, None)]


@pytest.mark.parametrize("least", [0, 1, 50])
def test_warc_report(spark, least):
    rows = pages()
    got = warc.report(spark.createDataFrame(rows, PAGES), least).collect()
    want = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == b and r[0] is not None]
        again = len(b) >= least and bool(ids) and i != min(ids)
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(min(ids)) if again else "None"))
    assert sorted((str(g.page_id), g.payload_bytes, g.payload_digest, g.record_type, str(g.refers_to)) for g in got) == sorted(want)


def test_warc_nested_rows(spark):
    rows = pages() + [pages()[0]]
    got = warc.captures(spark.createDataFrame(rows, PAGES), payloads=True).collect()
    assert len(got) == len(rows) and all(g.request.block.startswith("GET ") and "page-id" in g.metadata.block or g.metadata.block == "via: crawl" for g in got)
    kept = [bytes(g.capture.payload) for g in got if g.capture.type == "response"]
    assert sorted(kept) == sorted({(r[2] or "").encode() for r in rows})


def test_archives_from_elsewhere():
    """Plain, packed as one member, and with a member for each record; cut-off ones raise."""
    records = [b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in (b"", b"abc", b"WARC/1.1\r\n\r\nx", b"y" * 100_000)]
    want = [(len(x), x) for x in (b"", b"abc", b"WARC/1.1\r\n\r\nx", b"y" * 100_000)]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [(int(h["content-length"]), b) for h, b in warc.parsed(data)] == want
    for bad in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"".join(records)[:-60]):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.parsed(bad))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parsed(b"HTTP/1.1 200 OK\r\n"))


def test_transactions_without_all_parts(spark):
    """A capture without request or metadata, one with two of them, and parts of no capture."""
    rows = [
        ("response", "r1", None, None, "t", "d", "D", 3, b"abc"), ("response", "r2", None, None, "t", "d", "D", 3, b"abc"), ("revisit", "v1", None, "r1", "t", "d", "D", None, None),
        ("revisit", "v2", None, "gone", "t", "d", "D", None, None), ("request", "q2", "r1", None, "t", "d", None, None, b"2"), ("request", "q1", "r1", None, "t", "d", None, None, b"1"),
        ("metadata", "m1", "r1", None, "t", "d", None, None, b"m"), ("metadata", "m2", "nobody", None, "t", "d", None, None, b"m"), ("request", "q3", None, None, "t", "d", None, None, b"3"),
    ]
    got = {r.capture.id: r for r in warc.transactions(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert len(got) == 4 and got["r1"].request.id == "q1" and got["r1"].metadata.block == "m"
    assert got["r2"].request is None and got["r2"].metadata is None
    assert (got["v1"].capture.bytes, got["v2"].capture.bytes) == (3, None)


def test_several_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "HANDED_ON", 3_000)
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    got = warc.report(df).collect()
    warc.write(df, f"{tmp_path}/a", Scratch(spark, "t"))
    assert len(list(tmp_path.glob("a/*.gz"))) > 3 and len(got) == len(rows)


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        t = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if t[s] >= most * sizes[s]]
        if not over:
            return full | t
        full |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", " a ", "\t"]) if i % 50 == 0 else " ".join("w" * rng.randint(1, 300)), rng.choice(["hot"] * 6 + ["b", "c", "d", None, "é"]), 7, "x") for i in range(3000)]
    rows.append((9999, "w " * 30_000, "b", 7, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target string")
    got = mixing.report(df).collect()
    assert sorted(got) == sorted(mixing.report(df.repartition(7)).collect())
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    by = {}
    for i, _, s, *_ in rows:
        by[s] = by.get(s, 0) + size[i]
    want, src, taken = fill(by), {r[0]: r[2] for r in rows}, {}
    for g in got:
        s = src[g.doc_id]
        assert (g.size, g.source_size) == (size[g.doc_id], by[s]) and g.target == pytest.approx(want[s])
        assert g.taken in (0, g.size, 2 * g.size)
        taken[s] = taken.get(s, 0) + g.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(size[i] for i in size if src[i] == s)
    own = mixing.mix(df.withColumn("__size", F.lit(88)).withColumn("__n", F.lit(5)))
    assert {(r["__size"], r["__n"]) for r in own.collect()} == {(88, 5)}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(count.get(g.doc_id, 0) * g.size == g.taken for g in got)


@pytest.mark.parametrize("rows", [[], [(1, "", "a")], [(1, None, None), (2, "x", None)], [(1, "a b", "s")] * 5])
def test_mixing_small(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(df).collect()
    assert len(got) == len(rows) and all(0 <= g.taken <= 2 * g.size for g in got)
    assert mixing.mix(df).columns == df.columns
