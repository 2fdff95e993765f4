"""WARC archives: writing captures, reading them back and assembling transactions.

A capture is three records: a request, a response (or a revisit of an earlier response with the
same payload) and a metadata record. Request and metadata name the capture's record in
``WARC-Concurrent-To``. Archives are written by Spark's text writer, whose line separator is the
blank line pair that ends a record, so they go to any store that Spark can write to, in gzip (one member a file, as
that writer makes them; any number of members is read). A file holds as many records as come to ``FILE_BYTES``
at their mean size. It is unpacked as it is parsed, by ``Content-Length``, never by searching payloads, and records are
handed on whenever they come to ``HANDED_ON`` bytes, so a task holds the packed file and few records.
Reading joins the three kinds through the concurrent-to identifiers and emits one nested row per
capture; a revisit gets its payload's length from the response it refers to.

Cases: null html is an empty payload; empty payloads are equal to each other (with the default
``least`` of 0); of rows with the same payload and id, one is the response; null ids sort last and
null urls are written as an empty target; repeated rows are captures of their own; a capture without request or
metadata has null there, and of several that name it the one with the smallest id counts; empty input
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

#: Bytes of an archive before packing, those that a capture's three records take beside the payload, and bytes of records handed on at once.
FILE_BYTES, OWN_BYTES, HANDED_ON = 32 << 20, 1800, 4 << 20
END, CRLF = "\r\n\r\n", "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: 160 bits as four groups of 40 bits, eight digits each."""
    digest = F.sha1(data)
    groups = (F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4))
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(kind: str, rid: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.lit(kind), rid.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, body: Column, *fields: tuple[str, Column | str]) -> Column:
    """A record without its closing blank lines. A null value leaves its field out."""
    named = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in (("WARC-Type", kind), *fields)]
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *named, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(head, F.lit(END), body)


def write(pages: DataFrame, where: str, scratch: Scratch, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes request, response or revisit, and metadata records of every row to archives under ``where``."""
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = scratch.table(rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")}), "rows")
    # a group of equal payloads is summed up before it is shuffled
    first = rows.groupBy(F.col("digest").alias("__d")).agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid")).alias("first"), F.count("*").alias("copies"))
    # written, so that Spark knows its size and broadcasts it only where that is small
    first = scratch.table(first.where("copies > 1").select("__d", F.col("first.rid").alias("first_rid")), "first")
    r = rows.join(first, (F.col("digest") == F.col("__d")) & (F.col("bytes") >= least), "left")
    revisit = F.coalesce(F.col("first_rid") != F.col("rid"), F.lit(False))
    rid, target = F.col("rid"), F.regexp_replace("url", r"[\r\n]", "")
    main, digest = _uuid("response", rid), F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    common = [("WARC-Target-URI", target), ("WARC-Date", DATE)]
    response = _record("response", F.concat(head, F.col("html")), ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"))
    again = _record("revisit", head, ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", _uuid("response", F.col("first_rid"))), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response"))
    request = _record("request", F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")), ("WARC-Record-ID", _uuid("request", rid)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request"))
    about = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.lit("via: crawl"))
    metadata = _record("metadata", about, ("WARC-Record-ID", _uuid("metadata", rid)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields"))
    records = r.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    size = rows.agg(F.avg("bytes")).first()[0] or 0.0
    per_file = 3 * max(1, int(FILE_BYTES / (size + OWN_BYTES)))
    records.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(where)
    scratch.drop(rows, first)


RECORD = "type string, id string, concurrent_to string, refers_to string, target string, date string, digest string, bytes long, payload binary"
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, packed or not; lengths decide where blocks end. A cut-off record raises."""
    plain = io.BytesIO(data)
    f = io.BufferedReader(gzip.GzipFile(fileobj=plain)) if data[:2] == b"\x1f\x8b" else plain
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record but {line[:40]!r}")
        lines = []
        while (line := f.readline()) not in (b"\r\n", b""):
            lines.append(line)
        head = {k.decode().strip().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(b"".join(lines))}
        size = int(head["content-length"])
        block = f.read(size)
        if len(block) < size or not line:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        yield head, block
        f.read(4)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _records(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    names = ["type", "id", "concurrent_to", "refers_to", "target", "date", "digest", "bytes", "payload"]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"bytes": "Int64"})
    out, held = [], 0
    for files in batches:
        for data in files["content"]:
            for head, block in parsed(bytes(data)):
                kind, digest, size, payload = head["warc-type"], None, None, None
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, size = _digest(payload), len(payload)
                    if head["warc-payload-digest"] != f"sha1:{digest}":
                        raise ValueError(f"payload of {head['warc-record-id']} is not what was written")
                elif kind == "revisit":
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                keep = payload if payloads and kind == "response" else None if kind in ("response", "revisit") else block
                out.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head["warc-date"], digest, size, keep))
                held += len(keep or b"") + 200
                if held >= HANDED_ON:
                    yield frame(out)
                    out, held = [], 0
    yield frame(out)


def records(spark: SparkSession, where: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives; response digests are computed from the payload and checked against the header."""
    files = spark.read.format("binaryFile").load(where).select("content")
    return files.mapInPandas(lambda it: _records(it, payloads), RECORD)


def transactions(recs: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, metadata; the capture of a revisit has the bytes of its response."""
    body = F.struct("id", "target", "date", F.col("payload").cast("string").alias("block"))
    side = lambda kind: recs.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("__c")).agg(F.min(body).alias(kind))
    main = recs.where(F.col("type").isin("response", "revisit"))
    origin = recs.where(F.col("type") == "response").groupBy(F.col("id").alias("__o")).agg(F.min("bytes").alias("__bytes"))
    main = main.join(origin, main["refers_to"] == origin["__o"], "left").withColumn("bytes", F.coalesce("bytes", "__bytes"))
    out = main.select(F.col("id").alias("__id"), F.struct("type", "id", "refers_to", "target", "date", "digest", "bytes", "payload").alias("capture"))
    for kind in ("request", "metadata"):
        s = side(kind)
        out = out.join(s, out["__id"] == s["__c"], "left").drop("__c")
    return out.drop("__id")


def page_id(block: Column) -> Column:
    """The id that a metadata block names; null if it names none."""
    return F.nullif(F.regexp_extract(block, r"(?m)^page-id: (-?\d+)\r?$", 1), F.lit("")).cast("long")


def captures(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html", payloads: bool = False) -> DataFrame:
    """Writes pages to archives, reads them back: one nested row per capture."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(pages, where := scratch.path("archive"), scratch, least, key, url, html)
    recs = scratch.table(records(pages.sparkSession, where, payloads), "records")
    return transactions(recs)


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page."""
    t = captures(pages, least).select("capture", page_id(F.col("metadata.block")).alias("page_id"))
    scratch = Scratch(pages.sparkSession, "warc")
    t = scratch.table(t.select("page_id", "capture.*"), "captures")
    origin = t.where(F.col("type") == "response").select(F.col("id").alias("__o"), F.col("page_id").alias("__page"))
    j = t.join(origin, t["refers_to"] == origin["__o"], "left")
    return j.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("__page").alias("refers_to"))
