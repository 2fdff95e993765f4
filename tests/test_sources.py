"""Layout files, the document index, model interfaces and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from quire.plans import models
from quire.plans.catalog import CATALOG
from quire.sources import index, layout
from quire.sources.corpus import Corpus
from quire.streaming.ingest import Batch, follow

SF = "/root/testdata/sf0.001"


def test_layout_round_trip(spark, tmp_path):
    words = Corpus(spark, SF).words.where("doc_id < 5")
    layout.write_layout(words, f"{tmp_path}/layout")
    cols = ["doc_id", "page", "block_id", "word_index", "text", "x0", "y1"]
    back = layout.read_layout(spark, f"{tmp_path}/layout").select(cols)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, words.select(cols).collect()))


def test_bad_documents_become_error_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one two")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parse(data):
        if data == b"bad":
            raise ValueError("empty")
        return [{"page": 0, "block_id": 0, "word_index": i, "text": w, "line": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0} for i, w in enumerate(data.decode().split())]

    got = layout.read_documents(spark, str(tmp_path), parse).collect()
    assert sorted((r.path[-5:], r.text, r.error) for r in got if r.text) == [("a.pdf", "one", None), ("a.pdf", "two", None)]
    assert [r.error for r in got if r.error] == ["ValueError: empty"]


def test_missing_parser_says_so():
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="parser"):
            layout._pymupdf()


def test_index(spark):
    a = spark.createDataFrame([(1, "x.pdf", ["c"]), (2, "Y.pdf", None)], "id int, file_name string, comments array<string>")
    b = spark.createDataFrame([(2, "new", ["q"]), (3, "z", ["r"]), (3, "z", ["r"])], "id int, file_name string, comments array<string>")
    assert sorted(r.id for r in index.insert_absent(a, b, "id").collect()) == [1, 2, 3]
    assert [r.id for r in index.delete(a, b, "id").collect()] == [1]
    more = spark.createDataFrame([(1, "d"), (2, "e")], "id int, comments string")
    assert {r.id: r.comments for r in index.append(a, more, "id", "comments").collect()} == {1: ["c", "d"], 2: ["e"]}
    assert {r.id: r.file_name for r in index.replace(a, b, "id", "file_name").collect()} == {1: "x.pdf", 2: "new"}
    assert [r.id for r in index.listed(a, "y", ["id"]).collect()] == [2]


def test_models(spark):
    chunks = spark.createDataFrame([(1, 0, "nothing"), (1, 1, "aim one."), (1, 2, "aim two."), (2, 0, None)], "doc_id long, chunk int, piece string")
    got = models.purposes(chunks, lambda: lambda texts: [f'- "{t}"' if "aim" in t else "" for t in texts]).collect()
    assert [tuple(r) for r in got] == [(1, "aim one")]
    texts = spark.createDataFrame([(1, "intro Summary: done"), (2, "x" * 20_000)], "doc_id long, text string")
    reply = lambda ts: [json.dumps({"score": 100}) if t.startswith("Summary") else f"hm {json.dumps({'score': 50})} {len(t)}" for t in ts]
    assert {r.doc_id: r.score for r in models.goal_scores(texts, lambda: reply).collect()} == {1: 100, 2: 50}
    figures = spark.createDataFrame([(1, "2", "img")], "doc_id long, figure string, image string")
    said = '{"is_actual_chart_with_axes": true, "has_axis_units": false, "embedded_title": false, "is_polish": true}'
    assert models.chart_findings(figures, lambda: lambda x: [said] * len(x)).first().problems == "axis without a unit"


def test_overlapping_chunks_cover_the_text(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(400))
    pieces = [r.piece for r in models.overlapping_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "chunk").collect()]
    at = 0
    for p in pieces:
        here = text.index(p)
        assert here <= at and len(p) <= 1400
        at = here + len(p)
    assert at == len(text)


def test_authors(spark):
    e = spark.createDataFrame([(1, 1, "J. Nowak, A. Kowalski, Deep parsing"), (1, 2, "Smith J., Query plans"), (1, 3, "https://x")], "doc_id long, number int, entry string")
    assert {r.number: r.authors for r in models.authors(e).collect()} == {1: ["J. Nowak", "A. Kowalski"], 2: ["Smith J."], 3: []}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    q = follow(spark, f"{tmp_path}/in", CATALOG["SCL15"], f"{tmp_path}/out", f"{tmp_path}/ck", files_per_batch=1)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "block_id")
    want = CATALOG["SCL15"](Batch(docs))
    assert want.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, "en", "a"), (2, "", None, None), (3, "\n \n", "en", "s"), (4, "word " * 3000, "en", "s")], "doc_id long, text string, lang string, source string")
    for df in (rows, rows.limit(0)):
        for name, plan in CATALOG.items():
            if name not in ("JN25", "AG14", "AG19"):  # these read other tables
                plan(Batch(df)).collect()


def test_no_join_crosses(spark):
    """No plan of the catalog holds a cartesian product, and only one-row sides are nested loops."""
    c = Corpus(spark, SF)
    for name, plan in CATALOG.items():
        text = plan(c)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text or name == "JN25", name


def test_filters_and_columns_reach_the_scan(spark):
    plan = Corpus(spark, SF).documents.where(F.col("source") == "src1").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan
