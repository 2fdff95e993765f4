"""Spans, dominant values, geometry and scalars on rows by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.spans import mask, spans
from quire.functions.values import cosine, dominant
from quire.operators import checks as K
from quire.plans import rules
from quire.plans import scalars as S

PATTERN = r"[0-9]+[.,][0-9]+"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a1.,2 é😀\n", max_size=20), min_size=1, max_size=30))
def test_spans_equal_finditer(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: [tuple(s) for s in r.s or []] for r in df.select("id", spans(F.col("t"), PATTERN).alias("s")).collect()}
    assert got == {i: [(m[0], m.start(), m.end()) for m in re.finditer(PATTERN, t)] for i, t in enumerate(texts)}


def test_decimals_look_around(spark):
    texts = ["3.14", "v1.2.3", "a3.5", "see 2.50.", "7.5 °C", "section 2.1 x", "1.2 3.4", "x"]
    p = r"(?<![0-9.A-Za-z])[0-9]+\.[0-9]+(?!\.?[0-9])"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").where(F.col("t").rlike(r"[0-9]\.[0-9]"))
    got = {r.id: [s.start for s in r.s or []] for r in df.select("id", spans(F.col("t"), p).alias("s")).collect()}
    assert got == {i: [m.start() for m in re.finditer(p, t)] for i, t in enumerate(texts) if re.search(r"[0-9]\.[0-9]", t)}


def test_mask_keeps_offsets(spark):
    df = spark.createDataFrame([('a "b c" d "é" e',)], "t string")
    out = df.select(mask(F.col("t"), spans(F.col("t"), '"[^"]*"')).alias("m")).first().m
    assert out == "a       d     e"


def test_dominant_ties_take_the_first(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "z", 0), (2, None, 1)], "k int, v string, o int")
    assert sorted(map(tuple, dominant(df, ["k"], "v", ["o"]).collect())) == [(1, "b", 2), (2, "z", 1)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


@pytest.mark.parametrize(("n", "below", "grade"), [(9, 3, 66.67), (25, 0, 100.0), (18, 1, 94.44), (65, 1, 98.46), (46, 1, 97.83)])
def test_grades_of_known_counts(spark, n, below, grade):
    from quire.plans.catalog import grade_columns

    df = spark.createDataFrame([(0.5,)] * below + [(0.9,)] * (n - below), "cosine double")
    r = df.agg(*grade_columns()).first()
    assert (r.n, r.below, round(r.grade, 2)) == (n, below, grade)


def test_threshold_is_strict(spark):
    """A cosine of exactly 0.785 is on topic."""
    df = spark.createDataFrame([(0.785,), (0.7849999,), (0.0,)], "cosine double")
    assert df.where("cosine < 0.785").count() == 2


@pytest.mark.parametrize(("text", "want"), [("1. a", "number_with_dot"), ("12) a", "number_with_bracket"), ("a) b", "letter_with_bracket"), ("● x", "bullet"), ("– x", "dash"), ("[3] x", "number_in_brackets"), ("7 x", "listing"), ("plain", None)])
def test_markers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.marker(F.col("t")).alias("m")).first().m == want


def words(lines):
    """Rows of words from (block, page, line, texts)."""
    out, index = [], {}
    for block, page, line, texts in lines:
        for i, t in enumerate(texts.split()):
            n = index.get(block, 0)
            out.append((1, block, n, t, page, line, 72.0 + 36 * i, 72.0 + 16 * line, 102.0 + 36 * i, 84.0 + 16 * line, 12.0))
            index[block] = n + 1
    return out


WORD = "doc_id long, block_id int, word_index int, text string, page int, line int, x0 double, y0 double, x1 double, y1 double, size double"


@pytest.mark.parametrize(("lines", "kind"), [([(0, 0, 0, "a b c d e f g h i"), (0, 0, 1, "j")], 1), ([(0, 0, 0, "a b c d e f g h"), (0, 0, 1, "i j")], 2), ([(0, 0, 0, "a b c d e f g h"), (0, 0, 1, "i")], None), ([(0, 0, 0, "a b c d e f g"), (0, 0, 1, "h i j")], None)])
def test_widow_boundaries(spark, lines, kind):
    got = K.widows(spark.createDataFrame(words(lines), WORD)).collect()
    assert [r.kind for r in got] == ([kind] if kind else [])


def test_page_breaks(spark):
    w = spark.createDataFrame(words([(0, 0, 39, "a b"), (0, 1, 0, "c d"), (0, 1, 1, "e f"), (0, 1, 2, "g"), (1, 1, 39, "a"), (1, 2, 0, "b")]), WORD)
    assert [(r.block_id, r.page) for r in K.shoemakers(w).orderBy("block_id").collect()] == [(0, 0), (1, 1)]
    assert [(r.block_id, r.page) for r in K.bastards(w).collect()] == [(1, 2)]


def test_citation_ranges(spark):
    b = spark.createDataFrame([(1, 0, "see [1, 3-4] and [9-7] and [a] and [2]"), (1, 1, "[1] entry"), (2, 0, None)], "doc_id long, block_id int, content string")
    assert sorted((r.citation, r.number) for r in K.cited(b.where("block_id = 0")).collect()) == [("[1, 3-4]", 1), ("[1, 3-4]", 3), ("[1, 3-4]", 4), ("[2]", 2)]


def test_acronyms_as_of(spark):
    u = spark.createDataFrame([(1, "AB", 3, 0), (1, "AB", 1, 5), (1, "CD", 2, 0), (1, "EF", 2, 9)], "doc_id long, acronym string, block_id int, start int")
    d = spark.createDataFrame([(1, "AB", 2, 0), (1, "EF", 2, 8)], "doc_id long, acronym string, block_id int, start int")
    assert sorted((r.acronym, r.problem) for r in K.undefined_acronyms(u, d).collect()) == [("AB", "used_before_definition"), ("CD", "undefined")]


def test_partitioning_changes_no_finding(spark):
    from quire.sources.corpus import Corpus

    c = Corpus(spark, "/root/testdata/sf0.001")
    a = sorted(map(str, rules.RULES["LG07"](c).collect()))
    c.__dict__["documents"] = c.documents.repartition(7)
    d = Corpus(spark, "/root/testdata/sf0.001")
    d.__dict__["documents"] = c.documents
    assert a == sorted(map(str, rules.RULES["LG07"](d).collect()))
