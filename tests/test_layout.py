"""Lists, descriptions, layout files and stored corpora on rows by hand, and rules that SQL follows without look-around, against Python's re."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.spans import spans
from quire.operators import checks as K
from quire.plans import catalog, models, rules
from quire.plans import scalars as S
from quire.sources import config, corpus, index, layout
from quire.sources.corpus import Corpus

SF = "/root/testdata/sf0.001"
WORD = "doc_id long, page int, block_id int, word_index int, text string, line int, x0 double, y0 double, x1 double, y1 double, font string, size double, bold boolean, italic boolean, start_char int, end_char int"


def words(lines, size=12.0):
    """Words of (page, block, line, text), one line at 16 points."""
    out, n = [], {}
    for page, block, line, text in lines:
        for i, t in enumerate(text.split()):
            k = n.get(block, 0)
            out.append((1, page, block, k, t, line, 72.0 + 36 * i, 72.0 + 16 * line, 102.0 + 36 * i, 84.0 + 16 * line, "Serif", size, False, False, None, None))
            n[block] = k + 1
    return out


def corpus_of(spark, lines, **tables):
    return corpus.corpus_of_words(spark, spark.createDataFrame(words(lines), WORD), **tables)


def test_contents_pages_end_with_the_first_miss(spark):
    entries = [f"{i} Chapter {i} ........ {i + 3}" for i in range(1, 7)]
    lines = [(0, 0, 0, "Title page")] + [(1, i + 1, i, t) for i, t in enumerate(["Contents", *entries[:2]])] + [(2, 10 + i, i, t) for i, t in enumerate(entries)] + [(3, 30, 0, "nothing here")] + [(4, 40 + i, i, t) for i, t in enumerate(entries)]
    got = [(r.seq, r.title, r.page, r.src_page) for r in corpus_of(spark, lines).toc.orderBy("seq").collect()]
    assert got == [(1, "1 Chapter 1", 4, 1), (2, "2 Chapter 2", 5, 1)] + [(i + 2, f"{i} Chapter {i}", i + 3, 2) for i in range(1, 7)]
    # one entry under a heading is too few, and so are four without one
    assert corpus_of(spark, [(0, 0, 0, "Contents"), (0, 1, 1, entries[0])]).toc.count() == 0
    assert corpus_of(spark, [(0, i, i, t) for i, t in enumerate(entries[:4])]).toc.count() == 0
    assert corpus_of(spark, [(0, i, i, t) for i, t in enumerate(entries[:5])]).toc.count() == 5


def test_lists_of_figures(spark):
    """Titles over several lines, hyphens, the end by another list or a page without entries."""
    lines = [(2, 0, 0, "List of figures"), (2, 1, 1, "Figure 1 Plan of the ........ 7"), (2, 2, 2, "Figure 2.1 A title that goes-"), (2, 3, 3, "on here"), (2, 4, 4, "and ends ........ 8")]
    more = [(3, 10, 0, "Figure 3 Next page ........ 9"), (4, 20, 0, "List of tables"), (4, 21, 1, "Table 1 Costs ........ 5"), (4, 22, 2, "Table 2 Gains ........ 6")]
    c = corpus_of(spark, lines + more)
    got = [(r.number, r.title, r.page, r.src_page) for r in c.tof.orderBy("seq").collect()]
    assert got == [("1", "Plan of the", 7, 2), ("2.1", "A title that goeson here and ends", 8, 2), ("3", "Next page", 9, 3)]
    assert [(r.number, r.title, r.page) for r in c.tot.orderBy("seq").collect()] == [("1", "Costs", 5), ("2", "Gains", 6)]
    # a first page with a single entry is none; neither is a heading below the top of the page
    assert corpus_of(spark, lines[:2]).tof.count() == 0
    assert corpus_of(spark, [(2, b, line + 20, t) for _, b, line, t in lines]).tof.count() == 0


def test_descriptions_remember_their_side(spark):
    """Keyword before other text, above before below for tables, and the side of the last one first."""
    v = [(1, p, "table", "vector", 60.0, 200.0, 560.0, 260.0, 100) for p in (0, 1, 2)]
    visuals = spark.createDataFrame(v, "doc_id long, page int, kind string, image_type string, vx0 double, vy0 double, vx1 double, vy1 double, px_width int")
    above, below = 6, 13  # lines that end at 180 and begin at 280
    lines = [(0, 0, above, "plain text"), (0, 1, below, "Table 1 costs"), (1, 2, above, "above here"), (1, 3, below, "below here"), (2, 4, above, "tab. 3"), (2, 5, 30, "far away")]
    got = {r.page: (r.side, r.description) for r in catalog.plans()["JN11"](corpus_of(spark, lines, visuals=visuals)).collect()}
    assert got == {0: ("below", "Table 1 costs"), 1: ("below", "below here"), 2: ("above", "tab. 3")}


def test_layout_files_and_rules(spark, tmp_path):
    """Rules run on words that were read from files, with their fonts, as they do on texts."""
    lines = [(0, 0, 0, "a b c d e f g h i"), (0, 0, 1, "j"), (1, 1, 0, "Some text with a value of 3,14 in it")]
    df = spark.createDataFrame(words(lines, 11.0), WORD)
    layout.write_layout(df, f"{tmp_path}/pages")
    c = corpus.corpus_of_words(spark, layout.read_layout(spark, f"{tmp_path}/pages"))
    plans = catalog.plans()
    assert [(r.block_id, r.text) for r in plans["RD17"](c).collect()] == [(0, "j")]
    assert [float(r.text) for r in plans["RD03"](c).collect()] == [11.0]
    assert [(r.block_id, r.number) for r in plans["LG06"](c).collect()] == [(1, "3,14")]
    old = df.select("doc_id", "page", F.struct("block_id", "word_index", "text", "line", "x0", "y0", "x1", "y1").alias("w")).groupBy("doc_id", "page").agg(F.collect_list("w").alias("words"))
    old.write.json(f"{tmp_path}/old")
    assert corpus.corpus_of_words(spark, layout.read_layout(spark, f"{tmp_path}/old")).lines.count() == 3


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_stored_corpus_gives_the_same(spark, tmp_path):
    Corpus(spark, SF).write(f"{tmp_path}/c")
    stored, lazy, plans = corpus.read_corpus(spark, f"{tmp_path}/c", SF), Corpus(spark, SF), catalog.plans()
    for q in ("WN01", "JN01", "RD10", "JN14", "RD24"):
        assert sorted(map(str, plans[q](stored).collect())) == sorted(map(str, plans[q](lazy).collect())), q


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize(("query", "most"), [("WN01", 1), ("AG03", 1), ("JN05", 1), ("JN14", 2), ("JN09", 3), ("JN01", 3)])
def test_words_are_not_shuffled(spark, query, most):
    plan = catalog.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_entries_without_a_page_come_last(spark):
    """A number too long for a page gives an entry without one, which SQL sorts behind the others."""
    lines = [(0, i, i, t) for i, t in enumerate(("Contents", "Long ........ 99999999999", "Later ........ 7", "Sooner ........ 2"))]
    assert [r.titles for r in catalog.plans()["SL05"](corpus_of(spark, lines)).collect()] == ["Sooner|Later|Long"]


def laid(spark):
    texts = ["  a  b\tc " * 7 + "\n\n \nx\n" + "w " * 470 + "\n" + "ab c " * 600, "", None, "Contents\nOne  two ...  3\nTwo .. 4\r\n" + "word\n" * 39 + "k " * 13, "List  of   figures\nFigure 1 Plan\t 7\nFigure 2 Plan 8\n12 34\u2028\n" + "a b\u0085 3 c\n" * 50, "x 1\n" * 6]
    df = spark.createDataFrame([(100 * i + k, t, "en", "s") for i, t in enumerate(texts) for k in range(12)], "doc_id long, text string, lang string, source string")
    return Corpus(spark, documents=df)


def test_laid_tables_equal_those_of_words(spark):
    """Lines, boxes, parts and pages by arithmetic are those that words give."""
    c = laid(spark)
    w = corpus.corpus_of_words(spark, c.words)
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    for name in ("lines", "boxes", "parts"):
        a, b = getattr(c, name), getattr(w, name)
        assert sorted(a.dtypes) == sorted(b.dtypes) and rows(a, b.columns) == rows(b, b.columns), name
    assert rows(c.pages, ("doc_id", "page", "x0", "y0", "x1", "y1")) == rows(w.pages, ("doc_id", "page", "x0", "y0", "x1", "y1"))
    assert rows(c.sheets, c.sheets.columns) == rows(c.pages, c.sheets.columns)


def test_sorted_lists_are_whole(spark):
    """All words and lines by their place on the page, whichever block they are in, and those by arithmetic as those that words give."""
    lines = [(p, b, line, f"{p}.{line} " + " ".join(f"w{i}" for i in range(8))) for b, (p, line) in enumerate((p, line) for p in (2, 0, 1) for line in range(6))]
    want = [t for _, _, _, t in sorted(lines, key=lambda r: (r[0], r[2]))]
    plan = catalog.plans()["SL05"]
    assert [(r.words, r.lines) for r in plan(corpus_of(spark, lines)).collect()] == [(" ".join(want), "\n".join(want))]
    c = laid(spark)
    rows = lambda x: sorted(tuple(r) for r in plan(x).select("doc_id", "words", "lines").collect())
    got = rows(c)
    assert got == rows(corpus.corpus_of_words(spark, c.words)) and len(got) == c.documents.count()
    n = {r.doc_id: r.n for r in c.words.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {d: len(w.split(" ")) for d, w, _ in got} == n and max(n.values()) > 1000


def test_lists_are_missed_in_no_document(spark):
    """Lists looked for where there may be any are those of all documents."""
    c, whole = laid(spark), laid(spark)
    whole.__dict__["listing"] = whole
    for name in ("toc", "tof", "tot"):
        got = sorted(map(str, getattr(c, name).collect()))
        assert got == sorted(map(str, getattr(whole, name).collect())) and got, name
    assert 0 < c.listing.texts.count() < c.texts.count()


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize(("query", "most"), [("JN08", 4), ("LG06", 5), ("RD12", 5), ("RD24", 9), ("JN12", 4), ("RD13", 5), ("LG02", 4)])
def test_layout_is_made_once_a_table(spark, query, most):
    """Lists are found in one pass each, and no words are made for them."""
    plan = catalog.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most and "word_index" not in plan


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_a_list_is_made_once_for_its_findings(spark):
    """Entries and documents without any come from one list, whose lines are not grouped as they lie apart."""
    plan = catalog.queries()["RD13"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "collect_list(struct(x0" not in plan


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_lists_share_what_deals_them(spark):
    """Three lists of chapter numbers take the blocks of one exchange, each of its own documents alone, and group no lines."""
    listing = Corpus(spark, SF).listing
    n = listing.placed.select("doc_id").distinct().count()
    for headings in (corpus.CONTENTS, corpus.FIGURES, corpus.TABLES):
        assert 0 < listing.headed(headings).placed.select("doc_id").distinct().count() < n
    plan = catalog.queries()["LG02"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "collect_list(struct(x0" not in plan


def paged(spark):
    """Lists over several pages, below and after pages without entries, under headings with more spaces and among other lists."""
    page = lambda *lines: "\n".join(lines + ("pad",) * (40 - len(lines)))
    two, one, none = ("Table 1 Costs ... 0", "Table 2 A title that", "goes on ... 3"), ("Tabela 3. Gains  4",), ("Nothing 5 here",)
    pages = [("LIST  of   Tables", *two), one, none, one, ("x", "y", "z", "u", "v", "spis tabel", *two), ("Spis tablic", *none), two, ("Spis rysunków", *two), ("list of tables", *one), ("Contents", *two, *one)]
    orders = [[i] for i in range(len(pages))] + [[i, j, k] for i in range(len(pages)) for j in range(len(pages)) for k in (1, 6, 8)]
    rows = [(77 * n + 1, "\n".join(page(*pages[i]) for i in o), "en", "s") for n, o in enumerate(orders)]
    return Corpus(spark, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def test_lists_over_pages_equal_those_of_words(spark):
    """Lists of lines that lie apart, of documents with a heading alone, are those of grouped lines of all documents."""
    c = paged(spark)
    w = corpus.corpus_of_words(spark, c.words, pages=c.pages, documents=c.documents, visuals=c.visuals)
    for name in ("toc", "tof", "tot"):
        got = sorted(map(str, getattr(c, name).collect()))
        assert got == sorted(map(str, getattr(w, name).collect())) and got, name
    for q in ("RD12", "RD13", "LG02"):
        got = sorted(map(str, catalog.plans()[q](c).collect()))
        assert got == sorted(map(str, catalog.plans()[q](w).collect())), q
    kinds = {r.category: r.n for r in catalog.plans()["RD13"](c).groupBy("category").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert kinds["lack_of_TOT"] + c.tot.select("doc_id").distinct().count() == c.documents.count() and kinds["TOT_mismatch"]


# Forms as Python's re has them.
PYTHON_FORMS = {
    "comma": r"(\d+,(?!\d{3}(?!\d))\d+)", "dot": r"(?<![\d.a-zA-Z])\d+\.\d+(?!\.?\d)", "hyphen": r"(\s-\s|\s-(?=\D|$)|-\s)", "spaces": r"([a-zA-Z\d])[–—]([a-zA-Z])|([a-zA-Z])[–—]([a-zA-Z\d])",
}


def test_forms_against_re(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("12345 ,.-–—ab\t") for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["1,500 and 12,25", "1,5000", "v1.2.3", " - ", "a -b", "--"]
    ours = {"comma": rules.ENGLISH_COMMA, "dot": rules.POLISH_DOT, "hyphen": rules.DASHES["hyphen"], "spaces": rules.DASHES["no_spaces"]}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = df.select("i", *(spans(F.col("t"), p).alias(n) for n, p in ours.items())).collect()
    for r in got:
        for n, p in PYTHON_FORMS.items():
            assert [(s.start, s.stop) for s in r[n] or []] == [m.span() for m in re.finditer(p, texts[r.i])], (n, texts[r.i])


def test_dates_against_re(spark):
    texts = ["Lis B., 12 May 2021, accessed 2021-03-04.", "(2019). 3 stycznia 2020 r. and 03.04.1999", "May 2020, Jan. 5, 2021; 2018", "1.2.2020.5 x 2020/01/02-a 12-maj-2021 12-May-2021", "no date 12345", "sty 2020, lut. 2021, grudz 2022, 2023"]
    behind, ahead = rules.LOOK_BEHIND, rules.LOOK_AHEAD

    def brute(text):
        out = []
        for a, p, b, name in rules.DATES:
            for m in re.finditer(behind[a][0] + p + ahead[b][0], text):
                if not any(s <= m.start() < e for _, s, e, _ in out):
                    out.append((m[0], m.start(), m.end(), name))
                    if len(out) > 2:
                        return out
        return out

    got = [[tuple(d) for d in r.d] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rules.all_dates(F.col("t")).alias("d")).collect()]
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 9


@pytest.mark.parametrize("text", ["", "a (b [c) d] e", "((x)", "x) y (z", "[a](b)c", "no", "((((deep))))"])
def test_bare_against_marks(spark, text):
    marks, stack = [False] * len(text), []
    for i, ch in enumerate(text):
        if ch in "([":
            stack.append(i)
        elif ch in ")]":
            for k in range(stack.pop() if stack else i, i + 1):
                marks[k] = True
    for i in stack:
        marks[i] = True
    want = re.sub("\x01+", " ", "".join("\x01" if m else c for c, m in zip(text, marks)))
    got, index_ = models._bare(text)
    assert got == want and len(index_) == len(got) + 1 and all(text[j] == c for c, j in zip(got, index_) if not marks[j])


@pytest.mark.parametrize(("word", "want"), [("API", True), ("(API),", True), ("kB", False), ("mRNA", True), ("eBook", False), ("A.B.", False), ("X1", False), ("A", False), ("ABCDEFGHIJK", False), ("WSTĘP", False), ("a_B_C", False), ("Word", False), ("C++", False)])
def test_potential_acronyms(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(S.potential_acronym(F.col("w")).alias("p")).first().p == want


def test_markers_with_an_active_one(spark):
    rows = [("1. a", None), ("1. a", "dash"), ("- a", "dash"), ("plain", "dash"), ("−x", None), ("1234. x", None)]
    got = [r.m for r in spark.createDataFrame(rows, "t string, a string").select(S.marker(F.col("t"), F.col("a")).alias("m")).collect()]
    assert got == ["number_with_dot", None, "dash", None, "dash", None]


def test_requirement_errors(spark, tmp_path):
    good = {"interlinia": "1.5", "minimalna_liczba_stron": "1", "maksymalna_liczba_stron": "2", "rozmiar_czcionki": "12", "margines": "standardowy", "format": "a4", "orientacja": "pionowa", "justowanie": "nie", "czcionka": {"1": "Arial"}}
    for i, x in enumerate((good, good | {"margines": "none"}, "{")):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=1) if isinstance(x, dict) else x)
    got = config.read_requirements(spark, str(tmp_path)).collect()
    assert sorted((str(r.error), r.max_pages) for r in got) == [("None", 2), ("margin", 2), ("not JSON", None)]
    assert config.toggles() == {n: True for n in config.TOGGLES} and not config.toggles({config.TOGGLES[0]: False})[config.TOGGLES[0]]
    with pytest.raises(ValueError):
        config.toggles({"x": True})


def test_figure_folder_is_emptied(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 5.0, 1.0, b"a"), (1, 0, 2.0, 1.0, b"b")], "doc_id long, page int, vy0 double, vx0 double, bytes binary")
    for df in (v, v.where("vy0 = 5.0")):
        index.write_figures(df, f"{tmp_path}/images")
        got = sorted((r.path, bytes(r.bytes)) for r in spark.read.parquet(f"{tmp_path}/images").collect())
    assert got == [("images/1_p0_0.png", b"a")]


def test_merged_boxes(spark):
    b = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 60.0, 0.0, 70.0, 10.0), (1, 0, 120.0, 0.0, 130.0, 10.0), (1, 0, 0.0, 500.0, 1.0, 501.0), (1, 1, 0.0, 0.0, 10.0, 10.0)]
    got = K.merged_boxes(spark.createDataFrame(b, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double"), 80.0).collect()
    assert sorted((r.page, r.x1, r.n_parts) for r in got) == [(0, 1.0, 1), (0, 130.0, 3), (1, 10.0, 1)]
