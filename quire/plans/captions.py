"""Figures and tables with their descriptions, lists against what they list, footers, margins and suppression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import checks as K
from quire.plans import rules as R
from quire.plans import scalars as S
from quire.plans.rules import as_finding, finding, rule
from quire.sources.corpus import FIGURES, TABLES, Corpus, doc_window

# Beginnings of descriptions of tables and figures, the side looked at first, and how far one may lie below.
BEGINNINGS = {
    "table": (("tabele", "tabela", "tab.", "table", "tab"), "above", 60.0),
    "image": (("rysunek", "rys.", "fot.", "ilustracja", "wykres", "rycina", "schemat", "diagram", "grafika", "figure", "fig.", "photo", "img", "image", "schema", "chart", "plot"), "below", 40.0),
}
ABOVE = 40.0

_STARTS = {k: "(" + " OR ".join(f"starts_with(t, '{w}')" for w in ws) + ")" for k, (ws, _, _) in BEGINNINGS.items()}
_SIDED = """SELECT doc_id, kind, page, n, arg_min(text, block_id) FILTER (named AND side = 'above') AS ka, arg_min(text, block_id) FILTER (named AND side = 'below') AS kb, arg_min(text, block_id) FILTER (NOT named AND side = 'above') AS oa, arg_min(text, block_id) FILTER (NOT named AND side = 'below') AS ob FROM (
    SELECT v.doc_id, v.kind, v.page, n, block_id, text, CASE WHEN abs(b.y1 - vy0) < 40 THEN 'above' ELSE 'below' END AS side, CASE WHEN v.kind = 'table' THEN {table} ELSE {image} END AS named FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY page) AS n FROM visuals) v
    LEFT JOIN (SELECT *, lower(trim(text)) AS t FROM boxes) b ON b.doc_id = v.doc_id AND b.page = v.page AND (abs(b.y1 - vy0) < 40 OR abs(b.y0 - vy1) < CASE WHEN v.kind = 'table' THEN 60 ELSE 40 END)) GROUP BY ALL""".format(**_STARTS)
_PICK = "CASE WHEN {p} = 'above' THEN CASE WHEN ka IS NOT NULL THEN 'above' WHEN kb IS NOT NULL THEN 'below' WHEN oa IS NOT NULL THEN 'above' WHEN ob IS NOT NULL THEN 'below' END ELSE CASE WHEN kb IS NOT NULL THEN 'below' WHEN ka IS NOT NULL THEN 'above' WHEN ob IS NOT NULL THEN 'below' WHEN oa IS NOT NULL THEN 'above' END END"
_PICK_S = re.sub(r"\b(ka|kb|oa|ob)\b", r"s.\1", _PICK)
_DEFAULT = "CASE WHEN s.kind = 'table' THEN 'above' ELSE 'below' END"
DESCRIBED = f"""(SELECT doc_id, kind, page, side, trim(CASE WHEN side = 'above' THEN coalesce(ka, oa) WHEN side = 'below' THEN coalesce(kb, ob) ELSE '' END) AS description FROM (
    WITH RECURSIVE sided AS ({_SIDED}), walk AS (SELECT s.*, {_PICK.format(p=_DEFAULT)} AS side, {_DEFAULT} AS first FROM sided s WHERE n = 1
    UNION ALL SELECT s.*, {_PICK_S.format(p=f"coalesce(w.side, CASE WHEN s.kind = 'table' THEN w.first END, {_DEFAULT})")} AS side, coalesce(w.side, CASE WHEN s.kind = 'table' THEN w.first END, {_DEFAULT}) AS first FROM walk w JOIN sided s ON s.doc_id = w.doc_id AND s.kind = w.kind AND s.n = w.n + 1) SELECT * FROM walk))"""


def _fold(kind: str, first: str):
    """The step over a document's visuals: the side looked at first is that of the last description."""

    def side_of(s: Column, *order: str) -> Column:
        return F.coalesce(*(F.when(s[x].isNotNull(), "above" if x[1] == "a" else "below") for x in order))

    def step(acc: Column, s: Column) -> Column:
        side = F.when(acc["side"] == "above", side_of(s, "ka", "kb", "oa", "ob")).otherwise(side_of(s, "kb", "ka", "ob", "oa"))
        text = F.when(side == "above", F.coalesce(s["ka"], s["oa"])).when(side == "below", F.coalesce(s["kb"], s["ob"])).otherwise("")
        row = F.struct(s["page"].alias("page"), s["image_type"].alias("image_type"), side.alias("side"), text.alias("description"))
        return F.struct(F.coalesce(side, acc["side"] if kind == "table" else F.lit(first)).alias("side"), F.concat(acc["out"], F.array(row)).alias("out"))

    return step


def described(c: Corpus, *kinds: str) -> DataFrame:
    """Visuals with side and description: the text of a block close above or below, one that begins like a caption before others.

    The side on which a document's visuals of a kind were described last is looked at first, so a document's visuals are folded in their order.
    """
    parts = []
    for kind in kinds or BEGINNINGS:
        words, first, below = BEGINNINGS[kind]
        v = c.visuals.where(F.col("kind") == kind).select("doc_id", "page", "kind", "image_type", "vy0", "vy1")
        b = c.boxes.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "block_id", F.trim("text").alias("t"), "y0", "y1")
        near = F.abs(F.col("y1") - F.col("vy0")) < ABOVE
        j = v.join(b, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (near | (F.abs(F.col("y0") - F.col("vy1")) < below)), "left")
        named = F.greatest(*(F.startswith(F.lower("t"), F.lit(w)) for w in words))
        best = lambda n, up: F.min_by("t", F.when((named if n else ~named) & (near if up else ~near), F.col("block_id")))
        g = j.groupBy("doc_id", "page", "kind", "image_type").agg(best(True, True).alias("ka"), best(True, False).alias("kb"), best(False, True).alias("oa"), best(False, False).alias("ob"))
        out = "array<struct<page:int,image_type:string,side:string,description:string>>"

        rows = F.array_sort(F.collect_list(F.struct("page", "image_type", "ka", "kb", "oa", "ob")))
        zero = F.struct(F.lit(first).alias("side"), F.array().cast(out).alias("out"))
        one = g.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.lit(kind).alias("kind"), F.inline(F.aggregate("rows", zero, _fold(kind, first), lambda a: a["out"])))
        parts.append(one)
    return reduce(DataFrame.unionByName, parts)


@rule("JN11", f"SELECT doc_id, page, kind, side, description FROM {DESCRIBED}")
def descriptions(c: Corpus) -> DataFrame:
    return described(c).select("doc_id", "page", "kind", "side", "description")


_NORMAL = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TITLE = _NORMAL.format(x="rtrim(lower(trim(title)), '.')")
_TEXT = _NORMAL.format(x="lower(trim(description))")


def unlisted(c: Corpus, entries: DataFrame, kind: str) -> DataFrame:
    """Entries of a list for which no visual on their page has a description that holds the title or is held by it."""
    one_space = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    title = one_space(F.rtrim(F.lower(F.trim("title")), F.lit(".")))
    v = described(c.listing, kind).where(F.col("description") != "").select(F.col("doc_id").alias("d"), F.col("page").alias("p"), one_space(F.lower(F.trim("description"))).alias("t"))
    e = entries.withColumn("__title", title)
    on = (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (F.contains("t", F.col("__title")) | F.contains("__title", F.col("t")))
    return e.join(v, on, "left_anti").drop("__title")


def _unlisted_sql(name: str, kind: str, what: str) -> str:
    return f"SELECT {what} FROM {name} e WHERE NOT EXISTS (SELECT 1 FROM {DESCRIBED} v WHERE v.doc_id = e.doc_id AND v.page = e.page AND v.kind = '{kind}' AND v.description <> '' AND (contains({_TEXT}, {_TITLE}) OR contains({_TITLE}, {_TEXT})))"


@rule("JN02", _unlisted_sql("tot", "table", "doc_id, seq, title, page"))
def tables_without(c: Corpus) -> DataFrame:
    return unlisted(c, c.tot, "table").select("doc_id", "seq", "title", "page")


@rule("JN03", _unlisted_sql("tof", "image", "doc_id, seq, title, page"))
def figures_without(c: Corpus) -> DataFrame:
    return unlisted(c, c.tof, "image").select("doc_id", "seq", "title", "page")


def _lack_sql(name: str, kind: str, short: str) -> str:
    return _unlisted_sql(name, kind, as_finding(f"{short}_mismatch", page="src_page", text="title")) + f" UNION ALL SELECT {as_finding(f'lack_of_{short}', page='1')} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {name})"


def _list_findings(c: Corpus, name: str, headings: tuple[str, ...], kind: str, short: str) -> DataFrame:
    """Entries without their visual, and documents without entries, which go along with the entries as rows without a page, so that the list is made once."""
    lists = c.listing_of(headings)
    e = getattr(lists, name).select("doc_id", "title", "page", "src_page", F.lit(True).alias("entry"))
    own = c.documents.select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("src_page"), F.lit(False).alias("entry"))
    e = e.unionByName(own).withColumn("listed", F.max("entry").over(doc_window())).where("entry or not listed")
    return finding(unlisted(lists, e, kind), F.when(F.col("entry"), f"{short}_mismatch").otherwise(f"lack_of_{short}"), page=F.col("src_page"), text=F.col("title"))


@rule("RD12", _lack_sql("tof", "image", "TOF"))
def figure_findings(c: Corpus) -> DataFrame:
    return _list_findings(c, "tof", FIGURES, "image", "TOF")


@rule("RD13", _lack_sql("tot", "table", "TOT"))
def table_findings(c: Corpus) -> DataFrame:
    return _list_findings(c, "tot", TABLES, "table", "TOT")


_ORDER = "SELECT {f} FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM {n}) WHERE page < before GROUP BY doc_id"


@rule("RD15", " UNION ALL ".join(_ORDER.format(f=as_finding(f"{n}_order_error", page="arg_min(src_page, seq)", text="arg_min(title, seq)"), n=n) for n in ("toc", "tof", "tot")))
def list_orders(c: Corpus) -> DataFrame:
    """The first entry of each list that names a smaller page than the one before it."""
    out = None
    for name in ("toc", "tof", "tot"):
        x = getattr(c, name).withColumn("before", F.lag("page").over(doc_window().orderBy("seq"))).where("page < before").groupBy("doc_id").agg(F.min(F.struct("seq", "src_page", "title")).alias("f"))
        f = finding(x, f"{name}_order_error", page=F.col("f.src_page"), text=F.col("f.title"))
        out = f if out is None else out.unionByName(f)
    return out


@rule("JN12", "SELECT doc_id, block_id, CASE min(r) WHEN 1 THEN 'toc' WHEN 2 THEN 'tot' ELSE 'tof' END AS type FROM (" + " UNION ALL ".join(f"SELECT b.doc_id, b.block_id, {i} AS r FROM boxes b JOIN {n} t ON t.doc_id = b.doc_id AND t.src_page = b.page WHERE b.x0 <= t.x1 + 5 AND b.x1 >= t.x0 - 5 AND b.y0 <= t.y1 + 5 AND b.y1 >= t.y0 - 5" for i, n in ((1, "toc"), (2, "tot"), (3, "tof"))) + ") GROUP BY doc_id, block_id")
def retagged(c: Corpus) -> DataFrame:
    """Blocks that meet an entry of contents, tables or figures, in that order of precedence, widened by 5 points."""
    box = lambda t, i: t.select(F.col("doc_id").alias("d"), F.col("src_page").alias("p"), *(F.col(x).alias(f"e{x}") for x in ("x0", "y0", "x1", "y1")), F.lit(i).alias("r"))
    e = box(c.toc, 1).unionByName(box(c.tot, 2)).unionByName(box(c.tof, 3))
    meet = (F.col("x0") <= F.col("ex1") + 5) & (F.col("x1") >= F.col("ex0") - 5) & (F.col("y0") <= F.col("ey1") + 5) & (F.col("y1") >= F.col("ey0") - 5)
    j = c.listing.boxes.join(e, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & meet).groupBy("doc_id", "block_id").agg(F.min("r").alias("r"))
    return j.select("doc_id", "block_id", F.when(F.col("r") == 1, "toc").when(F.col("r") == 2, "tot").otherwise("tof").alias("type"))


_RASTER = r"(?:^|[^\w])(?:rys(?:unek)?|fig(?:ure)?|wykres|fot(?:o)?|photo|image)\.?\s*(\d+(?:\.\d+)*)"


@rule("RD25", f"SELECT DISTINCT v.doc_id, regexp_extract(lower(description), '{_RASTER}', 1) AS figure FROM {DESCRIBED} d JOIN visuals v ON v.doc_id = d.doc_id AND v.page = d.page AND v.kind = d.kind WHERE v.kind = 'image' AND v.image_type = 'raster' AND regexp_matches(lower(description), '{_RASTER}')")
def raster_figures(c: Corpus) -> DataFrame:
    """Figure numbers in the descriptions of raster images."""
    d = described(c).where((F.col("kind") == "image") & (F.col("image_type") == "raster") & F.lower("description").rlike(_RASTER))
    return d.select("doc_id", F.regexp_extract(F.lower("description"), _RASTER, 1).alias("figure")).distinct()


# ---- footers and margins ---------------------------------------------------------------------

# Beginnings of the heading from which pages are numbered.
CHAPTERS = (
    "streszczenie", "abstract", "wstęp", "wstep", "introduction", "spis treści", "spis tresci", "table of contents", "table of content", "toc", "spis rysunków", "spis rysunkow", "list of figures", "tof",
    "spis tabel", "spis tablic", "list of tables", "tot", "wykaz skrótów", "wykaz skrotow", "list of abbreviations",
)
_CHAPTER = "^(" + "|".join(CHAPTERS) + ")"

_FIRST = f"""SELECT d.doc_id, coalesce(h.page, t.page) AS first_page FROM (SELECT DISTINCT doc_id FROM sheets) d LEFT JOIN (SELECT doc_id, min(page) AS page FROM (
      SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.page ORDER BY l.line, l.block_id) AS r FROM (SELECT doc_id, page, line, block_id, string_agg(text, ' ' ORDER BY word_index) AS text, max(size) AS size FROM words GROUP BY ALL) l)
      JOIN (SELECT doc_id, list_sort(list(size))[count(*) // 2 + 1] AS median FROM words GROUP BY doc_id) USING (doc_id) WHERE r <= 4 AND page BETWEEN 1 AND 10 AND size >= median + 1.5 AND regexp_matches(lower(text), '{_CHAPTER}') GROUP BY doc_id) h USING (doc_id)
    LEFT JOIN (SELECT doc_id, arg_min(page, seq) AS page FROM toc GROUP BY doc_id) t USING (doc_id)"""


def first_numbered(c: Corpus) -> DataFrame:
    """(doc_id, first_page): the first page of 1 to 10 with a large heading of a chapter among its first four lines, else the page of the first entry of the contents."""
    line = c.words.groupBy("doc_id", "page", "line", "block_id").agg(F.max("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda s: s["text"]), " ").alias("text"))
    line = line.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line", "block_id"))).where("r <= 4 and page between 1 and 10")
    big = line.join(K.upper_median(c.words, ["doc_id"], "size"), "doc_id").where((F.col("size") >= F.col("median") + 1.5) & F.lower("text").rlike(_CHAPTER))
    named = c.toc.groupBy("doc_id").agg(F.min_by("page", "seq").alias("toc_page"))
    pages = c.pages.select("doc_id").distinct()
    j = pages.join(big.groupBy("doc_id").agg(F.min("page").alias("big_page")), "doc_id", "left").join(named, "doc_id", "left")
    return j.select("doc_id", F.coalesce("big_page", "toc_page").alias("first_page"))


@rule("WN14", _FIRST)
def numbered_from(c: Corpus) -> DataFrame:
    return first_numbered(c)


_FOOT = "SELECT doc_id, page, arg_max(text, block_id) AS text FROM (SELECT b.*, height, lower(trim(text)) AS t FROM boxes b JOIN (SELECT doc_id, page, height FROM sheets) USING (doc_id, page)) WHERE y0 >= height * 0.88 AND (regexp_matches(t, '{0}') OR regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || page || '([^\\p{{L}}\\p{{N}}_]|$)')) GROUP BY doc_id, page".format(S.FOOTERS)
_PAGED = f"""(SELECT s.doc_id, s.page, f.text, CASE WHEN first_page IS NOT NULL AND s.page < first_page THEN CASE WHEN f.text IS NOT NULL THEN 'Footer_on_forbidden_page' END WHEN f.text IS NULL THEN 'No_footer'
      WHEN regexp_matches(f.text, '[0-9]') AND try_cast(regexp_extract(f.text, '([0-9]+)', 1) AS BIGINT) IS DISTINCT FROM s.page THEN 'Wrong_page_number' END AS category
    FROM sheets s LEFT JOIN ({_FOOT}) f ON f.doc_id = s.doc_id AND f.page = s.page LEFT JOIN ({_FIRST}) n ON n.doc_id = s.doc_id)"""


@rule("RD10", f"SELECT doc_id, category, CAST(NULL AS INTEGER) AS block_id, page, text FROM {_PAGED} WHERE category IS NOT NULL UNION ALL SELECT DISTINCT {as_finding('numeration_invalid', page='1')} FROM {_PAGED} WHERE category IN ('No_footer', 'Wrong_page_number')")
def footers(c: Corpus) -> DataFrame:
    """Footers before the first numbered page, pages from there on without one or with another number, and documents with any of the latter two."""
    j = c.boxes.join(c.pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    foot = j.where(S.is_footer(F.col("text"), F.col("y0"), F.col("page"), F.col("height"))).groupBy("doc_id", "page").agg(F.max_by("text", "block_id").alias("text"))
    p = c.pages.select("doc_id", "page").join(foot, ["doc_id", "page"], "left").join(first_numbered(c), "doc_id", "left")
    early, number = F.coalesce(F.col("page") < F.col("first_page"), F.lit(False)), F.regexp_extract("text", "([0-9]+)", 1).try_cast("long")
    later = F.when(F.col("text").isNull(), "No_footer").when(F.col("text").rlike("[0-9]") & ~number.eqNullSafe(F.col("page")), "Wrong_page_number")
    p = p.withColumn("category", F.when(early, F.when(F.col("text").isNotNull(), "Footer_on_forbidden_page")).otherwise(later)).where("category is not null")
    all_ = p.where("category <> 'Footer_on_forbidden_page'").select("doc_id").distinct()
    own = p.select("doc_id", "category", F.lit(None).cast("int").alias("block_id"), "page", "text")
    return own.unionByName(finding(all_, "numeration_invalid", page=F.lit(1)))


_SWAPPED = "(SELECT *, CASE WHEN page % 2 = 1 THEN l ELSE r END AS a, CASE WHEN page % 2 = 1 THEN r ELSE l END AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, page, x0 AS l, width - x1 AS r, y0 AS t, height - y1 AS f FROM sheets))"


@rule("RD04", f"""SELECT {as_finding('margins', page='coalesce(min(page) FILTER (bad), min(page) FILTER (other))')} FROM (SELECT s.*, s.a <= s.b AS bad, (s.a, s.b, s.t, s.f) IS DISTINCT FROM (o.a, o.b, o.t, o.f) AS other FROM {_SWAPPED} s JOIN {_SWAPPED} o ON o.doc_id = s.doc_id AND o.page = 1 WHERE s.n > 1)
    GROUP BY doc_id HAVING bool_or(bad) OR bool_or(other)""")
def mirror_margins(c: Corpus) -> DataFrame:
    """Mirrored margins: the first page whose inner margin (left on odd pages) isn't the larger one, else the first whose margins differ from those of page 1."""
    odd, left, right = F.col("page") % 2 == 1, F.col("x0"), F.col("width") - F.col("x1")
    inner, outer = F.when(odd, left).otherwise(right), F.when(odd, right).otherwise(left)
    p = c.pages.select("doc_id", "page", inner.alias("a"), outer.alias("b"), F.struct(inner.alias("a"), outer.alias("b"), F.col("y0").alias("t"), (F.col("height") - F.col("y1")).alias("f")).alias("m"))
    one = F.first(F.when(F.col("page") == 1, F.col("m")), ignorenulls=True).over(doc_window().orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    p = p.withColumn("one", one).where("one is not null")
    g = p.groupBy("doc_id").agg(F.min(F.when(F.col("a") <= F.col("b"), F.col("page"))).alias("bad"), F.min(F.when(F.col("m") != F.col("one"), F.col("page"))).alias("other"))
    return finding(g.where("bad is not null or other is not null"), "margins", page=F.coalesce("bad", "other"))


# ---- words of citations, captions, corridors, suppression ------------------------------------

_NUMERIC = r"\[[0-9 ,\-]*[0-9][0-9 ,\-]*\]"


@rule("RD20", f"""SELECT {as_finding('unknown_citation', 'm.block_id', 'w.page', 'w.text').replace('doc_id,', 'm.doc_id,', 1)} FROM (SELECT DISTINCT doc_id, block_id, text, start, stop FROM {{spans:numeric}}) m JOIN words w ON w.doc_id = m.doc_id AND w.block_id = m.block_id AND m.start < w.end_char AND m.stop > w.start_char
    JOIN (SELECT DISTINCT c.doc_id, c.block_id, citation FROM cites c JOIN blocks b USING (doc_id, block_id) LEFT JOIN bib ON bib.doc_id = c.doc_id AND bib.number = c.number WHERE bib.number IS NULL AND NOT regexp_matches(b.content, '^\\[[0-9]+\\] ')) u ON u.doc_id = m.doc_id AND u.block_id = m.block_id AND u.citation = m.text""")
def unknown_citations(c: Corpus) -> DataFrame:
    """Every word of a citation with a number that the bibliography lacks."""
    from quire.plans.catalog import matches

    bad = K.unknown_citations(c.blocks, c.bibliography).select("doc_id", "block_id", F.col("citation").alias("text"))
    m = matches(c, _NUMERIC).join(bad, ["doc_id", "block_id", "text"]).select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), "start", "stop")
    w = c.words.join(m, (F.col("doc_id") == F.col("d")) & (F.col("block_id") == F.col("b")) & (F.col("start") < F.col("end_char")) & (F.col("stop") > F.col("start_char")))
    return finding(w, "unknown_citation", F.col("block_id"), F.col("page"), F.col("text"))


# What names the source of a figure or table.
SOURCES = r"\[[0-9]+|źródło|zródło|zrodlo|source|opracowanie własne|na podstawie"
_NEAREST = """(SELECT * FROM (SELECT b.doc_id, b.block_id, b.page, row_number() OVER (PARTITION BY b.doc_id, b.block_id, b.page ORDER BY greatest(0.0, y0 - vy1, vy0 - y1), vy0) AS r FROM boxes b JOIN captions c USING (doc_id, block_id) JOIN visuals v ON v.doc_id = b.doc_id AND v.page = b.page AND v.kind = c.kind) WHERE r = 1)"""


@rule("RD22", f"SELECT {as_finding('missing_caption_source', 'block_id', text='content')} FROM captions WHERE NOT regexp_matches(lower(content), '{SOURCES}') UNION ALL SELECT {as_finding('missing_caption_source', page='n.page', text='content').replace('doc_id,', 'c.doc_id,', 1)} FROM captions c JOIN {_NEAREST} n ON n.doc_id = c.doc_id AND n.block_id = c.block_id WHERE NOT regexp_matches(lower(content), '{SOURCES}')")
def caption_sources(c: Corpus) -> DataFrame:
    """Captions without a source, and once more for the visual that each belongs to."""
    from quire.plans.catalog import captions, nearest

    bad = captions(c).where(~F.lower("content").rlike(SOURCES))
    seen = nearest(c).select("doc_id", "block_id", "page").join(bad.select("doc_id", "block_id", "content"), ["doc_id", "block_id"])
    return finding(bad, "missing_caption_source", F.col("block_id"), text=F.col("content")).unionByName(finding(seen, "missing_caption_source", page=F.col("page"), text=F.col("content")))


@rule("RD23", f"SELECT {as_finding('corridor', 'w.block_id', 'w.page', 'w.text').replace('doc_id,', 'w.doc_id,', 1)} FROM words w JOIN (SELECT * FROM (SELECT doc_id, block_id, page, line, x1 AS g0, lead(x0) OVER (PARTITION BY doc_id, block_id, page, line ORDER BY x0) AS g1 FROM words) WHERE g1 IS NOT NULL) g ON g.doc_id = w.doc_id AND g.block_id = w.block_id AND g.page = w.page AND w.line = g.line + 1 AND ((w.x0 > g0 AND w.x0 < g1) OR (w.x1 > g0 AND w.x1 < g1)) WHERE w.page >= 3")
def corridors(c: Corpus) -> DataFrame:
    """Words from page 3 on that begin or end below a gap of the line above in their block."""
    w = c.words.where("page >= 3").select("doc_id", "block_id", "page", "line", "text", "x0", "x1")
    g = w.withColumn("g1", F.lead("x0").over(Window.partitionBy("doc_id", "block_id", "page", "line").orderBy("x0"))).where("g1 is not null")
    g = g.select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), F.col("page").alias("p"), (F.col("line") + 1).alias("l"), F.col("x1").alias("g0"), "g1")
    within = lambda x: (F.col(x) > F.col("g0")) & (F.col(x) < F.col("g1"))
    j = w.join(g, (F.col("doc_id") == F.col("d")) & (F.col("block_id") == F.col("b")) & (F.col("page") == F.col("p")) & (F.col("line") == F.col("l")) & (within("x0") | within("x1")))
    return finding(j, "corridor", F.col("block_id"), F.col("page"), F.col("text"))


_REGION = "(SELECT doc_id, block_id FROM (SELECT *, max(CASE WHEN regexp_matches(lower(content), '^(acronyms|results|1\\.2 results)') THEN block_id END) OVER w AS a, max(CASE WHEN n_words < 6 AND NOT regexp_matches(lower(content), '^(acronyms|results|1\\.2 results)') THEN block_id END) OVER w AS z FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)) WHERE block_id > a AND (z IS NULL OR z < a))"


@rule("RD24", f"""SELECT doc_id, category, block_id, page, round(CASE WHEN x0 IS NULL THEN width / n * i + 5 ELSE x0 END, 3) AS x0, round(CASE WHEN x0 IS NULL THEN width / n * (i + 1) - 5 ELSE x1 END, 3) AS x1 FROM (
      SELECT f.*, width, count(*) OVER (PARTITION BY f.doc_id, f.page, x0 IS NULL) AS n, row_number() OVER (PARTITION BY f.doc_id, f.page, f.x0 IS NULL ORDER BY category) - 1 AS i FROM (
        SELECT f.doc_id, category, f.block_id, f.page, b.x0, b.y0, b.x1, b.y1 FROM (SELECT {as_finding('bastard', 'block_id', 'page')} FROM ({R._PARTS}) WHERE a < z AND page = z AND n_lines <= 2 UNION ALL SELECT {as_finding('shoemaker', 'block_id', 'page')} FROM ({R._PARTS}) WHERE a < z AND page = a AND n_lines = 1) f
        JOIN boxes b ON b.doc_id = f.doc_id AND b.block_id = f.block_id AND b.page = f.page WHERE (f.doc_id, f.page) NOT IN (SELECT (doc_id, page) FROM list_pages) AND (f.doc_id, f.page) NOT IN (SELECT (a.doc_id, a.page) FROM boxes a JOIN {_REGION} r ON r.doc_id = a.doc_id AND r.block_id = a.block_id)
          AND NOT EXISTS (SELECT 1 FROM visuals v WHERE v.doc_id = f.doc_id AND v.page = f.page AND b.x0 >= vx0 - 10 AND b.y0 >= vy0 - 10 AND b.x1 <= vx1 + 10 AND b.y1 <= vy1 + 10)
        UNION ALL SELECT doc_id, 'page_format', NULL, page, NULL, NULL, NULL, NULL FROM sheets WHERE NOT ((abs(width - 595) <= 10 AND abs(height - 842) <= 10) OR (abs(width - 842) <= 10 AND abs(height - 595) <= 10)) UNION ALL SELECT doc_id, 'orientation', NULL, page, NULL, NULL, NULL, NULL FROM sheets WHERE height < width) f
      JOIN (SELECT doc_id, page, width FROM sheets) USING (doc_id, page) WHERE page > 0)""")
def suppressed(c: Corpus) -> DataFrame:
    """Findings that stay: not on a page of a list or of acronyms, in no visual, not on the title page; those without a box get a place on the page's top edge."""
    from quire.plans.details import acronym_region

    names = ("doc_id", "category", "block_id", "page")
    kinds = lambda **k: F.explode(F.array_compact(F.array(*(F.when(v, n) for n, v in k.items())))).alias("category")
    f = c.parts.where("first < last").select("doc_id", "block_id", "page", kinds(bastard=F.expr("page = last and n_lines <= 2"), shoemaker=F.expr("page = first and n_lines = 1")))
    f = f.join(c.cut_boxes.select("doc_id", "block_id", "page", "x0", "y0", "x1", "y1"), ["doc_id", "block_id", "page"])
    acronyms = c.parts.select("doc_id", "block_id", "page").join(acronym_region(c), ["doc_id", "block_id"], "left_semi").select("doc_id", "page").distinct()
    f = f.join(K.list_pages(c.toc, c.tof, c.tot), ["doc_id", "page"], "left_anti").join(acronyms, ["doc_id", "page"], "left_anti")
    f = K.outside_visuals(f, c.visuals, "image", "table")
    whole = c.sheets.select("doc_id", "page", "width", F.lit(None).cast("int").alias("block_id"), kinds(page_format=R.off_format(), orientation=R.off_orientation()))
    placed = K.slots(whole, ["category"]).select(*names, F.col("sx0").alias("x0"), F.col("sx1").alias("x1"))
    return f.select(*names, F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1")).unionByName(placed).where("page > 0")


# ---- spans, strokes --------------------------------------------------------------------------

_SPANS = """(SELECT doc_id, block_id, page, line, span, min(x0) AS sx0, min(y0) AS sy0, max(x1) AS sx1, max(y1) AS sy1 FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, block_id, page, line ORDER BY word_index) AS span FROM (
    SELECT *, CASE WHEN (font, size, bold, italic) IS DISTINCT FROM lag((font, size, bold, italic)) OVER (PARTITION BY doc_id, block_id, page, line ORDER BY word_index) THEN 1 ELSE 0 END AS new FROM words)) GROUP BY doc_id, block_id, page, line, span)"""


@rule("SRC04", f"""SELECT doc_id, block_id, word_index, page, line, span FROM (SELECT w.doc_id, w.block_id, w.word_index, w.page, s.line, s.span, row_number() OVER (PARTITION BY w.doc_id, w.block_id, w.word_index ORDER BY s.line, s.span) AS r FROM (SELECT *, CASE WHEN regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]|[^\\p{{L}}\\p{{N}}]$') THEN 15 ELSE 0.2 END AS tol FROM words) w
    JOIN {_SPANS} s ON s.doc_id = w.doc_id AND s.block_id = w.block_id AND s.page = w.page AND w.x0 >= sx0 - tol AND w.x1 <= sx1 + tol AND w.y0 >= sy0 - 1 AND w.y1 <= sy1 + 1) WHERE r = 1""")
def attached(c: Corpus) -> DataFrame:
    """Words with the span they lie in: boxes within 0.2 points, 15 beside punctuation, and 1 in height; the first span takes a word."""
    return K.attach_words(c.words, K.spans_of(c.words)).select("doc_id", "block_id", "word_index", "page", "line", "span")


_STROKES = "(SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_id, word_index) AS id, x0, y0, x1, y1 FROM words WHERE italic)"


@rule("SRC09", f"""SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_parts FROM (SELECT s.*, root FROM (WITH RECURSIVE s AS MATERIALIZED {_STROKES}, near AS MATERIALIZED (SELECT a.doc_id, a.page, a.id AS i, b.id AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page = b.page AND a.x0 - 80 <= b.x1 AND a.x1 + 80 >= b.x0 AND a.y0 - 80 <= b.y1 AND a.y1 + 80 >= b.y0),
      walk AS (SELECT doc_id, page, id, id AS root FROM s UNION SELECT w.doc_id, w.page, n.j, w.root FROM walk w JOIN near n ON n.doc_id = w.doc_id AND n.page = w.page AND n.i = w.id) SELECT doc_id, page, id, min(root) AS root FROM walk GROUP BY ALL) r JOIN {_STROKES} s USING (doc_id, page, id)) GROUP BY doc_id, page, root""")
def merged_strokes(c: Corpus) -> DataFrame:
    """Strokes of a page (the boxes of italic words stand in for them) within 80 points of each other, merged transitively."""
    return K.merged_boxes(c.words.where("italic").select("doc_id", "page", "x0", "y0", "x1", "y1"), 80.0)

