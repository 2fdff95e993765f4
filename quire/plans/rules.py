"""Domain rules: layout (RD), language (LG), bibliography (BB) and scoring (LM). Each comes with its DuckDB SQL.

A rule makes findings (doc_id, category, block_id, page, text); ``findings`` unions them and drops
those of the title page and those that lie in a figure or table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.spans import mask, spans
from quire.functions.values import dominant
from quire.operators import checks as K
from quire.plans import scalars as S
from quire.sources.corpus import Corpus, doc_window

#: Requirements that documents are held against.
CONFIG = {"line_spacing": 1.11, "font_size": 12.0, "fonts": ("Serif",), "min_pages": 2, "max_pages": 60, "format": "A4", "orientation": "portrait"}

RULES: dict[str, Callable[[Corpus], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rule(name: str, sql: str):
    def add(f: Callable[[Corpus], DataFrame]):
        RULES[name], ORACLES[name] = f, sql
        return f

    return add


def finding(df: DataFrame, category: str | Column, block: Column | None = None, page: Column | None = None, text: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        "doc_id", F.lit(category).alias("category"), (null if block is None else block).cast("int").alias("block_id"),
        (null if page is None else page).cast("int").alias("page"), (null if text is None else text).cast("string").alias("text"),
    )


FINDING = "doc_id, '{c}' AS category, {b} AS block_id, {p} AS page, {t} AS text"


def as_finding(category: str, block: str = "CAST(NULL AS INTEGER)", page: str = "CAST(NULL AS INTEGER)", text: str = "CAST(NULL AS VARCHAR)") -> str:
    return FINDING.format(c=category, b=block, p=page, t=text)


# ---- layout ----------------------------------------------------------------------------------


@rule("RD01", f"""SELECT {as_finding("line_spacing", text="CAST(dominant AS VARCHAR)")} FROM (SELECT doc_id, arg_min(spacing, (-n, first)) AS dominant FROM (
    SELECT doc_id, spacing, count(*) AS n, min((page, line)) AS first FROM (SELECT doc_id, page, line, round_even((y1 - lag(y1) OVER (PARTITION BY doc_id, block_id, page ORDER BY line)) / 12.0 / 1.2, 2) AS spacing FROM lines) WHERE spacing > 0.5 AND spacing < 3.0 GROUP BY ALL) GROUP BY doc_id) WHERE abs(dominant - 1.0) > 0.1""")
def line_spacing(c: Corpus) -> DataFrame:
    """The dominant line spacing of a document differs from 1.0 by more than 0.1."""
    order = Window.partitionBy("doc_id", "block_id", "page").orderBy("line")
    s = c.lines.withColumn("spacing", F.bround((F.col("y1") - F.lag("y1").over(order)) / 12.0 / 1.2, 2)).where("spacing > 0.5 and spacing < 3.0")
    d = dominant(s, ["doc_id"], "spacing", ["page", "line"]).where(F.abs(F.col("dominant") - 1.0) > 0.1)
    return finding(d, "line_spacing", text=F.col("dominant"))


@rule("RD02", f"SELECT {as_finding('page_count', text='CAST(n AS VARCHAR)')} FROM (SELECT doc_id, count(*) - 1 AS n FROM sheets GROUP BY doc_id) WHERE n < 2 OR n > 60")
def page_count(c: Corpus) -> DataFrame:
    """Fewer or more pages than required, the title page aside."""
    n = c.pages.groupBy("doc_id").agg((F.count("*") - 1).alias("n")).where((F.col("n") < CONFIG["min_pages"]) | (F.col("n") > CONFIG["max_pages"]))
    return finding(n, "page_count", text=F.col("n"))


@rule("RD03", f"SELECT {as_finding('font_size', text='CAST(main_size AS VARCHAR)')} FROM main_size WHERE abs(main_size - 12.0) > 0.1")
def font_size(c: Corpus) -> DataFrame:
    d = dominant(c.words, ["doc_id"], "size", ["page", "line", "x0", "block_id"]).where(F.abs(F.col("dominant") - CONFIG["font_size"]) > 0.1)
    return finding(d, "font_size", text=F.col("dominant"))


def off_format() -> Column:
    return S.page_format(F.col("width"), F.col("height")) != CONFIG["format"]


def off_orientation() -> Column:
    return S.orientation(F.col("width"), F.col("height")) != CONFIG["orientation"]


@rule("RD05", f"SELECT {as_finding('page_format', page='page')} FROM sheets WHERE NOT ((abs(width - 595) <= 10 AND abs(height - 842) <= 10) OR (abs(width - 842) <= 10 AND abs(height - 595) <= 10))")
def wrong_format(c: Corpus) -> DataFrame:
    return finding(c.sheets.where(off_format()), "page_format", page=F.col("page"))


@rule("RD06", f"SELECT {as_finding('orientation', page='page')} FROM sheets WHERE height < width")
def wrong_orientation(c: Corpus) -> DataFrame:
    return finding(c.sheets.where(off_orientation()), "orientation", page=F.col("page"))


@rule("RD07", f"SELECT {as_finding('font', block='arg_min(block_id, (block_id, word_index))', text='arg_min(font, (block_id, word_index))')} FROM words WHERE font NOT IN ('Serif') GROUP BY doc_id")
def wrong_font(c: Corpus) -> DataFrame:
    """The first word in a font that isn't allowed."""
    w = c.words.where(~F.col("font").isin(*CONFIG["fonts"])).groupBy("doc_id").agg(F.min(F.struct("block_id", "word_index", "font")).alias("f"))
    return finding(w, "font", block=F.col("f.block_id"), text=F.col("f.font"))


@rule("RD08", f"""SELECT {as_finding("justification", "block_id", "page", "CAST(line AS VARCHAR)")} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY page DESC, line DESC) AS back FROM lines)
    WHERE back > 1 AND NOT (abs(x0 - 72) <= 5 AND abs(x1 - 498) <= 5)""")
def justification(c: Corpus) -> DataFrame:
    """Lines that don't touch both margins, the last of each block aside."""
    back = Window.partitionBy("doc_id", "block_id").orderBy(F.col("page").desc(), F.col("line").desc())
    bad = c.lines.withColumn("back", F.row_number().over(back)).where((F.col("back") > 1) & ~((F.abs(F.col("x0") - 72) <= 5) & (F.abs(F.col("x1") - 498) <= 5)))
    return finding(bad, "justification", F.col("block_id"), F.col("page"), F.col("line"))


@rule("RD09", f"""SELECT {as_finding("blank_page", page="page")} FROM (SELECT doc_id, unnest(generate_series(0, last)) AS page FROM (SELECT doc_id, max(page) + 1 AS last FROM sheets GROUP BY doc_id)) p
    WHERE NOT EXISTS (SELECT 1 FROM sheets s WHERE s.doc_id = p.doc_id AND s.page = p.page) AND NOT EXISTS (SELECT 1 FROM visuals v WHERE v.doc_id = p.doc_id AND v.page = p.page)""")
def blank_pages(c: Corpus) -> DataFrame:
    """Pages up to one past the last that hold neither words nor visuals."""
    p = c.pages.groupBy("doc_id").agg(F.max("page").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last") + 1)).alias("page"))
    bare = p.join(c.pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti").join(c.visuals.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    return finding(bare, "blank_page", page=F.col("page"))


@rule("RD11", f"""SELECT {as_finding("toc_mismatch", page="src_page", text="title")} FROM toc t WHERE NOT EXISTS (SELECT 1 FROM page_texts p WHERE p.doc_id = t.doc_id AND p.page = t.page AND contains(lower(trim(regexp_replace(page_text, '[ ]+', ' ', 'g'))), lower(trim(regexp_replace(t.title, '[ \\t\\n\\r]+', ' ', 'g')))))
    UNION ALL SELECT {as_finding("lack_of_toc")} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toc)""")
def contents(c: Corpus) -> DataFrame:
    """Entries that aren't on their page, and documents without any."""
    missing = finding(K.missing_entries(c.toc, K.page_texts(c.lines)), "toc_mismatch", page=F.col("src_page"), text=F.col("title"))
    return missing.unionByName(finding(c.documents.join(c.toc, "doc_id", "left_anti"), "lack_of_toc"))


@rule("RD14", f"SELECT {as_finding('raster_image', page='page')} FROM visuals WHERE kind = 'image' AND image_type = 'raster'")
def raster(c: Corpus) -> DataFrame:
    return finding(c.visuals.where("kind = 'image' and image_type = 'raster'"), "raster_image", page=F.col("page"))


@rule("RD16", f"""SELECT {as_finding("orphan", "block_id", "page", "text")} FROM (SELECT w.*, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x0 DESC, block_id, word_index) AS r FROM words w) w JOIN main_size USING (doc_id)
    WHERE r = 1 AND regexp_matches(text, '^[A-Za-z]$') AND size >= main_size * 0.8 AND NOT EXISTS (SELECT 1 FROM words o WHERE o.doc_id = w.doc_id AND o.page = w.page AND w.x1 + 1 <= o.x1 AND w.x1 + 50 >= o.x0 AND w.y0 <= o.y1 AND w.y1 >= o.y0)""")
def orphans(c: Corpus) -> DataFrame:
    return finding(K.hanging(c.words), "orphan", F.col("block_id"), F.col("page"), F.col("text"))


_WIDOW = "SELECT doc_id, block_id, list(lineno ORDER BY word_index) AS ls, arg_max(text, word_index) AS text, arg_max(page, word_index) AS page FROM (SELECT *, page * 1000 + line AS lineno FROM words) GROUP BY doc_id, block_id HAVING count(*) >= 10"


@rule("RD17", f"SELECT {as_finding('widow', 'block_id', text='text')} FROM ({_WIDOW}) WHERE ls[-1] <> ls[-2] OR ls[-2] <> ls[-3]")
def widows(c: Corpus) -> DataFrame:
    return finding(K.widows(c.words), "widow", F.col("block_id"), text=F.col("text"))


_PARTS = "SELECT *, min(page) OVER w AS a, max(page) OVER w AS z FROM (SELECT doc_id, block_id, page, count(DISTINCT line) AS n_lines FROM words GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id, block_id)"


@rule("RD18", f"SELECT {as_finding('bastard', 'block_id', 'page')} FROM ({_PARTS}) WHERE a < z AND page = z AND n_lines <= 2")
def bastards(c: Corpus) -> DataFrame:
    return finding(K.bastards(c.parts), "bastard", F.col("block_id"), F.col("page"))


@rule("RD19", f"SELECT {as_finding('shoemaker', 'block_id', 'page')} FROM ({_PARTS}) WHERE a < z AND page = a AND n_lines = 1")
def shoemakers(c: Corpus) -> DataFrame:
    return finding(K.shoemakers(c.parts), "shoemaker", F.col("block_id"), F.col("page"))


# ---- language --------------------------------------------------------------------------------

# What behind a number makes it a quantity, and words near a number that isn't one.
QUANTITIES = ("%", "$", "€", "£", "zł", "usd", "eur", "gbp", "°")
NUMBERED = (
    "wersja", "wersji", "wersjom", "wersjach", "wersję", "wer", "wersją", "wersje", "wersjami", "rys", "rysunek", "rysunkom", "rysunkach", "rysunku", "tabela", "tabele", "tabelę", "tabeli", "tabelom", "tabelach", "tab",
    "wykres", "wykresu", "wykresom", "wykresowi", "wykresem", "wykresie", "wykresach", "wyk", "rozdziale", "rozdział", "rozdziały", "rozdziału", "rozdziałem", "rozdziałach", "roz", "rozdz", "rozdziałów",
    "obraz", "obr", "obrazie", "obrazu", "obrazowi", "obrazach", "obrazem", "obrazom", "wzór", "wzoru", "wzorowi", "wzory", "wzorom", "wzorach", "wzorami", "wzorem", "wzorzerównanie", "równaniu", "równaniach", "równaniami",
    "równaniom", "równania", "równaniem", "rów", "listing",
)
AROUND_NUMBER = r"[^.()\[\]{}:,;\s]+"
#: Matches of numbers that other languages' commas or dots separate. Without look-around for SQL: the run of letters, digits and dots, or the character behind, comes along.
POLISH_DOT, ENGLISH_COMMA = r"(?<![\d.a-zA-Z])\d+\.\d+(?!\.?\d)", r"\d+,(?!\d{3}(?!\d))\d+"
CHAPTER_NUMBER = r"(^|[^\w.])(\d{1,3}\.\d{1,3}(?:\.\d{1,3})*)($|[^\w.]|\.($|[^\d]))"

_PL = f"regexp_matches(lower(content), '{S.POLISH}')"
_FOUND = """(SELECT s.doc_id, s.block_id, content, start, regexp_extract(text, '^[0-9]+\\.[0-9]+') AS number FROM {spans} s JOIN blocks b ON b.doc_id = s.doc_id AND b.block_id = s.block_id WHERE {pl} AND regexp_matches(text, '^[0-9]+\\.[0-9]+($|[^.0-9]|\\.$|\\.[^0-9])')
    UNION ALL SELECT s.doc_id, s.block_id, content, start, regexp_extract(text, '^[0-9]+,[0-9]+') FROM {spans:comma} s JOIN blocks b ON b.doc_id = s.doc_id AND b.block_id = s.block_id WHERE NOT {pl})""".replace("{pl}", _PL)
_TOKENS = "regexp_extract_all(lower({x}), '[^.()\\[\\]{{}}:,;\\s]+')"
_LG06 = f"""SELECT doc_id, block_id, start, number, severity FROM (SELECT f.doc_id, f.block_id, start, f.number, n_words,
      CASE WHEN list_has_any(after, {list(QUANTITIES)}) THEN 2 WHEN list_has_any(before, {list(NUMBERED)}) OR list_has_any(after, {list(NUMBERED)}) THEN 0 WHEN n_words < 6 AND len(string_split(trim(substr(f.content, 1, start)), ' ')) <= 1 THEN 0 WHEN k.number IS NOT NULL THEN 0 ELSE 1 END AS severity
    FROM (SELECT *, {_TOKENS.format(x="substr(content, start + length(number) + 1, 30)")} AS after, {_TOKENS.format(x="substr(content, greatest(1, start - 29), least(30, start))")} AS before FROM {_FOUND}) f JOIN (SELECT doc_id, block_id, n_words FROM placed) p ON p.doc_id = f.doc_id AND p.block_id = f.block_id
    LEFT JOIN (SELECT DISTINCT doc_id, number FROM chapter_numbers) k ON k.doc_id = f.doc_id AND k.number = f.number) WHERE severity >= CASE WHEN n_words >= 6 THEN 1 ELSE 2 END"""


@rule("LG06", _LG06)
def decimals(c: Corpus) -> DataFrame:
    """Decimal dots in Polish blocks and decimal commas in others: 2 before a unit, else 1. What stands near words of numbering, first in a heading or is a chapter's number is none; blocks but paragraphs need a unit."""
    b = c.counted.where(F.col("content").rlike(r"\d[.,]\d"))
    found = F.when(S.is_polish(F.col("content")), spans(F.col("content"), POLISH_DOT)).otherwise(spans(F.col("content"), ENGLISH_COMMA))
    d = b.select("doc_id", "block_id", "content", "n_words", F.inline(found)).withColumnRenamed("text", "number")
    tokens = lambda t: F.regexp_extract_all(F.lower(t), F.lit(AROUND_NUMBER), F.lit(0))
    after, before = tokens(F.substring("content", F.col("stop") + 1, F.lit(30))), tokens(F.substring("content", F.greatest(F.lit(1), F.col("start") - 29), F.least(F.lit(30), "start")))
    has = lambda t, words: F.arrays_overlap(t, F.array(*map(F.lit, words)))
    first = (F.col("n_words") < 6) & (F.size(F.split(F.trim(F.substring("content", F.lit(1), F.col("start"))), " ", -1)) <= 1)
    d = d.join(chapter_numbers(c).withColumn("chapter", F.lit(True)), ["doc_id", "number"], "left")
    severity = F.when(has(after, QUANTITIES), 2).when(has(before, NUMBERED) | has(after, NUMBERED) | first | F.col("chapter").isNotNull(), 0).otherwise(1)
    d = d.withColumn("severity", severity).where(F.col("severity") >= F.when(F.col("n_words") >= 6, 1).otherwise(2))
    return d.select("doc_id", "block_id", "start", "number", "severity")


#: Dashes that are wrong in any block, and in ranges of English and of Polish blocks.
DASHES = {
    "hyphen": r"\s-\s|\s-(?=\D|$)|-\s", "no_spaces": r"[a-zA-Z\d][–—][a-zA-Z]|[a-zA-Z][–—][a-zA-Z\d]", "range_en": r"\d+\s*[–-]\s*\d+", "range_pl": r"\d+\s+[–-]\s+\d+",
}
_DASHED = """SELECT s.doc_id, '{k}' AS kind, s.block_id, start FROM {{spans:{p}}} s JOIN (SELECT *, {pl} AS pl FROM placed) b ON b.doc_id = s.doc_id AND b.block_id = s.block_id WHERE {w}"""
_SKIP = "NOT regexp_matches(content, '^\\[[0-9]+\\] ') AND NOT regexp_matches(lower(content), '^(keywords|key words|słowa kluczowe)')"


@rule("LG07", " UNION ALL ".join(_DASHED.format(k=k, p=p, w=f"{w} AND {_SKIP}", pl=_PL) for k, p, w in (
    ("hyphen", "hyphen_plain", "NOT (n_words < 6 AND start > 0 AND regexp_matches(substr(content, start, 1), '\\p{L}') AND regexp_matches(substr(content, CAST(start + length(regexp_extract(substr(content, start + 1, 3), '^(\\s-\\s|\\s-|-\\s)')) + 1 AS BIGINT), 1), '\\p{L}'))"),
    ("no_spaces", "no_spaces", "true"), ("range", "range_en", "NOT pl AND (contains(text, '-') OR contains(text, ' '))"), ("range", "range_pl", "pl"))) + f" UNION ALL SELECT doc_id, 'mixed', block_id, CAST(strpos(content, '—') - 1 AS INTEGER) FROM blocks WHERE contains(content, '–') AND contains(content, '—') AND {_SKIP}")
def dashes(c: Corpus) -> DataFrame:
    """Hyphens for dashes (in headings not between letters), dashes without spaces, ranges with a hyphen or spaces in English and with spaces in Polish blocks, and both dashes in one block."""
    b = c.placed.where(~F.col("content").rlike(r"^\[[0-9]+\] ") & ~S.is_keywords(F.col("content"))).withColumn("pl", S.is_polish(F.col("content")))
    found = lambda p: b.where(F.col("content").rlike(p)).select("doc_id", "block_id", "content", "n_words", "pl", F.inline(spans(F.col("content"), p)))
    letter = lambda at: F.substring("content", at, F.lit(1)).rlike(r"\p{L}")
    name = (F.col("n_words") < 6) & (F.col("start") > 0) & letter(F.col("start")) & letter(F.col("stop") + 1)
    parts = [
        ("hyphen", found(DASHES["hyphen"]).where(~name)), ("no_spaces", found(DASHES["no_spaces"])),
        ("range", found(DASHES["range_en"]).where(~F.col("pl") & (F.contains("text", F.lit("-")) | F.contains("text", F.lit(" "))))), ("range", found(DASHES["range_pl"]).where("pl")),
    ]
    mixed = b.where(F.contains("content", F.lit("–")) & F.contains("content", F.lit("—")))
    out = mixed.select("doc_id", F.lit("mixed").alias("kind"), "block_id", (F.instr("content", F.lit("—")) - 1).alias("start"))
    for kind, p in parts:
        out = out.unionByName(p.select("doc_id", F.lit(kind).alias("kind"), "block_id", "start"))
    return out


@rule("LG02", "SELECT DISTINCT doc_id, number FROM chapter_numbers")
def chapter_numbers(c: Corpus) -> DataFrame:
    """Numbers of two parts or more in the entries of contents, figures and tables, and the first of each caption."""
    from quire.plans.catalog import captions

    titles = lambda t, *n: t.select("doc_id", F.concat_ws(" ", *n).alias("t"))
    lists = titles(c.toc, "title").unionByName(titles(c.tof, "number", "title")).unionByName(titles(c.tot, "number", "title"))
    every = lists.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(CHAPTER_NUMBER), F.lit(2))).alias("number"))
    first = captions(c).select("doc_id", F.regexp_extract("content", CHAPTER_NUMBER, 2).alias("number")).where("number <> ''")
    return every.unionByName(first).distinct()


@rule("LG04", "SELECT doc_id, acronym, min(block_id) AS block_id FROM definitions GROUP BY ALL")
def acronym_definitions(c: Corpus) -> DataFrame:
    from quire.plans.catalog import definitions

    return definitions(c).groupBy("doc_id", "acronym").agg(F.min("block_id").alias("block_id"))


@rule("LG05", """SELECT u.doc_id, u.acronym, used[1] AS block_id, CASE WHEN defined IS NULL THEN 'undefined' ELSE 'used_before_definition' END AS problem FROM (SELECT doc_id, acronym, min([block_id, start]) AS used FROM uses GROUP BY ALL) u
    LEFT JOIN (SELECT doc_id, acronym, min([block_id, start]) AS defined FROM definitions GROUP BY ALL) d ON u.doc_id = d.doc_id AND u.acronym = d.acronym WHERE (defined IS NULL OR used < defined) AND u.acronym NOT IN ('PDF', 'USA', 'DNA', 'THE', 'AND')""")
def undefined(c: Corpus) -> DataFrame:
    from quire.plans.catalog import definitions, uses

    known = uses(c).where(~F.col("acronym").isin("PDF", "USA", "DNA", "THE", "AND"))
    return K.undefined_acronyms(known, definitions(c)).select("doc_id", "acronym", "block_id", "problem")


_ITEMS = "(SELECT doc_id, block_id, content, CASE WHEN regexp_matches(content, '^[-–—] ') THEN 'dash' ELSE 'letter' END AS style, regexp_replace(content, '^([-–—]|[a-z]\\)) ', '') AS item FROM blocks WHERE regexp_matches(content, '^([-–—]|[a-z]\\)) '))"


@rule("LG11", f"""SELECT i.doc_id, i.block_id, i.style, CASE WHEN substr(i.item, -1) <> d.ending THEN 'ending' ELSE 'casing' END AS problem FROM {_ITEMS} i JOIN (
    SELECT doc_id, style, arg_min(ending, (-n, ending)) AS ending FROM (SELECT doc_id, style, substr(item, -1) AS ending, count(*) AS n FROM {_ITEMS} GROUP BY ALL) GROUP BY ALL) d USING (doc_id, style) JOIN (
    SELECT doc_id, style, count(*) FILTER (regexp_matches(item, '^\\p{{Lu}}')) * 2 > count(*) AS upper FROM {_ITEMS} GROUP BY ALL) s USING (doc_id, style)
    WHERE substr(i.item, -1) <> d.ending OR regexp_matches(i.item, '^\\p{{Lu}}') <> s.upper""")
def list_style(c: Corpus) -> DataFrame:
    """List items whose last character isn't the list's most frequent one (the smallest of several), or whose first letter's case isn't the majority's."""
    items = c.blocks.where(F.col("content").rlike(r"^([-–—]|[a-z]\)) "))
    items = items.select("doc_id", "block_id", F.when(F.col("content").rlike("^[-–—] "), "dash").otherwise("letter").alias("style"), F.regexp_replace("content", r"^([-–—]|[a-z]\)) ", "").alias("item"))
    items = items.withColumns({"ending": F.right("item", F.lit(1)), "upper": F.col("item").rlike(r"^\p{Lu}")})
    by = Window.partitionBy("doc_id", "style")
    n = F.count("*").over(Window.partitionBy("doc_id", "style", "ending"))
    items = items.withColumn("n", n).withColumn("best", F.min_by("ending", F.struct((-F.col("n")).alias("n"), "ending")).over(by)).withColumn("most", F.sum(F.col("upper").cast("int")).over(by) * 2 > F.count("*").over(by))
    bad = items.where((F.col("ending") != F.col("best")) | (F.col("upper") != F.col("most")))
    return bad.select("doc_id", "block_id", "style", F.when(F.col("ending") != F.col("best"), "ending").otherwise("casing").alias("problem"))


# First persons in English and in Polish by pronoun or ending; a plain stand-in for a parser of forms.
FIRST_PERSON = r"(^|[^\p{L}])(i|we|my|our|me|us|ja|my|nas|nasz|nasze|[\p{L}]{2,}(łem|łam|liśmy|łyśmy))([^\p{L}]|$)"


@rule("LG12", f"""SELECT doc_id, round_even(100.0 * count(*) FILTER (p) / count(*), 0) AS passive, 100 - round_even(100.0 * count(*) FILTER (p) / count(*), 0) AS active, count(*) FILTER (f) AS personal_form FROM (
    SELECT doc_id, regexp_matches(lower(s), '(^| )(is|are|was|were|been|be) \\p{{L}}+ed( |[.!?])') AS p, regexp_matches(lower(s), '{FIRST_PERSON}') AS f FROM (SELECT doc_id, unnest(regexp_extract_all(content, '[^.!?]+[.!?]+')) AS s FROM blocks) WHERE length(s) >= 15) GROUP BY doc_id""")
def voices(c: Corpus) -> DataFrame:
    """Shares of sentences in the passive and the active voice, by a pattern of auxiliary and participle, and the number in the first person."""
    s = sentences(c)
    passive = F.bround(100.0 * F.count(F.when(F.lower("s").rlike(r"(^| )(is|are|was|were|been|be) \p{L}+ed( |[.!?])"), 1)) / F.count("*"), 0)
    return s.groupBy("doc_id").agg(passive.alias("passive"), (100 - passive).alias("active"), F.count(F.when(F.lower("s").rlike(FIRST_PERSON), 1)).alias("personal_form"))


def sentences(c: Corpus) -> DataFrame:
    return c.blocks.select("doc_id", "block_id", F.explode(F.regexp_extract_all("content", F.lit(r"[^.!?]+[.!?]+"), F.lit(0))).alias("s")).where(F.length("s") >= 15)


def personal_forms(c: Corpus) -> DataFrame:
    """Sentences in the first person."""
    return sentences(c).where(F.lower("s").rlike(FIRST_PERSON))


@rule("LG13", "SELECT f.doc_id, f.category, f.block_id, f.page FROM (" + " UNION ALL ".join(f"SELECT {as_finding(n, 'block_id', 'page')} FROM ({_PARTS}) WHERE a < z AND {w}" for n, w in (("bastard", "page = z AND n_lines <= 2"), ("shoemaker", "page = a AND n_lines = 1"))) + f""" UNION ALL SELECT {as_finding('widow', 'block_id', 'page', 'text')} FROM ({_WIDOW}) WHERE ls[-1] <> ls[-2] OR ls[-2] <> ls[-3]) f
    JOIN boxes b ON b.doc_id = f.doc_id AND b.block_id = f.block_id AND b.page = f.page WHERE NOT EXISTS (SELECT 1 FROM visuals v WHERE v.doc_id = f.doc_id AND v.page = f.page AND v.kind = 'image' AND b.x0 >= vx0 - 10 AND b.y0 >= vy0 - 10 AND b.x1 <= vx1 + 10 AND b.y1 <= vy1 + 10)""")
def outside_images(c: Corpus) -> DataFrame:
    """Findings whose block doesn't lie in an image of its page."""
    last = c.words.groupBy("doc_id", "block_id").agg(F.max_by("page", "word_index").alias("last"))
    widow = widows(c).drop("page").join(last, ["doc_id", "block_id"]).withColumnRenamed("last", "page")
    f = bastards(c).unionByName(shoemakers(c)).unionByName(widow, allowMissingColumns=True)
    f = f.join(c.boxes.select("doc_id", "block_id", "page", "x0", "y0", "x1", "y1"), ["doc_id", "block_id", "page"])
    return K.outside_visuals(f, c.visuals, "image").select("doc_id", "category", "block_id", "page")


# Quotations, from any opening mark to the next closing one.
QUOTED = "[“„″”'\"](.+?)[“”″'\"]"


@rule("SCL25", "SELECT doc_id, block_id, array_to_string(list_transform(list_zip(gs, list_append(ms, '')), lambda z: z[1] || repeat(' ', length(z[2]))), '') AS masked FROM (SELECT doc_id, block_id, string_split_regex(content, '{quoted}') AS gs, regexp_extract_all(content, '{quoted}') AS ms FROM blocks) WHERE len(ms) > 0")
def masked_quotes(c: Corpus) -> DataFrame:
    """Blocks with their quotations blanked; offsets hold."""
    q = c.blocks.where(F.col("content").rlike(QUOTED)).withColumn("q", spans(F.col("content"), QUOTED))
    return q.select("doc_id", "block_id", mask(F.col("content"), F.col("q")).alias("masked"))


@rule("SCL26", "SELECT n.doc_id, n.block_id, n.start, n.stop, count(q.start) > 0 AS quoted FROM {spans:number} n LEFT JOIN {spans:quotes} q ON q.doc_id = n.doc_id AND q.block_id = n.block_id AND ((q.start < n.start AND n.start < q.stop) OR (q.start < n.stop AND n.stop < q.stop)) GROUP BY ALL")
def quotes(c: Corpus) -> DataFrame:
    """Numbers, and whether one of their ends lies strictly inside a quotation."""
    number = r"[0-9]+[.,][0-9]+"
    b = c.blocks.where(F.col("content").rlike(number)).withColumn("q", F.coalesce(spans(F.col("content"), QUOTED), F.array().cast("array<struct<text:string,start:int,stop:int>>")))
    n = b.select("doc_id", "block_id", "q", F.inline(spans(F.col("content"), number)))
    within = lambda x: F.exists("q", lambda s: (s["start"] < F.col(x)) & (F.col(x) < s["stop"]))
    return n.select("doc_id", "block_id", "start", "stop", (within("start") | within("stop")).alias("quoted"))


# ---- bibliography ----------------------------------------------------------------------------

# Forms of the fields of an entry, (before, form, behind, name) with look-around by name. The first that matches gives the field and its format.
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
MON = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
MIESIAC = "stycznia|styczeń|lutego|luty|marca|marzec|kwietnia|kwiecień|maja|maj|czerwca|czerwiec|lipca|lipiec|sierpnia|sierpień|września|wrzesień|października|październik|listopada|listopad|grudnia|grudzień"
MIES = "sty|lut|mar|kwi|maj|czer?|lip|sier?|wrz|paź|list?|grud?"
YEAR = r"(?:1[6789]\d{2}|2[01]\d{2})(?:\s*[rR]\.?)?"
DATES = (
    ("word", rf"(?i:\d{{1,2}}\s+(?:{MONTH})\s+{YEAR})", "end", "DD Month YYYY"), ("word", rf"(?i:(?:{MONTH})\s+\d{{1,2}},?\s+{YEAR})", "end", "Month DD YYYY"), ("word", rf"(?i:(?:{MONTH})\s+{YEAR})", "end", "Month YYYY"),
    ("word", rf"(?i:\d{{1,2}}\s+(?:{MON})\.?\s+{YEAR})", "end", "DD Mon YYYY"), ("word", rf"(?i:(?:{MON})\.?\s+\d{{1,2}},?\s+{YEAR})", "end", "Mon DD YYYY"), ("word", rf"(?i:(?:{MON})\.?\s+{YEAR})", "end", "Mon YYYY"),
    ("word", rf"(?i:\d{{1,2}}\s+(?:{MIESIAC})\s+{YEAR})", "end", "DD miesiąc YYYY"), ("word", rf"(?i:(?:{MIESIAC})\s+{YEAR})", "end", "miesiąc YYYY"),
    ("word", rf"(?i:\d{{1,2}}\s+(?:{MIES})\.?\s+{YEAR})", "end", "DD mies. YYYY"), ("word", rf"(?i:(?:{MIES})\.?\s+{YEAR})", "end", "mies. YYYY"),
    ("path", rf"\d{{1,2}}/\d{{1,2}}/{YEAR}", "path", "dd/mm/yyyy"), ("path", rf"{YEAR}/\d{{1,2}}/\d{{1,2}}", "path", "yyyy/mm/dd"),
    ("path", rf"(?i:\d{{1,2}}-(?:{MIESIAC})-{YEAR})", "path", "dd-Miesiąc-yyyy"), ("path", rf"(?i:\d{{1,2}}-(?:{MIES})-{YEAR})", "path", "dd-mie-yyyy"), ("path", rf"(?i:\d{{1,2}}-(?:{MONTH})-{YEAR})", "path", "dd-Month-yyyy"), ("path", rf"(?i:\d{{1,2}}-(?:{MON})-{YEAR})", "path", "dd-mon-yyyy"),
    ("path", rf"\d{{1,2}}-\d{{1,2}}-{YEAR}", "path", "dd-mm-yyyy"), ("path", rf"{YEAR}-\d{{1,2}}-\d{{1,2}}", "path", "yyyy-mm-dd"), ("path", rf"\d{{1,2}}\.\d{{1,2}}\.{YEAR}", "path", "dd.mm.yyyy"), ("path", rf"{YEAR}\.\d{{1,2}}\.\d{{1,2}}", "path", "yyyy.mm.dd"),
    ("", rf"\({YEAR}\)", "mark", "(yyyy)"), ("space", YEAR, "part", "YYYY"),
)
PAGES = (
    ("field", r"pp\.[\s\:]*\d+(?:\s*[-–]\s*\d+)?", "", "pp. 2 - 4"), ("field", r"s\.[\s\:]*\d+(?:\s*[-–]\s*\d+)?", "", "s. 2 - 4"), ("field", r"pages?[\s\:]*\d+(?:\s*[-–]\s*\d+)?", "", "pages 2 - 4"),
    ("field", r"stron[ya][\s\:]*\d+(?:\s*[-–]\s*\d+)?", "", "strony 2 - 4"), ("field", r"\(\d{1,4}\)[\s:]*\d+(?:\s*[-–]\s*\d+)?", "", "(2):2 - 4"),
)
BARE_PAGES = (("path", r"\d+\s*[-–]\s*\d+", "slash", "bare 2 - 4"),)
VOLUMES = (("", r"\d{1,4}\(\d{1,4}(?:-\d{1,4})?\)", "", "2(14)"), ("", r"vol\.\s*\d{1,4}", "", "vol. 2"), ("", r"volume[\s\:]*\d{1,4}", "", "volume 2"), ("", r"\(\d{1,4}\)[\s:]*\d+(?:\s*[-–]\s*\d+)?", "", "(2):144 - 158"))
ACCESS = (
    ("field", r"[aA]vailable\s+[aA]t[\s:]*", "", "Available at:"), ("field", r"[aA]vailable\s+[\s:]*", "", "Available:"), ("field", r"\[\s*[oO]nline\s*\]\s*", "", "[online]"), ("field", r"[oO]nline\s*(?:[aA]t)[\s\:]*", "", "online at"),
    ("field", r"\(\s*[dD]ata\s*[dD]ostępu[\s\:]*\)", "", "(data dostępu)"), ("field", r"[dD]ata\s*[dD]ostępu[\s\:]*", "", "data dostępu"), ("field", r"[dD]ost[eę]p[\s\:]*", "", "dostęp"),
)
DOIS = (("", r"doi\.org/10\.\d{4,9}/\S+", "", "link"), ("", r"(?:DOI|doi)\s*:\s*10\.\d{4,9}/\S+", "", "citation"))
URLS = (("", r"https?:\s*//\S+", "", "url"),)
UPPER, LOWER = "[A-ZĄĆĘŁŃÓŚŹŻÀ-ÖØ-öø-ÿĀ-ž]", "[a-ząćęłńóśźżà-öø-ÿā-ž]"
SURNAME, FULL, SHORT = rf"{UPPER}{LOWER}+(?:[-–'](?:{UPPER}|{LOWER})+)*", f"{UPPER}{LOWER}+", rf"{UPPER}\.?"
AUTHORS = (
    ("start", rf"{SHORT}(?:\s*{SHORT})*\s{SURNAME}", "", "J. Nowak"), ("start", rf"{FULL}(?:\s(?:{FULL}|{SHORT}))*\s{SURNAME}", "", "Jan Nowak"), ("start", rf"{SURNAME},\s{SHORT}(?:\s*{SHORT})*\s*", "other", "Nowak, J."),
    ("start", rf"{SURNAME},\s{FULL}(?:\s(?:{FULL}|{SHORT}))*", "", "Nowak, Jan"), ("start", rf"{SURNAME}\s{SHORT}(?:\s*{SHORT})*", "other", "Nowak J."),
)
#: Look-around by name: as Spark has it, and as a group before or behind the form for SQL, which has none.
LOOK_BEHIND = {"": ("", ""), "start": ("^", "^"), "word": (r"(?<!\w)", r"(?:^|[^\w])"), "path": (r"(?<![\w\/\.\-])", r"(?:^|[^\w/.\-])"), "field": (r"(?<![\d\.\w])", r"(?:^|[^\w.])"), "space": (r"(?<=\s)", r"\s")}
LOOK_AHEAD = {
    "": ("", ""), "end": (r"\b(?!\.\d)", r"(?:$|[^\w.]|\.(?:$|[^\d]))"), "path": (r"\b(?![\w\/\-])(?!\.\d)", r"(?:$|[^\w/\-.]|\.(?:$|[^\d]))"), "slash": (r"(?![\w\/\-])", r"(?:$|[^\w/\-])"),
    "mark": (r"(?=[\s\.\:\;\,])", r"[\s.:;,]"), "part": (r"\b(?=[,;:.\s]|$)(?!\.[\d\w])", r"(?:$|[,;:\s]|\.(?:$|[^\w]))"), "other": (r"(?!\w)", r"(?:$|[^\w])"),
}
# Words of periodicals, of publishers, of proceedings and of preprints.
ARTICLE_WORDS = ("journal", "conference", "konferencja", "review", "proceedings", "briefings", "monthly", "annual", "magazine", "czasopismo", "miesięcznik")
BOOK_WORDS = ("wyd", "wydawnictwo", "press", "pwn", "publishing", "publishers", "pub", "ieee")
PROCEEDINGS = ("proceedings", "conference", "symposium", "workshop", "congress", "konferencja", "konferencji", "seminarium", "international", "handbook", "monograph")
PREPRINTS = ("arxiv", "preprint", "tech. rep", "technical report")


def first_form(text: Column, forms) -> tuple[Column, Column]:
    """(match, label) of the first form that occurs; nulls if none does."""
    found = [F.nullif(F.regexp_extract(text, LOOK_BEHIND[a][0] + p + LOOK_AHEAD[b][0], 0), F.lit("")) for a, p, b, _ in forms]
    label = F.coalesce(*(F.when(m.isNotNull(), F.lit(f[3])) for m, f in zip(found, forms)))
    return F.coalesce(*found), label


def all_dates(text: Column, most: int = 3) -> Column:
    """array<struct<text, start, stop, format>>: up to three dates that begin in no earlier one, form after form."""
    named = lambda n: lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(n).alias("format"))
    found = lambda a, p, b: F.coalesce(spans(text, LOOK_BEHIND[a][0] + p + LOOK_AHEAD[b][0]), F.array().cast("array<struct<text:string,start:int,stop:int>>"))
    each = [F.transform(found(a, p, b), named(n)) for a, p, b, n in DATES]
    none = F.array().cast("array<struct<text:string,start:int,stop:int,format:string>>")
    taken = lambda out, s: (F.size(out) >= most) | F.exists(out, lambda o: (o["start"] <= s["start"]) & (s["start"] < o["stop"]))
    return F.aggregate(F.concat(*each), none, lambda out, s: F.when(taken(out, s), out).otherwise(F.concat(out, F.array(s))))


_PLACES = (("author", AUTHORS), ("date", DATES), ("pages", PAGES), ("bare", BARE_PAGES), ("volume", VOLUMES), ("access", ACCESS), ("doi", DOIS), ("url", URLS))


def fields(c: Corpus) -> DataFrame:
    """Entries with their fields, the separator behind the authors, a periodical's or a publisher's word, and the BibTeX type."""
    e, out = F.col("entry"), {}
    for name, forms in _PLACES:
        out[name], out[f"{name}_format"] = first_form(e, forms)
    out["pages"], out["pages_format"] = F.coalesce(out["pages"], out["bare"]), F.coalesce(out["pages_format"], out["bare_format"])
    b = c.bibliography.withColumns({k: v for k, v in out.items() if not k.startswith("bare")})
    behind = F.btrim(F.regexp_replace(F.btrim(F.substring("entry", F.length("author") + 1, F.length("entry"))), r"^\(\d{4}[^\)]*\)", ""))
    word = lambda words: F.nullif(F.regexp_extract(F.lower(e), r"(?:^|[^\p{L}])(" + "|".join(words) + r")(?:$|[^\p{L}])", 1), F.lit(""))
    b = b.withColumns({"separator": F.nullif(F.regexp_extract(behind, "^[.,;:]", 0), F.lit("")), "journal": word(ARTICLE_WORDS), "publisher": word(BOOK_WORDS)})
    low = F.lower("entry")
    any_of = lambda words: F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    proceedings = F.col("journal").isNotNull() & F.col("journal").isin(*PROCEEDINGS)
    kind = F.when(proceedings, "inproceedings").when(F.col("journal").isNotNull(), "article").when(F.col("publisher").isNotNull(), "book").when(F.col("url").isNotNull(), "online")
    kind = kind.when(any_of(PREPRINTS), "article").when(any_of(PROCEEDINGS), "inproceedings").when(any_of(("transactions", "letters", "ieee access")) | low.rlike(r"\d+\(\d+\)"), "article")
    return b.withColumn("type", kind)


def _form_sql(forms) -> tuple[str, str]:
    q = lambda p: p.replace("'", "''")
    got = [f"nullif(regexp_extract(entry, '{q(LOOK_BEHIND[a][1])}({q(p)}){q(LOOK_AHEAD[b][1])}', 1), '')" for a, p, b, _ in forms]
    labels = [f"CASE WHEN {g} IS NOT NULL THEN '{f[3]}' END" for g, f in zip(got, forms)]
    return f"coalesce({', '.join(got)})", f"coalesce({', '.join(labels)})"


def _fields_sql() -> str:
    cols = ", ".join(f"{_form_sql(f)[0]} AS {n}, {_form_sql(f)[1]} AS {n}_format" for n, f in _PLACES)
    word = lambda words: "nullif(regexp_extract(lower(entry), '(?:^|[^\\p{L}])(" + "|".join(words) + ")(?:$|[^\\p{L}])', 1), '')"
    any_of = lambda words: "(" + " OR ".join(f"contains(lower(entry), '{w}')" for w in words) + ")"
    return f"""(SELECT *, CASE WHEN journal IN {PROCEEDINGS} THEN 'inproceedings' WHEN journal IS NOT NULL THEN 'article' WHEN publisher IS NOT NULL THEN 'book' WHEN url IS NOT NULL THEN 'online' WHEN {any_of(PREPRINTS)} THEN 'article' WHEN {any_of(PROCEEDINGS)} THEN 'inproceedings'
        WHEN {any_of(("transactions", "letters", "ieee access"))} OR regexp_matches(lower(entry), '\\d+\\(\\d+\\)') THEN 'article' END AS type FROM (
      SELECT * REPLACE (coalesce(pages, bare) AS pages, coalesce(pages_format, bare_format) AS pages_format), nullif(regexp_extract(trim(regexp_replace(trim(substr(entry, length(author) + 1)), '^\\(\\d{{4}}[^\\)]*\\)', '')), '^[.,;:]'), '') AS separator, {word(ARTICLE_WORDS)} AS journal, {word(BOOK_WORDS)} AS publisher
      FROM (SELECT doc_id, block_id, number, entry, {cols} FROM bib)))"""


FIELDS = _fields_sql()
TYPE = "type"


def typed(c: Corpus) -> DataFrame:
    return fields(c)


_SHOWN = ("author", "author_format", "date", "date_format", "pages", "pages_format", "doi", "url", "volume", "access")


@rule("BB01", f"SELECT doc_id, number, {', '.join(_SHOWN)} FROM {FIELDS}")
def entry_fields(c: Corpus) -> DataFrame:
    return fields(c).select("doc_id", "number", *_SHOWN)


_ADDRESS = r"https?:\s*//\S+$|www\.\S+$|doi\.org/\S+$"


@rule("BB04", f"SELECT doc_id, number FROM bib WHERE NOT regexp_matches(trim(entry), '\\.$|{_ADDRESS}')")
def final_dots(c: Corpus) -> DataFrame:
    """Entries that end neither in a dot nor in an address."""
    return c.bibliography.where(~F.trim("entry").rlike(r"\.$|" + _ADDRESS)).select("doc_id", "number")


@rule("BB05", f"SELECT doc_id, number, type, CASE WHEN type = 'book' THEN NULL ELSE coalesce(journal, CASE WHEN type IN ('article', 'online') THEN publisher END) END AS journal FROM {FIELDS}")
def entry_types(c: Corpus) -> DataFrame:
    """BibTeX types; an article's or a page's publisher is its journal where it has none."""
    moved = F.coalesce("journal", F.when(F.col("type").isin("article", "online"), F.col("publisher")))
    return typed(c).select("doc_id", "number", "type", F.when(F.col("type") == "book", None).otherwise(moved).alias("journal"))


_PLACE = r"(^|[^\w])(art(icle)?\.?|pp?\.)\s*\d+|(^|[^\w])\d+:\d+($|[^\w])|(^|[^\w])volume\s+\d+|arxiv|preprint|zenodo|biorxiv"
_BOOKISH = "handbook|synthesis|monograph|textbook|edition|podręcznik|monografia|kompendium"
_WHOLE = "NOT (type <> 'online' AND (author IS NULL OR date IS NULL))"
_MISSING = (
    ("MISSING_OBLIGATORY", "type <> 'online' AND (author IS NULL OR date IS NULL)"), ("MISSING_PUBLISHER", f"{_WHOLE} AND type = 'book' AND publisher IS NULL"),
    ("MISSING_ONLINE", "type = 'online' AND access IS NULL AND (date IS NULL OR contains(lower(entry), 'wiki'))"), ("MISSING_ARTICLE_OR_BOOK", "type = 'online' AND url IS NULL AND doi IS NULL AND publisher IS NULL"),
    ("MISSING_PAGES", f"{_WHOLE} AND journal IS NOT NULL AND type IS NOT NULL AND NOT MATCHES(journal, '{_BOOKISH}') AND pages IS NULL AND NOT MATCHES(lower(entry), '{_PLACE}')"),
    ("NO_ACCESS_DATE_OR_DOI", f"{_WHOLE} AND url IS NOT NULL AND doi IS NULL AND access IS NULL AND type <> 'online'"),
)


@rule("BB07", " UNION ALL ".join(f"SELECT doc_id, number, '{k}' AS problem FROM {FIELDS} WHERE type IS NOT NULL AND {w.replace('MATCHES', 'regexp_matches')}" for k, w in _MISSING))
def missing_fields(c: Corpus) -> DataFrame:
    """What an entry of its type lacks: one scan, one row for each. Without author or date nothing else is said of an entry."""
    quoted = lambda w: w.replace("\\", "\\\\").replace("MATCHES", "regexp_like")
    problems = F.array_compact(F.array(*(F.when(F.expr(quoted(w)), k) for k, w in _MISSING)))
    return typed(c).where("type is not null").select("doc_id", "number", F.explode(problems).alias("problem"))


# Date formats that count as one.
SAME_DATES = (("(yyyy)", "yyyy"), ("dd mon yyyy", "dd mies. yyyy"), ("mon yyyy", "mies. yyyy"), ("yyyy-mm-dd", "yyyy.mm.dd", "yyyy/mm/dd"), ("dd month yyyy", "dd miesiąc yyyy"), ("dd.mm.yyyy", "dd/mm/yyyy", "dd-mm-yyyy"))
_GROUP = "CASE " + " ".join(f"WHEN lower({{x}}) IN {g} THEN '{g[0]}'" for g in SAME_DATES) + " ELSE lower({x}) END"
_ORDER = ("author", "journal", "volume", "pages", "publisher", "url", "access", "date")
_ORDERED = "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"CASE WHEN length({n}) >= 4 AND strpos(entry, {n}) > 0 THEN {{'at': strpos(entry, {n}), 'name': '{n}'}} END" for n in _ORDER) + "], lambda x: x IS NOT NULL)), lambda x: x['name']), ',')"
_WITH_ORDER = f"(SELECT *, nullif({_ORDERED}, '') AS field_order FROM {FIELDS})"
_DOMINANT = "(SELECT doc_id, type, arg_min({v}, (-n, first)) AS main FROM (SELECT doc_id, type, {v}, count(*) AS n, min(number) AS first FROM {f} WHERE {v} IS NOT NULL GROUP BY ALL) GROUP BY doc_id, type)"
_KINDS = (
    ("SEPARATOR_COHERENCE", "separator", "f.separator <> d.main"),
    ("AUTHOR_FORMAT_COHERENCE", "author_format", "f.author_format <> d.main AND f.author_format <> 'Jan Nowak' AND NOT (d.main = 'Jan Nowak' AND f.author_format IN ('Nowak J.', 'Nowak, J.'))"),
    ("DATE_FORMAT_COHERENCE", "date_format", _GROUP.format(x="f.date_format") + " <> " + _GROUP.format(x="d.main")),
)
_COMMON = "list_filter(string_split({a}, ','), lambda x: list_contains(string_split({b}, ','), x))"


@rule("BB08", " UNION ALL ".join(f"SELECT f.doc_id, f.number, '{k}' AS problem, f.{v} AS found, d.main AS expected FROM {_WITH_ORDER} f JOIN {_DOMINANT.format(v=v, f=_WITH_ORDER)} d ON d.doc_id = f.doc_id AND d.type IS NOT DISTINCT FROM f.type WHERE {w}" for k, v, w in _KINDS) + f" UNION ALL SELECT f.doc_id, f.number, 'WRONG_ORDER_ISO', f.field_order, d.main FROM {_WITH_ORDER} f JOIN {_DOMINANT.format(v='field_order', f=_WITH_ORDER)} d ON d.doc_id = f.doc_id AND d.type IS NOT DISTINCT FROM f.type WHERE {_COMMON.format(a='f.field_order', b='d.main')} <> {_COMMON.format(a='d.main', b='f.field_order')}")
def coherence(c: Corpus) -> DataFrame:
    """Entries whose separator, form of names or of dates, or order of fields isn't the most frequent one of the document's entries of their type; the first wins ties."""
    f, out = ordered_fields(c), None
    both = f.select("doc_id", "number", "type", *(v for _, v, _ in _KINDS), "field_order")
    for k, v, test in (*_KINDS, ("WRONG_ORDER_ISO", "field_order", None)):
        main = dominant(both.where(F.col(v).isNotNull()), ["doc_id", "type"], v, ["number"], "main").select(F.col("doc_id").alias("d_id"), F.col("type").alias("d_type"), "main")
        j = both.alias("f").join(main.alias("d"), (F.col("f.doc_id") == F.col("d.d_id")) & F.col("f.type").eqNullSafe(F.col("d.d_type")))
        if test is None:
            common = lambda a, b: F.filter(F.split(a, ","), lambda x: F.array_contains(F.split(b, ","), x))
            bad = j.where(common(F.col("field_order"), F.col("main")) != common(F.col("main"), F.col("field_order")))
        else:
            bad = j.where(F.expr(test))
        bad = bad.select("doc_id", "number", F.lit(k).alias("problem"), F.col(v).alias("found"), F.col("main").alias("expected"))
        out = bad if out is None else out.unionByName(bad)
    return out


def ordered_fields(c: Corpus) -> DataFrame:
    at = [F.when((F.length(n) >= 4) & (F.instr("entry", F.col(n)) > 0), F.struct(F.instr("entry", F.col(n)).alias("at"), F.lit(n).alias("name"))) for n in _ORDER]
    order = F.array_join(F.transform(F.array_sort(F.array_compact(F.array(*at))), lambda s: s["name"]), ",")
    return fields(c).withColumn("field_order", F.nullif(order, F.lit("")))


@rule("BB09", f"SELECT doc_id, number, field_order FROM {_WITH_ORDER}")
def field_order(c: Corpus) -> DataFrame:
    """Names of the fields of four characters or more in the order of their first position."""
    return ordered_fields(c).select("doc_id", "number", "field_order")


# ---- scoring ---------------------------------------------------------------------------------


@rule("LM01", "SELECT doc_id, string_agg(content, chr(10) ORDER BY block_id) AS plain FROM placed WHERE n_words >= 6 GROUP BY doc_id")
def plain_text(c: Corpus) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "content"))), lambda s: s["content"]), "\n")
    return c.placed.where("n_words >= 6").groupBy("doc_id").agg(text.alias("plain"))


@rule("LM04", "SELECT doc_id, number, title, level, s.start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number, lower(title) ORDER BY seq DESC) AS r FROM sections) s WHERE r = 1 AND contains(number, '.')")
def subsections(c: Corpus) -> DataFrame:
    """Numbered subsections; of equal headings the last."""
    key = F.concat_ws(" ", "number", F.lower("title"))
    return K.latest_per_key(c.sections, key, "seq").where(F.contains("number", F.lit("."))).select("doc_id", "number", "title", "level", "start")


@rule("LM08", """SELECT label, round(0.6 * grade + 0.2 * purpose + 0.2 * sota, 4) AS overall FROM (SELECT label, 100.0 - 100.0 * count(*) FILTER (cosine < 0.785) / count(*) AS grade, CASE WHEN count(*) % 2 = 0 THEN 100 ELSE 50 END AS purpose, CASE WHEN label % 3 = 0 THEN 100 WHEN label % 3 = 1 THEN 50 ELSE 0 END AS sota
    FROM (SELECT e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.v AS DOUBLE[])), 6) AS cosine FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) p USING (label)) GROUP BY label)""")
def overall(c: Corpus) -> DataFrame:
    """0.6 similarity + 0.2 purpose + 0.2 state of the art; the two model scores are stand-ins from the label."""
    from quire.plans.catalog import grades

    g = grades(c)
    purpose = F.when(F.col("n") % 2 == 0, 100).otherwise(50)
    sota = F.when(F.col("label") % 3 == 0, 100).when(F.col("label") % 3 == 1, 50).otherwise(0)
    exact = 100.0 - 100.0 * F.col("below") / F.col("n")
    return g.select("label", F.round(0.6 * exact + 0.2 * purpose + 0.2 * sota, 4).alias("overall"))


@rule("LM09", "SELECT doc_id, coalesce(min(seq) FILTER (named), arg_min(seq, (-citations, seq)) FILTER (citations > 0)) AS seq, CASE WHEN bool_or(named) THEN 'title' ELSE 'citations' END AS chosen_by FROM {art} GROUP BY doc_id HAVING bool_or(named) OR max(citations) > 0")
def state_of_the_art(c: Corpus, judged: DataFrame | None = None) -> DataFrame:
    """The section on the state of the art: by title, else by a model's answers about the three candidates, else the one with the most citations.

    judged: (doc_id, seq, score, is_art) with scores up to 100, as a model gave them for ``catalog.top_sections``. Of those of 90 or
    more, one of 100 wins, then the one with the most citations.
    """
    from quire.plans.catalog import art_candidates

    s = art_candidates(c)
    order = lambda: F.struct((-F.col("citations")).alias("n"), "seq")
    out = s.groupBy("doc_id").agg(F.min(F.when(F.col("named"), F.col("seq"))).alias("titled"), F.min_by("seq", F.when(F.col("citations") > 0, order())).alias("cited"), F.max("citations").alias("most"))
    if judged is None:
        out = out.withColumn("asked", F.lit(None).cast("int"))
    else:
        sure = s.join(judged.where("is_art and score >= 90"), ["doc_id", "seq"]).withColumn("best", F.when(F.col("score") == 100, F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), "seq")).otherwise(F.struct(F.lit(1).alias("k"), (-F.col("citations")).alias("n"), "seq")))
        out = out.join(sure.groupBy("doc_id").agg(F.min("best")["seq"].alias("asked")), "doc_id", "left")
    cited = F.when(F.col("most") > 0, F.col("cited"))
    out = out.withColumn("seq", F.coalesce("titled", "asked", cited)).where("seq is not null")
    by = F.when(F.col("titled").isNotNull(), "title").when(F.col("asked").isNotNull(), "model").otherwise("citations")
    return out.select("doc_id", "seq", by.alias("chosen_by"))


@rule("ST01", f"SELECT category, count(*) AS n FROM (SELECT {as_finding('page_format', page='page')} FROM sheets WHERE NOT ((abs(width - 595) <= 10 AND abs(height - 842) <= 10) OR (abs(width - 842) <= 10 AND abs(height - 595) <= 10)) UNION ALL SELECT {as_finding('orientation', page='page')} FROM sheets WHERE height < width UNION ALL SELECT {as_finding('raster_image', page='page')} FROM visuals WHERE kind = 'image' AND image_type = 'raster') GROUP BY category")
def all_findings(c: Corpus) -> DataFrame:
    """The union of several rules' findings, counted by category."""
    f = wrong_format(c).unionByName(wrong_orientation(c)).unionByName(raster(c))
    return f.groupBy("category").agg(F.count("*").alias("n"))


def complete_sql() -> None:
    """Puts the SQL for matches with offsets where a statement asks for it."""
    import re

    from quire.plans.oracles import _spans

    from quire.plans.catalog import ART_TITLES, OTHER_CHAPTERS
    from quire.plans.oracles import _any

    personal = f"(SELECT 1 FROM (SELECT unnest(regexp_extract_all(content, '[^.!?]+[.!?]+')) AS s FROM blocks) WHERE length(s) >= 15 AND regexp_matches(lower(s), '{FIRST_PERSON}'))"
    art = f"(SELECT *, {_any('lower(title)', ART_TITLES['en'])} AS named FROM section_cites WHERE n_chars >= 200 AND NOT {_any('lower(title)', OTHER_CHAPTERS['en'])})"
    patterns = {**DASHES, "hyphen_plain": r"\s-\s|\s-(?:[^\d\s]|$)|-\s", "comma": r"[0-9]+,(?:[0-9]{4,}|[0-9]{1,2})(?:[^0-9]|$)", "quotes": QUOTED, "number": r"[0-9]+[.,][0-9]+", "numeric": r"\[[0-9 ,\-]*[0-9][0-9 ,\-]*\]"}
    for k, v in ORACLES.items():
        v = v.replace("{spans}", _spans("[0-9A-Za-z.]+")).replace("{art}", art).replace("{quoted}", QUOTED.replace("'", "''")).replace("{personal}", personal).replace("{bibtex}", f"({ORACLES['BB06']})")
        ORACLES[k] = re.sub(r"\{spans:(\w+)\}", lambda m: _spans(patterns[m[1]]), v)
