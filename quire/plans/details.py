"""Further rules: sources and sinks as plans, smaller joins and aggregates, and model-backed rules with plain stand-ins.

Where a model would answer, ``quire.plans.models`` gives its interface; the queries here use stand-ins
that SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.values import cosine, dominant, inside, intersect
from quire.operators import checks as K
from quire.plans import rules as R
from quire.plans import scalars as S
from quire.plans.rules import FIELDS, TYPE, as_finding, finding, rule
from quire.sources.corpus import Corpus, block_window, doc_window


def _captions(c: Corpus) -> DataFrame:
    from quire.plans.catalog import captions

    return captions(c)


# ---- sources and sinks -----------------------------------------------------------------------


@rule("SRC03", "SELECT doc_id, page, block_id, word_index, text FROM words")
def layout_json(c: Corpus) -> DataFrame:
    """Pages written as nested JSON and read back with a schema: the layout reader's path."""
    from quire.sources.layout import from_json_text, to_json_text

    return from_json_text(to_json_text(c.words)).select("doc_id", "page", "block_id", "word_index", "text")


_CELLS = "SELECT doc_id, block_id, string_split(content, '|') AS cells FROM blocks WHERE contains(content, '|')"


@rule("SRC05", f"""SELECT doc_id, n_rows, n_cols, fill, mean_chars FROM (SELECT doc_id, count(DISTINCT block_id) AS n_rows, max(n) AS n_cols, round(count(*) FILTER (trim(cell) <> '') / count(*), 6) AS fill, round(avg(length(trim(cell))), 6) AS mean_chars
    FROM (SELECT doc_id, block_id, len(cells) AS n, unnest(cells) AS cell FROM ({_CELLS})) GROUP BY doc_id) WHERE n_cols >= 2 AND fill >= 0.2 AND NOT (fill < 0.5 AND mean_chars < 8)""")
def ruled_tables(c: Corpus) -> DataFrame:
    """Rows of cells between bars as one table a document: at least two columns, filled well enough."""
    cells = c.blocks.where(F.contains("content", F.lit("|"))).select("doc_id", "block_id", F.split("content", r"\|", -1).alias("cells"))
    cells = cells.select("doc_id", "block_id", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    full = F.count(F.when(F.trim("cell") != "", 1))
    t = cells.groupBy("doc_id").agg(F.countDistinct("block_id").alias("n_rows"), F.max("n").alias("n_cols"), F.round(full / F.count("*"), 6).alias("fill"), F.round(F.avg(F.length(F.trim("cell"))), 6).alias("mean_chars"))
    return t.where("n_cols >= 2 and fill >= 0.2 and not (fill < 0.5 and mean_chars < 8)")


@rule("SRC08", "SELECT doc_id, page FROM visuals v WHERE kind = 'image' AND image_type = 'raster' AND (vx1 - vx0) / (vy1 - vy0) BETWEEN 0.15 AND 15 AND (SELECT count(*) FROM lines l WHERE l.doc_id = v.doc_id AND l.page = v.page AND l.x0 >= vx0 - 40 AND l.x1 <= vx1 + 40 AND l.y0 >= vy0 AND l.y1 <= vy1) < 3")
def raster_images(c: Corpus) -> DataFrame:
    """Raster figures of a usual shape that aren't the background of three lines of text."""
    v = c.visuals.where("kind = 'image' and image_type = 'raster' and (vx1 - vx0) / (vy1 - vy0) between 0.15 and 15")
    lines = c.lines.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "x0", "y0", "x1", "y1")
    within = (F.col("x0") >= F.col("vx0") - 40) & (F.col("x1") <= F.col("vx1") + 40) & (F.col("y0") >= F.col("vy0")) & (F.col("y1") <= F.col("vy1"))
    j = v.join(lines, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & within, "left")
    return j.groupBy("doc_id", "page").agg(F.count("d").alias("n")).where("n < 3").select("doc_id", "page")


@rule("SRC11", "SELECT doc_id, seq, number, title, page, src_page FROM tof")
def figure_list(c: Corpus) -> DataFrame:
    return c.tof.select("doc_id", "seq", "number", "title", "page", "src_page")


@rule("SRC12", "SELECT doc_id, seq, number, title, page, src_page FROM tot")
def table_list(c: Corpus) -> DataFrame:
    return c.tot.select("doc_id", "seq", "number", "title", "page", "src_page")


@rule("SRC06", """SELECT doc_id, min(block_id) AS block_id, count(*) FILTER (NOT continued) AS n_rows, count(*) FILTER (continued) AS n_continued FROM (SELECT doc_id, block_id, regexp_matches(content, '^ *[|]') AS continued, r - row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS g FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS r FROM blocks) WHERE contains(content, '|')) GROUP BY doc_id, g""")
def cell_tables(c: Corpus) -> DataFrame:
    """Runs of blocks with cells as tables; a row with a blank first cell continues the row above."""
    b = c.blocks.withColumn("r", F.row_number().over(doc_window().orderBy("block_id"))).where(F.contains("content", F.lit("|")))
    b = b.withColumn("g", F.col("r") - F.row_number().over(doc_window().orderBy("block_id")))
    more = F.col("content").rlike("^ *[|]")
    return b.groupBy("doc_id", "g").agg(F.min("block_id").alias("block_id"), F.count(F.when(~more, 1)).alias("n_rows"), F.count(F.when(more, 1)).alias("n_continued")).drop("g")


@rule("SRC07", "SELECT doc_id, block_id, content FROM captions c WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = c.doc_id AND b.block_id BETWEEN c.block_id + 1 AND c.block_id + 3 AND contains(b.content, '|'))")
def lineless_tables(c: Corpus) -> DataFrame:
    """Table captions that no cells follow within three blocks."""
    cells = c.blocks.where(F.contains("content", F.lit("|"))).select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"))
    near = (F.col("doc_id") == F.col("d")) & F.col("b").between(F.col("block_id") + 1, F.col("block_id") + 3)
    return _captions(c).where("kind = 'table'").join(cells, near, "left_anti").select("doc_id", "block_id", "content")


@rule("SRC13", "SELECT doc_id, 'paragraph' AS kind, block_id AS id FROM placed WHERE n_words >= 6 UNION ALL SELECT doc_id, 'image', page FROM visuals WHERE kind = 'image'")
def minimal_scan(c: Corpus) -> DataFrame:
    p = c.placed.where("n_words >= 6").select("doc_id", F.lit("paragraph").alias("kind"), F.col("block_id").alias("id"))
    return p.unionByName(c.visuals.where("kind = 'image'").select("doc_id", "kind", F.col("page").alias("id")))


@rule("SRC20", f"""SELECT doc_id, block_id, CASE WHEN regexp_matches(lower(content), '^(keywords|key words|słowa kluczowe)') THEN 'keywords' WHEN regexp_matches(trim(content), '{S.ACRONYM_LINE}') THEN 'acronyms' WHEN regexp_matches(content, '\\.{{4,}} *[0-9]+$') THEN 'toc'
    WHEN regexp_matches(content, '^(?:Figure|Fig\\.|Rys\\.) ?[0-9]') THEN 'image_description' WHEN regexp_matches(content, '^(?:Table|Tabela) ?[0-9]') THEN 'table_description' WHEN regexp_matches(content, '^([-–—•] |[0-9]{{1,3}}\\) |[a-z]\\) |\\[[0-9]+\\] )') THEN 'list' WHEN n_words < 6 THEN 'heading' ELSE 'paragraph' END AS type FROM placed""")
def logical_blocks(c: Corpus) -> DataFrame:
    """The logical type of each block; the first test that holds decides."""
    t = F.col("content")
    kind = F.when(S.is_keywords(t), "keywords").when(S.is_acronym_line(t), "acronyms").when(S.is_toc_line(t), "toc").when(t.rlike(r"^(?:Figure|Fig\.|Rys\.) ?[0-9]"), "image_description")
    kind = kind.when(t.rlike(r"^(?:Table|Tabela) ?[0-9]"), "table_description").when(t.rlike(r"^([-–—•] |[0-9]{1,3}\) |[a-z]\) |\[[0-9]+\] )"), "list")
    return c.placed.select("doc_id", "block_id", kind.when(F.col("n_words") < 6, "heading").otherwise("paragraph").alias("type"))


@rule("SNK02", "SELECT vec_id, printf('section %d: COSINE_SIMILARITY: %.6f', vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)), 6)) AS line FROM embeddings")
def report_lines(c: Corpus) -> DataFrame:
    from quire.plans.catalog import purpose_similarity

    return purpose_similarity(c).select("vec_id", F.format_string("section %d: COSINE_SIMILARITY: %.6f", "vec_id", "cosine").alias("line"))


@rule("SNK03", f"SELECT doc_id, category, page, CASE WHEN x1 > x0 THEN 'highlight' ELSE 'note' END AS mark FROM (SELECT f.*, b.x0, b.x1 FROM (SELECT {as_finding('bastard', 'block_id', 'page')} FROM ({R._PARTS}) WHERE a < z AND page = z AND n_lines <= 2 UNION ALL SELECT {as_finding('page_format', page='page')} FROM sheets WHERE height < width) f LEFT JOIN boxes b ON b.doc_id = f.doc_id AND b.block_id = f.block_id AND b.page = f.page)")
def annotations(c: Corpus) -> DataFrame:
    """Marks for findings: a highlight where there is a box, else a note."""
    f = R.bastards(c).unionByName(R.wrong_orientation(c).withColumn("category", F.lit("page_format")))
    j = f.join(c.boxes.select("doc_id", "block_id", "page", "x0", "x1"), ["doc_id", "block_id", "page"], "left")
    return j.select("doc_id", "category", "page", F.when(F.col("x1") > F.col("x0"), "highlight").otherwise("note").alias("mark"))


@rule("SNK06", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 2 = 1")
def index(c: Corpus) -> DataFrame:
    """A document index: of the stored even ids each 7th is deleted, then absent ids are inserted."""
    from quire.sources.index import delete, insert_absent

    stored = c.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("state"))
    kept = delete(stored, c.documents.where("doc_id % 7 = 0"), "doc_id")
    return insert_absent(kept, c.documents.where("doc_id % 2 = 1 or doc_id % 7 <> 0").select("doc_id", F.lit("new").alias("state")), "doc_id")


@rule("SRC18", "SELECT doc_id, count(*) AS n FROM tokens WHERE lower(text) IN ('the', 'of', 'and', 'le', 'de', 'der', 'die', 'los', 'las') GROUP BY doc_id")
def whitelisted(c: Corpus, path: str | None = None) -> DataFrame:
    """Words of a list: a text file with a word a line, or a few words; Spark broadcasts the list where its size allows."""
    few = c.spark.range(1).select(F.explode(F.array(*map(F.lit, ("the", "of", "and", "le", "de", "der", "die", "los", "las")))).alias("w"))
    words = few if path is None else c.spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct()
    return c.tokens.join(words, F.lower("text") == F.col("w"), "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


_JSON = """'{"doc_id":' || doc_id || ',"category":"' || category || '"' || coalesce(',"block_id":' || block_id, '') || coalesce(',"page":' || page, '') || coalesce(',"text":' || to_json(text), '') || '}'"""
_SOME = f"(SELECT {as_finding('orientation', page='page')} FROM sheets WHERE height < width UNION ALL SELECT {as_finding('raster_image', page='page')} FROM visuals WHERE kind = 'image' AND image_type = 'raster' UNION ALL SELECT {as_finding('bastard', 'block_id', 'page')} FROM ({R._PARTS}) WHERE a < z AND page = z AND n_lines <= 2 UNION ALL SELECT {as_finding('widow', 'block_id', text='text')} FROM ({R._WIDOW}) WHERE ls[-1] <> ls[-2] OR ls[-2] <> ls[-3])"


def some_findings(c: Corpus) -> DataFrame:
    """Findings on pages, blocks and words."""
    return R.wrong_orientation(c).unionByName(R.raster(c)).unionByName(R.bastards(c)).unionByName(R.widows(c))


@rule("SNK01", f"SELECT {_JSON} AS json FROM {_SOME}")
def findings_json(c: Corpus) -> DataFrame:
    """A JSON object for each finding; what it lacks is left out."""
    return some_findings(c).select(F.to_json(F.struct("doc_id", "category", "block_id", "page", "text")).alias("json"))


# ---- scalars ---------------------------------------------------------------------------------


_COMPOSED = S.LATEX[:16]


def _composed_sql(x: str) -> str:
    for a, b in _COMPOSED:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@rule("SCL02", f"SELECT doc_id, block_id, regexp_replace({_composed_sql('content')}, ' ([ąĄęĘ])', '\\1', 'g') AS joined FROM blocks")
def joined_spans(c: Corpus) -> DataFrame:
    """Spacing diacritics composed with the letter behind them, and parts that begin with an ogonek letter glued to the part before."""
    t = F.col("content")
    for a, b in _COMPOSED:
        t = F.replace(t, F.lit(a), F.lit(b))
    return c.blocks.select("doc_id", "block_id", F.regexp_replace(t, " ([ąĄęĘ])", "$1").alias("joined"))


@rule("SCL18", "SELECT doc_id, block_id, page, line FROM (SELECT *, lag(x0) OVER (PARTITION BY doc_id, page ORDER BY line) AS px FROM lines) WHERE abs(x0 - px) < 10 OR x0 > px")
def continuations(c: Corpus) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    return c.lines.withColumn("px", F.lag("x0").over(w)).where((F.abs(F.col("x0") - F.col("px")) < 10) | (F.col("x0") > F.col("px"))).select("doc_id", "block_id", "page", "line")


@rule("SCL19", "SELECT b.doc_id, b.page, count(*) AS n FROM boxes b JOIN visuals v ON v.doc_id = b.doc_id AND v.page = b.page WHERE b.x0 >= vx0 - 10 AND b.y0 >= vy0 - 10 AND b.x1 <= vx1 + 10 AND b.y1 <= vy1 + 10 GROUP BY ALL")
def contained(c: Corpus) -> DataFrame:
    v = c.visuals.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "vx0", "vy0", "vx1", "vy1")
    box = inside(*(F.col(x) for x in ("x0", "y0", "x1", "y1", "vx0", "vy0", "vx1", "vy1")), 10.0)
    return c.boxes.join(v, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & box).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@rule("SCL20", "SELECT b.doc_id, b.block_id, b.page FROM boxes b JOIN visuals v ON v.doc_id = b.doc_id AND v.page = b.page WHERE b.x0 <= vx1 AND b.x1 >= vx0 AND b.y0 <= vy1 AND b.y1 >= vy0")
def meeting(c: Corpus) -> DataFrame:
    v = c.visuals.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "vx0", "vy0", "vx1", "vy1")
    box = intersect(*(F.col(x) for x in ("x0", "y0", "x1", "y1", "vx0", "vy0", "vx1", "vy1")))
    return c.boxes.join(v, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & box).select("doc_id", "block_id", "page")


@rule("SCL21", f"SELECT doc_id, block_id, CASE WHEN regexp_matches(lower(content), '{S.POLISH}') THEN 'pl' ELSE 'en' END AS language FROM blocks")
def language(c: Corpus) -> DataFrame:
    return c.blocks.select("doc_id", "block_id", F.when(S.is_polish(F.col("content")), "pl").otherwise("en").alias("language"))


_DICTIONARY = "(SELECT w FROM (SELECT DISTINCT doc_id, lower(text) AS w FROM tokens) GROUP BY w HAVING count(*) >= 3)"


def dictionary(c: Corpus) -> DataFrame:
    """Words that three documents have."""
    return c.tokens.select("doc_id", F.lower("text").alias("w")).distinct().groupBy("w").agg(F.count("*").alias("n")).where("n >= 3").select("w")


@rule("SCL23", f"SELECT doc_id, count(*) AS unknown FROM tokens WHERE lower(text) NOT IN {_DICTIONARY} GROUP BY doc_id")
def unknown_words(c: Corpus) -> DataFrame:
    return c.tokens.withColumn("w", F.lower("text")).join(dictionary(c), "w", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))


@rule("SCL24", """SELECT doc_id, block_id, regexp_replace(regexp_replace(s, '[()\\[\\]]', chr(1), 'g'), '\\x01+', ' ', 'g') AS bare FROM (WITH RECURSIVE r AS (SELECT doc_id, block_id, content AS s FROM blocks WHERE regexp_matches(content, '[()\\[\\]]')
    UNION ALL SELECT doc_id, block_id, regexp_replace(s, '[(\\[][^()\\[\\]]*[)\\]]', chr(1), 'g') FROM r WHERE regexp_matches(s, '[(\\[][^()\\[\\]]*[)\\]]')) SELECT * FROM r WHERE NOT regexp_matches(s, '[(\\[][^()\\[\\]]*[)\\]]'))""")
def without_brackets(c: Corpus) -> DataFrame:
    from quire.plans.models import bare

    b = c.blocks.where(F.col("content").rlike(r"[()\[\]]"))
    return b.select("doc_id", "block_id", bare(F.col("content"))["text"].alias("bare"))


@rule("SCL30", "SELECT doc_id, block_id, acronym, upper(array_to_string(list_transform(list_filter(string_split(before, ' '), lambda w: w <> ''), lambda w: w[1]), '')) AS initials FROM (SELECT doc_id, block_id, regexp_extract(content, '\\(([A-Z]{2,10})\\)', 1) AS acronym, regexp_extract(content, '^(.*) \\([A-Z]{2,10}\\)', 1) AS before FROM blocks WHERE regexp_matches(content, '^.+ \\([A-Z]{2,10}\\)'))")
def initials(c: Corpus) -> DataFrame:
    b = c.blocks.where(F.col("content").rlike(r"^.+ \([A-Z]{2,10}\)"))
    words = F.filter(F.split(F.regexp_extract("content", r"^(.*) \([A-Z]{2,10}\)", 1), " ", -1), lambda w: w != "")
    return b.select("doc_id", "block_id", F.regexp_extract("content", r"\(([A-Z]{2,10})\)", 1).alias("acronym"), F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).alias("initials"))


@rule("SCL31", "SELECT doc_id, block_id, CASE WHEN regexp_matches(content, ';$') THEN 'semicolon' WHEN regexp_matches(content, '\\.$') THEN 'dot' WHEN regexp_matches(content, ',$') THEN 'comma' ELSE 'none' END AS ending, regexp_matches(content, '^[-–—a-z)]+ \\p{Lu}') AS upper FROM blocks WHERE regexp_matches(content, '^([-–—]|[a-z]\\)) ')")
def item_endings(c: Corpus) -> DataFrame:
    t = F.col("content")
    end = F.when(t.rlike(";$"), "semicolon").when(t.rlike(r"\.$"), "dot").when(t.rlike(",$"), "comma").otherwise("none")
    return c.blocks.where(t.rlike(r"^([-–—]|[a-z]\)) ")).select("doc_id", "block_id", end.alias("ending"), t.rlike(r"^[-–—a-z)]+ \p{Lu}").alias("upper"))


@rule("SCL41", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 50 WHEN doc_id % 4 = 0 THEN 100 ELSE 0 END AS score FROM documents")
def reply_scores(c: Corpus) -> DataFrame:
    """Scores of model replies: clean JSON, JSON inside prose, a score out of range, and none."""
    replies = F.array(*map(F.lit, ('{"score": 100, "label": "yes"}', 'Sure! {"score": 50, "reason": "partly"} Done.', '{"score": 70}', "no idea")))
    return c.documents.select("doc_id", S.parsed_score(F.element_at(replies, (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))).alias("score"))


@rule("SCL46", "SELECT doc_id, block_id FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY block_id) AS before FROM placed) WHERE n_words >= 3 AND NOT contains(content, '....') AND (before IS NULL OR NOT regexp_matches(before, ':$')) AND length(regexp_replace(content, '[^\\p{L}]', '', 'g')) >= 15")
def sentence_guards(c: Corpus) -> DataFrame:
    b = c.placed.withColumn("before", F.lag("content").over(doc_window().orderBy("block_id")))
    ok = (F.col("n_words") >= 3) & ~F.contains("content", F.lit("....")) & (F.col("before").isNull() | ~F.col("before").rlike(":$"))
    return b.where(ok & (F.length(F.regexp_replace("content", r"[^\p{L}]", "")) >= 15)).select("doc_id", "block_id")


@rule("SCL47", "SELECT doc_id, count(*) AS n FROM tokens t WHERE regexp_matches(text, '^\\p{Lu}\\p{Ll}+$') AND word_index > 0 AND EXISTS (SELECT 1 FROM words w WHERE w.doc_id = t.doc_id AND w.italic AND lower(w.text) = lower(t.text)) GROUP BY doc_id")
def proper_names(c: Corpus) -> DataFrame:
    """Capitalised words inside blocks that the document sets in italics somewhere."""
    names = c.words.where("italic").select("doc_id", F.lower("text").alias("w"))
    t = c.tokens.where(F.col("text").rlike(r"^\p{Lu}\p{Ll}+$") & (F.col("word_index") > 0)).withColumn("w", F.lower("text"))
    return t.join(names, ["doc_id", "w"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


# ---- joins -----------------------------------------------------------------------------------


@rule("JN13", "SELECT doc_id, block_id, page FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM visuals v WHERE v.kind = 'table' AND v.doc_id = b.doc_id AND v.page = b.page AND round(greatest(0, least(x1, vx1 + 5) - greatest(x0, vx0 - 5)) * greatest(0, least(y1, vy1 + 5) - greatest(y0, vy0 - 5)) / ((x1 - x0) * (y1 - y0)), 6) > 0.8)")
def outside_tables(c: Corpus) -> DataFrame:
    return c.boxes.select("doc_id", "block_id", "page").join(K.mostly_inside(c.boxes, c.visuals), ["doc_id", "block_id", "page"], "left_anti")


@rule("JN15", "SELECT m.doc_id, m.block_id, page, count(*) AS n FROM cites m JOIN boxes b USING (doc_id, block_id) GROUP BY ALL")
def owned(c: Corpus) -> DataFrame:
    return K.cited(c.blocks).join(c.boxes.select("doc_id", "block_id", "page"), ["doc_id", "block_id"]).groupBy("doc_id", "block_id", "page").agg(F.count("*").alias("n"))


@rule("JN16", "SELECT doc_id, acronym FROM uses u WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = u.doc_id AND w.italic AND lower(w.text) = lower(u.acronym))")
def not_proper(c: Corpus) -> DataFrame:
    from quire.plans.catalog import uses

    names = c.words.where("italic").select("doc_id", F.lower("text").alias("w"))
    return uses(c).withColumn("w", F.lower("acronym")).join(names, ["doc_id", "w"], "left_anti").select("doc_id", "acronym")


@rule("JN17", "SELECT doc_id, number, max(block_id) AS block_id FROM bib GROUP BY ALL")
def owning_blocks(c: Corpus) -> DataFrame:
    """The block of each entry number; the last wins where numbers repeat."""
    return c.bibliography.groupBy("doc_id", "number").agg(F.max("block_id").alias("block_id"))


@rule("JN23", "SELECT v.doc_id, v.page, coalesce(m.dpi, CAST(trunc(px_width / 6) AS INTEGER)) AS dpi FROM visuals v LEFT JOIN (SELECT px_width, max(px_width // 2) AS dpi FROM visuals WHERE image_type = 'raster' GROUP BY px_width) m USING (px_width)")
def looked_up(c: Corpus) -> DataFrame:
    known = c.visuals.where("image_type = 'raster'").groupBy("px_width").agg(F.max(F.floor(F.col("px_width") / 2)).cast("int").alias("dpi"))
    return c.visuals.join(known, "px_width", "left").select("doc_id", "page", F.coalesce("dpi", F.floor(F.col("px_width") / 6).cast("int")).alias("dpi"))


# ---- aggregates, windows, limits and sets ----------------------------------------------------


@rule("AG04", "SELECT doc_id, arg_min(s, (-n, first)) AS spacing FROM (SELECT doc_id, s, count(*) AS n, min((page, line)) AS first FROM (SELECT doc_id, page, line, round_even((y1 - lag(y1) OVER (PARTITION BY doc_id, block_id, page ORDER BY line)) / 12.0 / 1.2, 1) AS s FROM lines) WHERE s > 0.5 AND s < 3.0 GROUP BY ALL) GROUP BY doc_id")
def mode_spacing(c: Corpus) -> DataFrame:
    order = Window.partitionBy("doc_id", "block_id", "page").orderBy("line")
    s = c.lines.withColumn("s", F.bround((F.col("y1") - F.lag("y1").over(order)) / 12.0 / 1.2, 1)).where("s > 0.5 and s < 3.0")
    return dominant(s, ["doc_id"], "s", ["page", "line"], "spacing").drop("spacing_count")


@rule("AG06", "SELECT doc_id, count(*) AS n_pages, max(width) AS width, max(height) AS height, min(x0) AS left_margin FROM sheets GROUP BY doc_id")
def dimensions(c: Corpus) -> DataFrame:
    return c.pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("width").alias("width"), F.max("height").alias("height"), F.min("x0").alias("left_margin"))


@rule("AG08", f"SELECT type, arg_min(separator, (-n, first)) AS separator FROM (SELECT {TYPE} AS type, separator, count(*) AS n, min((doc_id, number)) AS first FROM {FIELDS} WHERE separator IS NOT NULL GROUP BY ALL) WHERE type IS NOT NULL GROUP BY type")
def separators(c: Corpus) -> DataFrame:
    t = R.typed(c).where("separator is not null and type is not null")
    return dominant(t, ["type"], "separator", ["doc_id", "number"], "sep").select("type", F.col("sep").alias("separator"))


@rule("AG09", f"SELECT doc_id, number, separator FROM {FIELDS}")
def item_separators(c: Corpus) -> DataFrame:
    return R.fields(c).select("doc_id", "number", "separator")


_CHUNKS = "(SELECT doc_id, i - 1 AS chunk, substr(text, CAST((i - 1) * 2500 + 1 AS BIGINT), 2500) AS piece FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 2500.0) AS BIGINT))) AS i FROM deco))"


def _marker_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in S.MARKERS) + " END"


_ITEMS = f"(SELECT *, r - row_number() OVER (PARTITION BY doc_id, marker ORDER BY block_id) AS g FROM (SELECT *, {_marker_sql('trim(content)')} AS marker, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS r FROM blocks) WHERE marker IS NOT NULL)"


def list_items(c: Corpus) -> DataFrame:
    """Items (doc_id, block_id, content, marker, list): blocks of one marker that follow each other are a list, named by its first block."""
    b = c.blocks.withColumn("marker", S.marker(F.col("content"))).withColumn("r", F.row_number().over(doc_window().orderBy("block_id"))).where("marker is not null")
    b = b.withColumn("g", F.col("r") - F.row_number().over(Window.partitionBy("doc_id", "marker").orderBy("block_id")))
    return b.withColumn("list", F.min("block_id").over(Window.partitionBy("doc_id", "marker", "g"))).select("doc_id", "block_id", "content", "marker", "list")


@rule("AG10", f"SELECT doc_id, list, arg_min(e, (-n, e)) AS ending, sum(n) AS items FROM (SELECT doc_id, list, substr(trim(content), -1) AS e, count(*) AS n FROM (SELECT *, min(block_id) OVER (PARTITION BY doc_id, marker, g) AS list FROM {_ITEMS}) GROUP BY ALL) GROUP BY doc_id, list")
def endings(c: Corpus) -> DataFrame:
    """The most frequent last character of each list's items; the smallest of equally frequent ones."""
    n = list_items(c).groupBy("doc_id", "list", F.right(F.trim("content"), F.lit(1)).alias("e")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id", "list").agg(F.min_by("e", F.struct((-F.col("n")).alias("n"), "e")).alias("ending"), F.sum("n").alias("items"))


@rule("LG01", f"""SELECT doc_id, block_id, contents, CASE WHEN regexp_matches(lower(contents), '{S.POLISH}') THEN 'pl' ELSE 'en' END AS language FROM (SELECT doc_id, list AS block_id, string_agg(content, ' ' ORDER BY block_id) AS contents, max(last) AS last FROM (SELECT i.doc_id, i.block_id, i.content, min(i.block_id) OVER (PARTITION BY i.doc_id, marker, g) AS list, last FROM {_ITEMS} i JOIN (SELECT doc_id, block_id, max(page) AS last FROM boxes GROUP BY ALL) p ON p.doc_id = i.doc_id AND p.block_id = i.block_id) GROUP BY doc_id, list
    UNION ALL SELECT b.doc_id, b.block_id, content, last FROM blocks b JOIN (SELECT doc_id, block_id, max(page) AS last FROM boxes GROUP BY ALL) p ON p.doc_id = b.doc_id AND p.block_id = b.block_id WHERE {_marker_sql('trim(content)')} IS NULL) WHERE last > 1""")
def contexts(c: Corpus) -> DataFrame:
    """Paragraphs and lists (their items joined) that end past the first two pages, with their language."""
    last = c.boxes.groupBy("doc_id", "block_id").agg(F.max("page").alias("last"))
    items = list_items(c).join(last, ["doc_id", "block_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "content"))), lambda s: s["content"]), " ")
    lists = items.groupBy("doc_id", "list").agg(text.alias("contents"), F.max("last").alias("last")).withColumnRenamed("list", "block_id")
    plain = c.blocks.where(S.marker(F.col("content")).isNull()).join(last, ["doc_id", "block_id"]).select("doc_id", "block_id", F.col("content").alias("contents"), "last")
    both = lists.unionByName(plain).where("last > 1")
    return both.select("doc_id", "block_id", "contents", F.when(S.is_polish(F.col("contents")), "pl").otherwise("en").alias("language"))


@rule("AG16", f"SELECT doc_id, CAST(bool_or(contains(lower(piece), 'section')) AS INTEGER) + CAST(bool_or(contains(lower(piece), 'results')) AS INTEGER) + CAST(bool_or(regexp_matches(piece, '\\[[0-9]')) AS INTEGER) AS points FROM {_CHUNKS} GROUP BY doc_id")
def points(c: Corpus) -> DataFrame:
    """Of three tests the number that holds in any chunk; patterns stand in for the model."""
    from quire.plans.catalog import chunked

    low = F.lower("piece")
    tests = (F.contains(low, F.lit("section")), F.contains(low, F.lit("results")), F.col("piece").rlike(r"\[[0-9]"))
    return chunked(c).groupBy("doc_id").agg(sum((F.max(t.cast("int")) for t in tests), F.lit(0)).alias("points"))


@rule("LM10", f"SELECT doc_id, chunk, contains(lower(piece), 'section') AS r1, contains(lower(piece), 'results') AS r2, regexp_matches(piece, '\\[[0-9]') AS r3 FROM {_CHUNKS}")
def chunk_rules(c: Corpus) -> DataFrame:
    from quire.plans.catalog import chunked

    low = F.lower("piece")
    return chunked(c).select("doc_id", "chunk", F.contains(low, F.lit("section")).alias("r1"), F.contains(low, F.lit("results")).alias("r2"), F.col("piece").rlike(r"\[[0-9]").alias("r3"))


@rule("AG23", f"SELECT doc_id, count(*) AS errors FROM (SELECT {as_finding('orientation', page='page')} FROM sheets WHERE height < width UNION ALL SELECT {as_finding('font_size', text='CAST(main_size AS VARCHAR)')} FROM main_size WHERE abs(main_size - 12.0) > 0.1) GROUP BY doc_id")
def error_counts(c: Corpus) -> DataFrame:
    return R.wrong_orientation(c).unionByName(R.font_size(c)).groupBy("doc_id").agg(F.count("*").alias("errors"))


@rule("WN05", "SELECT doc_id, page, line, CASE WHEN y0 - py > 18 THEN 'gap' ELSE 'indent' END AS reason FROM (SELECT *, lag(y1) OVER w AS py, lag(x0) OVER w AS px, lag(text) OVER w AS before FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)) WHERE regexp_matches(before, '[.!?:;]$') AND (y0 - py > 18 OR x0 - px > 20 OR n_words < 12)")
def breaks(c: Corpus) -> DataFrame:
    """Lines that begin a paragraph: a sentence ended before, and a gap, an indent or a short line follows."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    x = c.lines.withColumns({"py": F.lag("y1").over(w), "px": F.lag("x0").over(w), "before": F.lag("text").over(w)})
    gap = F.col("y0") - F.col("py") > 18
    x = x.where(F.col("before").rlike(r"[.!?:;]$") & (gap | (F.col("x0") - F.col("px") > 20) | (F.col("n_words") < 12)))
    return x.select("doc_id", "page", "line", F.when(gap, "gap").otherwise("indent").alias("reason"))


@rule("WN08", "SELECT doc_id, block_id, content || coalesce(' ' || nxt, '') AS caption FROM (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY block_id) AS nxt FROM blocks) WHERE regexp_matches(content, '^(?:Figure|Fig\\.|Rys\\.|Table|Tabela) ?[0-9]')")
def stitched_captions(c: Corpus) -> DataFrame:
    """Captions with the block that follows them."""
    b = c.blocks.withColumn("nxt", F.lead("content").over(doc_window().orderBy("block_id"))).where(F.col("content").rlike(r"^(?:Figure|Fig\.|Rys\.|Table|Tabela) ?[0-9]"))
    return b.select("doc_id", "block_id", F.concat("content", F.coalesce(F.concat(F.lit(" "), "nxt"), F.lit(""))).alias("caption"))


@rule("WN11", "SELECT doc_id, block_id FROM (SELECT *, max(CASE WHEN regexp_matches(lower(content), '^(acronyms|results|1\\.2 results)') THEN block_id END) OVER w AS a, max(CASE WHEN n_words < 6 AND NOT regexp_matches(lower(content), '^(acronyms|results|1\\.2 results)') THEN block_id END) OVER w AS z FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)) WHERE block_id > a AND (z IS NULL OR z < a)")
def acronym_region(c: Corpus) -> DataFrame:
    """Blocks behind a heading that opens a region, up to the next other heading."""
    order, opens = doc_window().orderBy("block_id"), F.lower("content").rlike(r"^(acronyms|results|1\.2 results)")
    b = c.placed.withColumns({"a": F.max(F.when(opens, F.col("block_id"))).over(order), "z": F.max(F.when((F.col("n_words") < 6) & ~opens, F.col("block_id"))).over(order)})
    return b.where("block_id > a and (z is null or z < a)").select("doc_id", "block_id")


@rule("WN13", "SELECT doc_id, min(block_id) AS block_id, count(*) AS items FROM (SELECT doc_id, block_id, r - row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS r FROM blocks) WHERE regexp_matches(content, '^([-–—•] |[0-9]{1,3}\\) |[a-z]\\) |\\[[0-9]+\\] )')) GROUP BY doc_id, g HAVING count(*) > 1")
def lists(c: Corpus) -> DataFrame:
    """Runs of two or more blocks that begin with a list marker."""
    b = c.blocks.withColumn("r", F.row_number().over(doc_window().orderBy("block_id"))).where(F.col("content").rlike(r"^([-–—•] |[0-9]{1,3}\) |[a-z]\) |\[[0-9]+\] )"))
    b = b.withColumn("g", F.col("r") - F.row_number().over(doc_window().orderBy("block_id")))
    return b.groupBy("doc_id", "g").agg(F.min("block_id").alias("block_id"), F.count("*").alias("items")).where("items > 1").drop("g")


@rule("WN18", "SELECT doc_id, figure, arg_min(block_id, (CASE WHEN starts_with(lower(content), 'rys') THEN 0 ELSE 1 END, block_id)) AS block_id FROM captions GROUP BY doc_id, figure")
def one_per_figure(c: Corpus) -> DataFrame:
    """One caption for each number: one that begins with "rys" before others, then the first."""
    order = F.struct(F.when(F.startswith(F.lower("content"), F.lit("rys")), 0).otherwise(1).alias("o"), "block_id")
    return _captions(c).groupBy("doc_id", "figure").agg(F.min_by("block_id", order).alias("block_id"))


_PAGES_SEEN, _FOOTER_PAGES, _CHUNKS_SEEN, _CHARS_SEEN = 15, 10, 40, 4000


@rule("SL04", "SELECT d.doc_id, coalesce(a, 0) AS contents_pages, coalesce(b, 0) AS heading_pages, least(40, CAST(ceil(length(text) / 2500.0) AS BIGINT)) AS chunks, left(replace(text, chr(10), ' '), 4000) AS fragment FROM deco d LEFT JOIN (SELECT doc_id, count(*) FILTER (page < 15) AS a, count(*) FILTER (page <= 10) AS b FROM sheets GROUP BY doc_id) p USING (doc_id)")
def limits(c: Corpus) -> DataFrame:
    """What limited operators see of a document: pages for the contents and for headings, chunks, and the fragment given to a model."""
    p = c.pages.groupBy("doc_id").agg(F.count(F.when(F.col("page") < _PAGES_SEEN, 1)).alias("contents_pages"), F.count(F.when(F.col("page") <= _FOOTER_PAGES, 1)).alias("heading_pages"))
    t = c.texts.select("doc_id", F.least(F.lit(_CHUNKS_SEEN).cast("long"), F.ceil(F.length("text") / 2500)).alias("chunks"), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(_CHARS_SEEN)).alias("fragment"))
    return t.join(p, "doc_id", "left").select("doc_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("contents_pages", "heading_pages")), "chunks", "fragment")


@rule("SL05", """SELECT w.doc_id, words, lines, coalesce(titles, '') AS titles, coalesce(figures, '') AS figures FROM (SELECT doc_id, array_to_string(list(text ORDER BY page, y0, x0, block_id, word_index), ' ') AS words FROM words GROUP BY doc_id) w JOIN (SELECT doc_id, array_to_string(list(text ORDER BY page, y0, block_id), chr(10)) AS lines FROM lines GROUP BY doc_id) l USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(title, '|' ORDER BY page, y0, seq) AS titles FROM toc GROUP BY doc_id) t USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(DISTINCT figure, '|' ORDER BY list_transform(string_split(figure, '.'), lambda x: CAST(x AS BIGINT))) AS figures FROM captions WHERE kind = 'image' GROUP BY doc_id) f USING (doc_id)""")
def sorted_lists(c: Corpus) -> DataFrame:
    """All words by height and place, all lines by height, contents by page and height (numbers too long for a page last), figures by number."""
    listed = lambda df, name, *order: df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda s: s["text"]).alias(name))
    x, words = listed(c.lines, "lines", "page", "y0", "block_id"), "lines"
    # lines that lie apart hold their words from left to right, so that no word is a row
    if not c.laid or "lines" in c.given:
        x, words = x.join(listed(c.words, "words", "page", "y0", "x0", "block_id", "word_index"), "doc_id"), "words"
    t = c.toc.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page").isNull().alias("none"), "page", "y0", "seq", "title"))), lambda s: s["title"]), "|").alias("titles"))
    number = F.transform(F.split("figure", r"\."), lambda x: x.cast("long")).alias("n")
    f = _captions(c).where("kind = 'image'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(number, "figure"))), lambda s: s["figure"]), "|").alias("figures"))
    j = x.join(t, "doc_id", "left").join(f, "doc_id", "left")
    return j.select("doc_id", F.array_join(words, " ").alias("words"), F.array_join("lines", "\n").alias("lines"), F.coalesce("titles", F.lit("")).alias("titles"), F.coalesce("figures", F.lit("")).alias("figures"))


@rule("SL06", f"SELECT doc_id, min(chunk) AS chunk FROM {_CHUNKS} WHERE regexp_matches(lower(piece), 'measured|plan|range') GROUP BY doc_id")
def first_hit(c: Corpus) -> DataFrame:
    from quire.plans.catalog import chunked

    return chunked(c).where(F.lower("piece").rlike("measured|plan|range")).groupBy("doc_id").agg(F.min("chunk").alias("chunk"))


@rule("LM02", f"SELECT doc_id, arg_min(regexp_extract(lower(piece), '(measured|plan|range)[^.]*', 0), chunk) AS purpose FROM {_CHUNKS} WHERE regexp_matches(lower(piece), 'measured|plan|range') GROUP BY doc_id")
def purpose(c: Corpus) -> DataFrame:
    """What the first chunk with an answer says; a pattern stands in for the model."""
    from quire.plans.catalog import chunked

    hit = chunked(c).where(F.lower("piece").rlike("measured|plan|range"))
    return hit.groupBy("doc_id").agg(F.min_by(F.regexp_extract(F.lower("piece"), r"(measured|plan|range)[^.]*", 0), "chunk").alias("purpose"))


@rule("ST02", "SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(entry, '\\p{Lu}\\. ?\\p{Lu}\\p{L}+')) AS name FROM bib UNION ALL SELECT doc_id, unnest(regexp_extract_all(entry, '\\p{Lu}\\p{L}+ \\p{Lu}\\.')) FROM bib)")
def author_names(c: Corpus) -> DataFrame:
    names = lambda p: c.bibliography.select("doc_id", F.explode(F.regexp_extract_all("entry", F.lit(p), F.lit(0))).alias("name"))
    return names(r"\p{Lu}\. ?\p{Lu}\p{L}+").unionByName(names(r"\p{Lu}\p{L}+ \p{Lu}\.")).distinct()


@rule("RD21", f"SELECT {as_finding('bibliography_summary', page='3', text='summary')} FROM (SELECT doc_id, string_agg(number || ': ' || entry, chr(10) ORDER BY number, entry) AS summary FROM bib GROUP BY doc_id)")
def summary_finding(c: Corpus) -> DataFrame:
    from quire.plans.catalog import bibliography_summary

    return finding(bibliography_summary(c), "bibliography_summary", page=F.lit(3), text=F.col("summary"))


# ---- language, bibliography and scoring ------------------------------------------------------


@rule("LG03", "SELECT DISTINCT doc_id, lower(text) AS name FROM words WHERE italic UNION SELECT doc_id, lower(trim(unnest(string_split(regexp_replace(content, '^[^:]*: ', ''), ',')))) FROM blocks WHERE regexp_matches(lower(content), '^keywords')")
def names(c: Corpus) -> DataFrame:
    italic = c.words.where("italic").select("doc_id", F.lower("text").alias("name"))
    key = c.blocks.where(F.lower("content").rlike("^keywords"))
    key = key.select("doc_id", F.explode(F.split(F.regexp_replace("content", "^[^:]*: ", ""), ",", -1)).alias("name")).select("doc_id", F.lower(F.trim("name")).alias("name"))
    return italic.unionByName(key).distinct()


@rule("LG08", "SELECT doc_id, block_id, word_index, text FROM (SELECT *, lag(lower(text)) OVER (PARTITION BY doc_id, block_id ORDER BY word_index) AS before FROM tokens) WHERE lower(text) = before AND length(text) > 1")
def repeated_words(c: Corpus) -> DataFrame:
    """The grammar rule that needs no model: a word twice in a row."""
    t = c.tokens.withColumn("before", F.lag(F.lower("text")).over(block_window().orderBy("word_index")))
    return t.where((F.lower("text") == F.col("before")) & (F.length("text") > 1)).select("doc_id", "block_id", "word_index", "text")


@rule("LG09", f"SELECT doc_id, lower(text) AS lemma, count(*) AS n FROM tokens t WHERE lower(text) NOT IN {_DICTIONARY} AND NOT EXISTS (SELECT 1 FROM words w WHERE w.doc_id = t.doc_id AND w.italic AND lower(w.text) = lower(t.text)) GROUP BY ALL HAVING count(*) <= 2")
def exceptions(c: Corpus) -> DataFrame:
    """Unknown words that are no proper names and too rare to be terms."""
    proper = c.words.where("italic").select("doc_id", F.lower("text").alias("w"))
    t = c.tokens.select("doc_id", F.lower("text").alias("w")).join(dictionary(c), "w", "left_anti").join(proper, ["doc_id", "w"], "left_anti")
    return t.groupBy("doc_id", F.col("w").alias("lemma")).agg(F.count("*").alias("n")).where("n <= 2")


@rule("LG10", f"SELECT doc_id, block_id, word_index FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id, block_id ORDER BY word_index) AS nxt FROM tokens) WHERE lower(text) NOT IN {_DICTIONARY} AND lower(text || nxt) IN {_DICTIONARY}")
def repaired(c: Corpus) -> DataFrame:
    """Unknown words that make a known one with the word behind them."""
    d = dictionary(c)
    t = c.tokens.withColumn("w", F.lower(F.concat("text", F.lead("text").over(block_window().orderBy("word_index"))))).withColumn("own", F.lower("text"))
    t = t.join(d.withColumnRenamed("w", "own"), "own", "left_anti").join(d, "w", "left_semi")
    return t.select("doc_id", "block_id", "word_index")


@rule("BB03", f"SELECT doc_id, number, trim(string_split(rest, separator)[1]) AS title FROM (SELECT doc_id, number, separator, trim(substr(entry, strpos(entry, author) + length(author)), ' ,;') AS rest FROM {FIELDS} WHERE author IS NOT NULL AND separator IS NOT NULL)")
def titles(c: Corpus) -> DataFrame:
    """The part behind the first author up to the next separator."""
    f = R.fields(c).where("author is not null and separator is not null")
    rest = F.btrim(F.substring("entry", F.instr("entry", F.col("author")) + F.length("author"), F.lit(10_000)), F.lit(" ,;"))
    return f.select("doc_id", "number", F.trim(F.split_part(rest, F.col("separator"), F.lit(1))).alias("title"))


@rule("BB06", f"SELECT doc_id, number, CASE WHEN type IS NULL THEN 'WRONG_BIBTEX_TYPE' ELSE 'MISSING_BIBTEX_FIELD' END AS problem FROM {FIELDS} WHERE type IS NULL OR (type = 'article' AND journal IS NULL AND publisher IS NULL AND NOT regexp_matches(lower(entry), 'arxiv|preprint'))")
def wrong_types(c: Corpus, producer: str = "LaTeX") -> DataFrame:
    """Entries of no known type and articles without a journal, in documents that TeX produced."""
    bare = (F.col("type") == "article") & F.col("journal").isNull() & F.col("publisher").isNull() & ~F.lower("entry").rlike("arxiv|preprint")
    t = R.typed(c).where((F.col("type").isNull() | bare) & F.lit("tex" in producer.lower()))
    return t.select("doc_id", "number", F.when(F.col("type").isNull(), "WRONG_BIBTEX_TYPE").otherwise("MISSING_BIBTEX_FIELD").alias("problem"))


@rule("LM03", "SELECT doc_id, CASE WHEN contains(lower(tail), 'holds') THEN 100 WHEN contains(lower(tail), 'the') THEN 50 ELSE 0 END AS score FROM (SELECT doc_id, substr(text, greatest(1, length(text) - 8999), 9000) AS tail FROM deco)")
def goals(c: Corpus) -> DataFrame:
    """A score for the ending of each document; a pattern stands in for the model."""
    low = F.lower(F.right("text", F.lit(9000)))
    return c.texts.select("doc_id", F.when(F.contains(low, F.lit("holds")), 100).when(F.contains(low, F.lit("the")), 50).otherwise(0).alias("score"))


@rule("LM05", "SELECT s.doc_id, seq, arg_min(regexp_extract(content, '^[^.!?]*[.!?]?', 0), b.block_id) AS summary FROM sections s JOIN blocks b ON b.doc_id = s.doc_id AND b.block_id > s.start AND (s.stop IS NULL OR b.block_id < s.stop) GROUP BY ALL")
def summaries(c: Corpus) -> DataFrame:
    """The first sentence of each section; it stands in for the model's."""
    b = c.blocks.select(F.col("doc_id").alias("d"), F.col("block_id").alias("b"), "content")
    j = c.sections.join(b, (F.col("doc_id") == F.col("d")) & (F.col("b") > F.col("start")) & (F.col("stop").isNull() | (F.col("b") < F.col("stop"))))
    return j.groupBy("doc_id", "seq").agg(F.min_by(F.regexp_extract("content", r"^[^.!?]*[.!?]?", 0), "b").alias("summary"))


@rule("LM06", "SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.v AS DOUBLE[])), 6) AS cosine, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.v AS DOUBLE[])), 6) < 0.785 AS below_threshold FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) p USING (label)")
def similarities(c: Corpus) -> DataFrame:
    """Every vector's cosine to the first of its label; an empty summary's vector of zeros has 0."""
    e = c.read("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("p"))
    s = e.join(first, "label").select("vec_id", "label", F.coalesce(F.round(cosine(F.col("embedding"), F.col("p")), 6), F.lit(0.0)).alias("cosine"))
    return s.withColumn("below_threshold", F.col("cosine") < 0.785)


@rule("LM07", "SELECT count(*) AS n, count(*) FILTER (cosine < 0.785) AS off_topic, round(100.0 - 100.0 * count(*) FILTER (cosine < 0.785) / count(*), 4) AS grade FROM (SELECT round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)), 6) AS cosine FROM embeddings)")
def grade(c: Corpus) -> DataFrame:
    from quire.plans.catalog import grade_columns, purpose_similarity

    return purpose_similarity(c).agg(*grade_columns()).select("n", F.col("below").alias("off_topic"), "grade")


@rule("LM11", "SELECT c.doc_id, c.figure FROM captions c WHERE c.kind = 'image' AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, block_id, unnest(regexp_extract_all(lower(content), '(?:rys|fig|figure)\\.? ?([0-9]+(?:\\.[0-9]+)*)', 1)) AS n FROM blocks WHERE length(content) >= 50) m WHERE m.doc_id = c.doc_id AND m.n = c.figure AND m.block_id <> c.block_id)")
def unmentioned(c: Corpus) -> DataFrame:
    """Figures that no other block mentions; only these never reach the vision model."""
    m = c.blocks.where(F.length("content") >= 50)
    return K.figure_mentions(m, _captions(c).where("kind = 'image'")).where("mentions = 0").select("doc_id", "figure")


@rule("LM15", """SELECT d.doc_id, coalesce(p.pages, 0) AS pages, coalesce(v.bad, 0) AS bad_images, coalesce(k.citations, 0) AS citations FROM documents d LEFT JOIN (SELECT doc_id, count(*) - 1 AS pages FROM sheets GROUP BY doc_id) p USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (image_type = 'raster') AS bad FROM visuals WHERE kind = 'image' GROUP BY doc_id) v USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT citation) AS citations FROM cites GROUP BY doc_id) k USING (doc_id)""")
def report(c: Corpus) -> DataFrame:
    """One row per document with the figures of its report."""
    pages = c.pages.groupBy("doc_id").agg((F.count("*") - 1).alias("pages"))
    bad = c.visuals.where("kind = 'image'").groupBy("doc_id").agg(F.count(F.when(F.col("image_type") == "raster", 1)).alias("bad_images"))
    cites = K.cited(c.blocks).groupBy("doc_id").agg(F.countDistinct("citation").alias("citations"))
    j = c.documents.select("doc_id").join(pages, "doc_id", "left").join(bad, "doc_id", "left").join(cites, "doc_id", "left")
    return j.select("doc_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("pages", "bad_images", "citations")))


# ---- the same plans under the names of their parts -------------------------------------------


@rule("SCL04", f"SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS normalised FROM deco")
def normalised(c: Corpus) -> DataFrame:
    return c.texts.select("doc_id", F.trim(F.regexp_replace(F.replace("text", F.lit("\u00a0"), F.lit(" ")), r"[ \t\n\r\f\x0B]+", " ")).alias("normalised"))


@rule("SCL22", "SELECT lemma, count(*) AS n_words FROM (SELECT DISTINCT lower(text) AS w, regexp_replace(lower(text), '(ing|ed|s)$', '') AS lemma FROM tokens) GROUP BY lemma")
def lemmas(c: Corpus) -> DataFrame:
    """Words by lemma; each distinct word is asked once. Cutting endings stands in for the lemmatiser."""
    words = c.tokens.select(F.lower("text").alias("w")).distinct()
    return words.groupBy(F.regexp_replace("w", "(ing|ed|s)$", "").alias("lemma")).agg(F.count("*").alias("n_words"))


@rule("SCL48", f"SELECT doc_id, number, coalesce(pages, volume, date) AS value, CASE WHEN pages IS NOT NULL THEN 'pages' WHEN volume IS NOT NULL THEN 'volume' WHEN date IS NOT NULL THEN 'date' END AS field FROM {FIELDS}")
def first_field(c: Corpus) -> DataFrame:
    names = ("pages", "volume", "date")
    label = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names))
    return R.fields(c).select("doc_id", "number", F.coalesce(*names).alias("value"), label.alias("field"))


@rule("JN24", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def inserted(c: Corpus) -> DataFrame:
    from quire.sources.index import insert_absent

    rows = lambda where, state: c.documents.where(where).select("doc_id", F.lit(state).alias("state"))
    return insert_absent(rows("doc_id % 2 = 0", "old"), rows("doc_id % 3 = 0", "new"), "doc_id")


@rule("AG11", "SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(lower(s), '(^| )(is|are|was|were|been|be) \\p{L}+ed( |[.!?])')) AS passive FROM (SELECT doc_id, unnest(regexp_extract_all(content, '[^.!?]+[.!?]+')) AS s FROM blocks) WHERE length(s) >= 15 GROUP BY doc_id")
def voice_counts(c: Corpus) -> DataFrame:
    s = c.blocks.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(r"[^.!?]+[.!?]+"), F.lit(0))).alias("s")).where(F.length("s") >= 15)
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count(F.when(F.lower("s").rlike(r"(^| )(is|are|was|were|been|be) \p{L}+ed( |[.!?])"), 1)).alias("passive"))


@rule("AG20", f"SELECT doc_id, round(count(*) FILTER (trim(cell) <> '') / count(*), 6) AS fill FROM (SELECT doc_id, unnest(cells) AS cell FROM ({_CELLS})) GROUP BY doc_id")
def fill_ratio(c: Corpus) -> DataFrame:
    cell = c.blocks.where(F.contains("content", F.lit("|"))).select("doc_id", F.explode(F.split("content", r"\|", -1)).alias("cell"))
    return cell.groupBy("doc_id").agg(F.round(F.count(F.when(F.trim("cell") != "", 1)) / F.count("*"), 6).alias("fill"))


@rule("SNK04", "SELECT doc_id, CAST((i - 1) // 50 AS INTEGER) AS page, CAST((i - 1) % 50 AS INTEGER) AS line, substr(text, CAST((i - 1) * 90 + 1 AS BIGINT), 90) AS content FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 90.0) AS BIGINT))) AS i FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM deco))")
def report_pages(c: Corpus) -> DataFrame:
    """Text in lines of 90 characters and pages of 50 lines."""
    t = c.texts.select("doc_id", F.posexplode(S.chunks(F.replace("text", F.lit("\n"), F.lit(" ")), 90)).alias("i", "content"))
    return t.select("doc_id", F.floor(F.col("i") / 50).cast("int").alias("page"), (F.col("i") % 50).alias("line"), "content")


@rule("SNK05", "SELECT doc_id, page, 'block' AS structure, x0, y0, x1, y1 FROM boxes UNION ALL SELECT doc_id, page, kind, vx0, vy0, vx1, vy1 FROM visuals")
def overlay(c: Corpus) -> DataFrame:
    box = ("x0", "y0", "x1", "y1")
    v = c.visuals.select("doc_id", "page", F.col("kind").alias("structure"), *(F.col(f"v{x}").alias(x) for x in box))
    return c.boxes.select("doc_id", "page", F.lit("block").alias("structure"), *box).unionByName(v)


@rule("AG15", R.ORACLES["LM08"])
def weighted_grade(c: Corpus) -> DataFrame:
    return R.overall(c)


@rule("LM12", "SELECT doc_id, page AS figure, CAST(trunc(px_width / ((vx1 - vx0) / 72)) AS INTEGER) AS dpi, image_type = 'raster' AS raster FROM visuals WHERE kind = 'image' AND (trunc(px_width / ((vx1 - vx0) / 72)) < 75 OR image_type = 'raster')")
def poor_figures(c: Corpus) -> DataFrame:
    """Figures below 75 dpi or in pixels."""
    v = c.visuals.where("kind = 'image'").withColumn("dpi", S.effective_dpi(F.col("px_width"), F.col("vx1") - F.col("vx0")))
    return v.where("dpi < 75 or image_type = 'raster'").select("doc_id", F.col("page").alias("figure"), "dpi", (F.col("image_type") == "raster").alias("raster"))
