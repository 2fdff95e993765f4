"""Sources, sinks and model replies as queries: layout files, batches of files, configurations, figure crops, fonts and charts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import rules as R
from quire.plans.rules import rule
from quire.sources import config, layout
from quire.sources.corpus import Corpus, corpus_of_words


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@rule("SRC01", "SELECT w.doc_id, w.page, w.block_id, w.word_index, w.text, font, size, w.bold, italic, l.n_words FROM words w JOIN lines l ON l.doc_id = w.doc_id AND l.block_id = w.block_id AND l.page = w.page AND l.line = w.line")
def extracted(c: Corpus) -> DataFrame:
    """Pages of words with font, size and style through the layout format and back, as a corpus with its lines."""
    read = corpus_of_words(c.spark, layout.from_json_text(layout.to_json_text(c.words)))
    lines = read.lines.select("doc_id", "block_id", "page", "line", "n_words")
    return read.words.join(lines, ["doc_id", "block_id", "page", "line"]).select("doc_id", "page", "block_id", "word_index", "text", "font", "size", "bold", "italic", "n_words")


@rule("SRC02", "SELECT doc_id, page + 1 AS page, block_id, text AS content FROM boxes b WHERE NOT regexp_matches(trim(text), '^[0-9]+$') UNION ALL SELECT doc_id, page + 1, -1, kind FROM visuals WHERE kind = 'image'")
def second_profile(c: Corpus) -> DataFrame:
    """The profile for language models: pages from 1, footers by an exact number, no contents or tables without lines; images as rows of their own."""
    b = c.boxes.where(~F.trim("text").rlike("^[0-9]+$")).select("doc_id", (F.col("page") + 1).alias("page"), "block_id", F.col("text").alias("content"))
    return b.unionByName(c.visuals.where("kind = 'image'").select("doc_id", (F.col("page") + 1).alias("page"), F.lit(-1).alias("block_id"), F.col("kind").alias("content")))


@rule("SRC19", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN contains(text, 'XML') THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) END AS n_rows, CASE WHEN contains(text, 'XML') THEN 'ValueError: markup' END AS error FROM deco")
def batch(c: Corpus) -> DataFrame:
    """A directory of files, each parsed on its own: a file that the parser refuses gives a row with its message, and the others go on."""

    def parse(data: bytes) -> list[dict]:
        text = data.decode()
        if "XML" in text:
            raise ValueError("markup")
        return [{"page": 0, "block_id": i, "text": x} for i, x in enumerate(text.split("\n")) if x.strip(" ")]

    files = c.texts.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return layout.parsed(files, parse).groupBy("path").agg(F.count("text").alias("n_rows"), F.max("error").alias("error"))


_GOOD = {"interlinia": "1.5", "minimalna_liczba_stron": "40", "maksymalna_liczba_stron": "60", "rozmiar_czcionki": "10", "margines": "lustrzany", "format": "A4", "orientacja": "pionowa", "justowanie": "tak", "czcionka": {"1": "Serif", "2": "Arial"}}
#: A right file, and files with one thing wrong each.
_FILES = [json.dumps(x) if isinstance(x, dict) else x for x in (
    _GOOD, _GOOD | {"minimalna_liczba_stron": "61"}, _GOOD | {"format": "B5"}, _GOOD | {"margines": "x"}, _GOOD | {"orientacja": ""}, _GOOD | {"justowanie": "Nie", "czcionka": {}}, _GOOD | {"rozmiar_czcionki": "ten"},
    {k: v for k, v in _GOOD.items() if k != "interlinia"}, "no JSON",
)]
_KEYS = ("interlinia", "minimalna_liczba_stron", "maksymalna_liczba_stron", "rozmiar_czcionki", "margines", "format", "orientacja", "justowanie")


def _rows(c: Corpus, values: list[str]) -> DataFrame:
    return c.spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("file", "json"))


_RAW = f"(SELECT CAST(i - 1 AS INTEGER) AS file, j, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS v FROM (SELECT unnest([{', '.join(map(_text, _FILES))}]) AS j, generate_subscripts([{', '.join(map(_text, _FILES))}], 1) AS i))"


@rule("SRC15", f"""SELECT file, a AS line_spacing, b AS min_pages, d AS max_pages, e AS font_size, lower(v ->> 'margines') AS margin_type, lower(v ->> 'format') AS format, lower(v ->> 'orientacja') AS orientation, lower(v ->> 'justowanie') = 'tak' AS justified, coalesce(fonts, '') AS fonts,
    CASE WHEN NOT json_valid(j) THEN 'not JSON' {' '.join(f"WHEN (v ->> '{k}') IS NULL THEN 'missing {k}'" for k in _KEYS)} WHEN a IS NULL OR b IS NULL OR d IS NULL OR e IS NULL THEN 'not a number' WHEN b > d THEN 'min > max' WHEN lower(v ->> 'margines') NOT IN {config.MARGINS} THEN 'margin'
      WHEN lower(v ->> 'format') NOT IN {config.FORMATS} THEN 'format' WHEN lower(v ->> 'orientacja') NOT IN {config.ORIENTATIONS} THEN 'orientation' WHEN lower(v ->> 'justowanie') NOT IN {config.YES_NO} THEN 'justification' END AS error
    FROM (SELECT *, try_cast(v ->> 'interlinia' AS DOUBLE) AS a, try_cast(v ->> 'minimalna_liczba_stron' AS INTEGER) AS b, try_cast(v ->> 'maksymalna_liczba_stron' AS INTEGER) AS d, try_cast(v ->> 'rozmiar_czcionki' AS INTEGER) AS e,
      array_to_string(list_sort(list_transform(json_keys(coalesce(json_extract(v, '$.czcionka'), '{{}}')), lambda k: v ->> ('$.czcionka."' || k || '"'))), '|') AS fonts FROM {_RAW})""")
def requirement_files(c: Corpus) -> DataFrame:
    r = config.requirements(_rows(c, _FILES))
    return r.withColumn("fonts", F.array_join("fonts", "|")).drop("json")


_APPS = ['{"device": " CUDA ", "n_gpu_layers": "25", "model_dir": "/models", "language": "EN"}', '{"device": "cpu", "n_gpu_layers": 0, "model_dir": "/m", "embedding_model": "e5"}', '{"device": "cpu", "model_dir": "/m"}']
_APP_RAW = f"(SELECT CAST(i - 1 AS INTEGER) AS file, v FROM (SELECT unnest([{', '.join(map(_text, _APPS))}]) AS v, generate_subscripts([{', '.join(map(_text, _APPS))}], 1) AS i))"


@rule("SRC16", f"""SELECT file, lower(trim(v ->> 'device')) AS device, try_cast(v ->> 'n_gpu_layers' AS INTEGER) AS n_gpu_layers, v ->> 'model_dir' AS model_dir, lower(trim(coalesce(v ->> 'language', 'pl'))) AS language, v ->> 'thesis_path' AS thesis_path, coalesce(v ->> 'output_dir', 'output') AS output_dir,
    coalesce(v ->> 'embedding_model', 'paraphrase-multilingual-MiniLM-L12-v2') AS embedding_model, CASE WHEN (v ->> 'device') IS NULL THEN 'device' WHEN try_cast(v ->> 'n_gpu_layers' AS INTEGER) IS NULL THEN 'n_gpu_layers' WHEN (v ->> 'model_dir') IS NULL THEN 'model_dir' END AS error FROM {_APP_RAW}""")
def application_options(c: Corpus) -> DataFrame:
    return config.options(_rows(c, _APPS)).drop("json")


def switched(c: Corpus, given: dict[str, bool] | None = None) -> DataFrame:
    """(rule, n): the findings of the rules that the switches of the language rules leave on."""
    from quire.plans import details

    on, out = config.toggles(given), []
    if on["sprawdzanie_formy_osobowej"]:
        out.append(R.personal_forms(c).select(F.lit("personal_form").alias("rule")))
    if on["sprawdzanie_wg_bibtex"]:
        out.append(details.wrong_types(c).select(F.lit("bibtex").alias("rule")))
    none = c.spark.createDataFrame([], "rule string")
    for df in out:
        none = none.unionByName(df)
    return none.groupBy("rule").agg(F.count("*").alias("n"))


@rule("SRC17", "SELECT 'personal_form' AS rule, count(*) AS n FROM {personal} HAVING count(*) > 0 UNION ALL SELECT 'bibtex', count(*) FROM {bibtex} HAVING count(*) > 0")
def switches(c: Corpus) -> DataFrame:
    return switched(c)


@rule("SNK07", "SELECT doc_id, printf('images/%d_p%d_%d.png', doc_id, page, CAST(n AS INTEGER)) AS path, CAST(vx0 AS INTEGER) AS x0, CAST(vy0 AS INTEGER) AS y0, CAST(vx1 AS INTEGER) AS x1, CAST(vy1 AS INTEGER) AS y1, length(kind || page) AS n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY vy0, vx0) - 1 AS n FROM visuals WHERE kind = 'image')")
def crops(c: Corpus) -> DataFrame:
    """Figures as files to be: path, box and bytes of each crop (a few bytes stand in for the picture)."""
    from quire.sources.index import figure_files

    v = c.visuals.where("kind = 'image'").withColumn("bytes", F.concat("kind", F.col("page").cast("string")).cast("binary"))
    f = figure_files(v)
    return f.select("doc_id", "path", *(F.col(f"v{x}").cast("int").alias(x) for x in ("x0", "y0", "x1", "y1")), F.length("bytes").alias("n_bytes"))


# ---- replies of vision models ----------------------------------------------------------------

_REPLY = "CASE doc_id % 3 WHEN 0 THEN '{\"consistent\": \"False\", \"reason\": \"two sizes\"}' WHEN 1 THEN '{\"consistent\": true}' ELSE 'Sure: {\"consistent\": false} .' END"


@rule("LM13", "SELECT doc_id, page AS figure, CASE WHEN doc_id % 3 = 0 THEN 'two sizes' ELSE 'font sizes differ' END AS details FROM visuals WHERE kind = 'image' AND doc_id % 3 <> 1")
def font_consistency(c: Corpus) -> DataFrame:
    """Figures that a vision model finds inconsistent in their fonts, from its replies; replies by arithmetic stand in for it."""
    from quire.plans.models import font_findings

    return font_findings(c.visuals.where("kind = 'image'").select("doc_id", F.col("page").alias("figure"), F.expr(_REPLY).alias("reply")))


_CHART = "'{\"is_actual_chart_with_axes\": ' || CASE WHEN doc_id % 4 = 0 THEN 'false' ELSE 'true' END || ', \"embedded_title\": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', \"has_axis_units\": ' || CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END || ', \"axis_ends_with_dot\": ' || CASE WHEN doc_id % 5 = 0 THEN 'true' ELSE 'false' END || ', \"has_axis_arrows\": false, \"is_polish\": ' || CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END || '}'"


@rule("LM14", """SELECT * FROM (SELECT doc_id, page AS figure, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'title inside the chart' END, CASE WHEN doc_id % 3 = 0 THEN 'axis without a unit' END, CASE WHEN doc_id % 5 = 0 THEN 'axis label ends with a dot' END, CASE WHEN doc_id % 7 = 0 THEN 'text is not Polish' END], lambda x: x IS NOT NULL), '; ') AS problems
    FROM visuals WHERE kind = 'image' AND doc_id % 4 <> 0) WHERE problems <> ''""")
def chart_rules(c: Corpus) -> DataFrame:
    """Charts that break a rule, from a vision model's replies; replies by arithmetic stand in for it."""
    from quire.plans.models import chart_problems

    return chart_problems(c.visuals.where("kind = 'image'").select("doc_id", F.col("page").alias("figure"), F.expr(_CHART).alias("reply")))
