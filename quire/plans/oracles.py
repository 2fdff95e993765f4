"""DuckDB SQL of the queries in ``quire.plans.catalog``, written independently of their plans.

``TABLES`` are the corpus tables as common table expressions; ``with_tables`` puts those that a
statement names, and those that they name, in front of it.
"""

from __future__ import annotations

import re

from quire.plans import scalars
from quire.plans.catalog import ART_TITLES, OTHER_CHAPTERS
from quire.plans.rules import CHAPTER_NUMBER as _CHAPTER_NUMBER
from quire.sources.corpus import BEGINNING, CONTENTS, ENTRY, FIGURES, FRONT, LEADER, NO_FIGURES, NO_TABLES, SNIPPETS, WHOLE
from quire.sources.corpus import TABLES as TABLE_LISTS


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {text_of(w)})" for w in words) + ")"


def _citations(x: str) -> str:
    parts = [f"regexp_extract_all({x}, {text_of(p)})" for _, p in scalars.CITATIONS]
    parts[3] = f"list_transform({parts[3]}, lambda v: trim(v, ' ' || chr(9) || chr(10) || chr(13)))"
    return "flatten([" + ", ".join(parts) + "])"


_SNIPPETS = ", ".join(" || chr(10) || ".join(map(text_of, s)) for s in SNIPPETS)

TABLES = {
    "deco": f"SELECT doc_id, CASE WHEN doc_id % {len(SNIPPETS)} IN {FRONT} THEN extra || chr(10) || coalesce(text, '') ELSE coalesce(text, '') || chr(10) || extra END AS text FROM (SELECT *, ([{_SNIPPETS}])[doc_id % {len(SNIPPETS)} + 1] AS extra FROM documents)",
    "blocks": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS block_id, content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM deco) WHERE trim(content) <> ''",
    "parts": "SELECT doc_id, block_id, unnest(string_split(content, ' ')) AS text, generate_subscripts(string_split(content, ' '), 1) AS i FROM blocks",
    "tokens": """SELECT doc_id, block_id, CAST(row_number() OVER (PARTITION BY doc_id, block_id ORDER BY i) - 1 AS INTEGER) AS word_index, text, CAST(s AS INTEGER) AS start_char, CAST(s + length(text) AS INTEGER) AS end_char
        FROM (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM parts) WHERE text <> ''""",
    "counted": "SELECT doc_id, block_id, content, len(list_filter(string_split(content, ' '), lambda w: w <> '')) AS n_words FROM blocks",
    "placed": "SELECT *, CAST(ceil(n_words / 12.0) AS INTEGER) AS n_lines, CAST(coalesce(sum(ceil(n_words / 12.0)) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first_line FROM counted",
    "words": """SELECT doc_id, block_id, word_index, text, start_char, end_char, lineno // 40 AS page, lineno % 40 AS line, CASE WHEN doc_id % 3 = 0 THEN 'Sans' ELSE 'Serif' END AS font,
        CASE WHEN n_words < 6 THEN 14.0 ELSE 12.0 END AS size, n_words < 6 AS bold, word_index % 17 = 16 AS italic, 72.0 + word_index % 12 * 36 AS x0, 72.0 + lineno % 40 * 16 AS y0, 72.0 + word_index % 12 * 36 + CASE WHEN length(text) = 1 THEN 10 ELSE 30 END AS x1, 84.0 + lineno % 40 * 16 AS y1
        FROM (SELECT t.*, n_words, first_line + word_index // 12 AS lineno FROM tokens t JOIN placed USING (doc_id, block_id))""",
    "lines": "SELECT doc_id, block_id, page, line, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_index) AS text, bool_or(bold) AS bold, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL",
    "boxes": "SELECT doc_id, block_id, page, string_agg(text, ' ' ORDER BY word_index) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words FROM words GROUP BY doc_id, block_id, page",
    "sheets": """SELECT doc_id, page, CASE WHEN doc_id % 7 = 0 THEN b ELSE a END AS width, CASE WHEN doc_id % 7 = 0 THEN a ELSE b END AS height, x0, y0, x1, y1
        FROM (SELECT doc_id, page, CASE WHEN doc_id % 11 = 0 THEN 420.0 ELSE 595.0 END AS a, CASE WHEN doc_id % 11 = 0 THEN 595.0 ELSE 842.0 END AS b, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY doc_id, page)""",
    "visuals": """SELECT doc_id, page, CASE WHEN page % 2 = 0 THEN 'image' ELSE 'table' END AS kind, CASE WHEN doc_id % 5 < 2 THEN 'raster' ELSE 'vector' END AS image_type, 60.0 AS vx0, 200.0 AS vy0, 560.0 AS vx1,
        CASE WHEN page % 2 = 0 THEN 300.0 ELSE 260.0 END AS vy1, doc_id % 30 * 20 + 100 AS px_width FROM sheets WHERE (doc_id + page) % 3 = 0""",
    "toc_rows": "SELECT doc_id, page, round_even(y0 / 5.0, 0) * 5 AS row_y, string_agg(trim(text), ' ' ORDER BY x0, block_id) AS text, bool_or(bold) AS bold, min(x0) AS x0, arg_min(y0, (x0, block_id)) AS y0, arg_min(x1, (x0, block_id)) AS x1, arg_min(y1, (x0, block_id)) AS y1 FROM lines WHERE page < 15 GROUP BY ALL",
    "toc_marked": f"""SELECT *, try_cast(regexp_extract(text, {text_of(ENTRY)}, 2) AS INTEGER) AS named, CASE WHEN regexp_matches(text, {text_of(ENTRY)}) AND length(t) >= 3 THEN t END AS title, {_any('lower(text)', CONTENTS)} AS heading
        FROM (SELECT *, trim(regexp_replace(regexp_extract(text, {text_of(ENTRY)}, 1), {text_of(LEADER)}, ' ', 'g')) AS t FROM toc_rows)""",
    "toc_counted": "SELECT *, (bool_or(heading) OVER w AND count(title) OVER w >= 2) OR count(title) OVER w >= 5 AS counts FROM toc_marked WINDOW w AS (PARTITION BY doc_id, page)",
    "toc": """SELECT doc_id, CAST(seq AS INTEGER) AS seq, title, named AS page, CASE WHEN bold AND gap = 1 THEN 1 ELSE greatest(gap, dotted) END AS level, page AS src_page, x0, y0, x1, y1 FROM (
        SELECT *, row_number() OVER w AS seq, 1 + CAST(floor(greatest(0.0, x0 - first_value(x0) OVER w) / 12) AS INTEGER) AS gap, CASE WHEN regexp_matches(title, '^[0-9]') THEN length(n) - length(replace(n, '.', '')) + 1 ELSE 1 END AS dotted
        FROM (SELECT *, regexp_extract(title, '^([0-9]+([.][0-9]+)*)', 1) AS n FROM toc_counted c WHERE counts AND title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM toc_counted m WHERE m.doc_id = c.doc_id AND NOT m.counts AND m.page <= c.page AND m.page > (SELECT min(page) FROM toc_counted b WHERE b.doc_id = c.doc_id AND b.counts))) WINDOW w AS (PARTITION BY doc_id ORDER BY page, row_y))""",
    "bib": "SELECT doc_id, block_id, CAST(regexp_extract(content, '^\\[([0-9]+)\\]', 1) AS INTEGER) AS number, regexp_replace(content, '^\\[[0-9]+\\] ', '') AS entry FROM blocks WHERE regexp_matches(content, '^\\[[0-9]+\\] ')",
    "sections": """SELECT doc_id, row_number() OVER w AS seq, number, title, length(number) - length(replace(number, '.', '')) + 1 AS level, block_id AS start, lead(block_id) OVER w AS stop
        FROM (SELECT doc_id, block_id, regexp_extract(content, '^([0-9]+(\\.[0-9]+)*) ', 1) AS number, regexp_replace(content, '^[0-9]+(\\.[0-9]+)* ', '') AS title FROM blocks WHERE regexp_matches(content, '^[0-9]+(\\.[0-9]+)* \\p{L}[^.]*$'))
        WINDOW w AS (PARTITION BY doc_id ORDER BY block_id)""",
    "section_cites": f"""SELECT s.doc_id, s.seq, s.title, coalesce(sum(length(content)), 0) AS n_chars, count(DISTINCT cs) AS citations FROM sections s LEFT JOIN (SELECT doc_id, block_id, CASE WHEN i = 1 THEN content ELSE '' END AS content, cs FROM (
        SELECT doc_id, block_id, content, unnest(CASE WHEN len(cs) = 0 THEN [NULL] ELSE cs END) AS cs, generate_subscripts(CASE WHEN len(cs) = 0 THEN [NULL] ELSE cs END, 1) AS i FROM (SELECT doc_id, block_id, content, {_citations('content')} AS cs FROM blocks))) b
        ON b.doc_id = s.doc_id AND b.block_id > s.start AND (s.stop IS NULL OR b.block_id < s.stop) GROUP BY ALL""",
    "list_pages": "SELECT doc_id, src_page AS page FROM toc UNION SELECT doc_id, src_page FROM tof UNION SELECT doc_id, src_page FROM tot",
    "page_texts": "SELECT doc_id, page, string_agg(text, ' ' ORDER BY line) AS page_text FROM lines GROUP BY doc_id, page",
    "main_size": "SELECT doc_id, arg_min(size, (-n, first)) AS main_size FROM (SELECT doc_id, size, count(*) AS n, min((page, line, x0, block_id)) AS first FROM words GROUP BY doc_id, size) GROUP BY doc_id",
    "cites": """SELECT DISTINCT doc_id, block_id, citation, unnest(generate_series(lo, hi)) AS number FROM (
        SELECT doc_id, block_id, citation, try_cast(string_split(part, '-')[1] AS INTEGER) AS lo, try_cast(string_split(part, '-')[-1] AS INTEGER) AS hi FROM (
          SELECT doc_id, block_id, citation, unnest(string_split(regexp_replace(citation, '[\\[\\] ]', '', 'g'), ',')) AS part FROM (
            SELECT doc_id, block_id, content, unnest(regexp_extract_all(content, '\\[[0-9 ,\\-]*[0-9][0-9 ,\\-]*\\]')) AS citation FROM blocks)))
        WHERE lo <= hi""",
    "captions": "SELECT doc_id, block_id, content, regexp_extract(lower(content), '^(?:figure|fig|rys|table|tabela)\\.? ?([0-9]+(?:\\.[0-9]+)*)', 1) AS figure, CASE WHEN regexp_matches(content, '^(?:Table|Tabela)') THEN 'table' ELSE 'image' END AS kind FROM blocks WHERE regexp_matches(content, '^(?:Figure|Fig\\.|Rys\\.|Table|Tabela) ?[0-9]')",
    "definitions": """SELECT doc_id, block_id, acronym, strpos(content, '(' || acronym || ')') - 1 AS start FROM (SELECT doc_id, block_id, content, unnest(regexp_extract_all(content, '\\(([A-Z]{2,10})\\)', 1)) AS acronym FROM blocks)
        UNION ALL SELECT doc_id, block_id, regexp_extract(content, '^([A-Z]{2,10}) [-–—] ', 1), 0 FROM blocks WHERE regexp_matches(content, '^[A-Z]{2,10} [-–—] \\p{L}')""",
    "uses": "SELECT doc_id, block_id, w AS acronym, start_char AS start FROM (SELECT *, regexp_replace(text, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS w FROM words) WHERE regexp_matches(w, '^[A-Z]{2,10}$') AND NOT regexp_matches(w, '^[IVXLCDM]+$')",
}


def _listed(name: str, headings, ends) -> None:
    """The entries of a list of figures or tables, line by line in the order of the page."""
    w, b, e = text_of(WHOLE), text_of(BEGINNING), text_of(ENTRY)
    TABLES[f"{name}_rows"] = f"""SELECT *, CASE WHEN regexp_matches(text, {w}) THEN 'whole' WHEN regexp_matches(text, {b}) THEN 'begin' WHEN regexp_matches(text, {e}) THEN 'stop' ELSE 'more' END AS kind FROM (
        SELECT *, bool_or(y0 < height * 0.15 AND {_any('lower(text)', headings)}) OVER p AS opens, bool_or(y0 < height * 0.15 AND {_any('lower(text)', ends)}) OVER p AS closes FROM (
          SELECT l.doc_id, l.page, height, round_even(l.y0 / 5.0, 0) * 5 AS row_y, string_agg(trim(text), ' ' ORDER BY l.x0, block_id) AS text, min(l.x0) AS x0, min(l.y0) AS y0, max(l.x1) AS x1, max(l.y1) AS y1
          FROM lines l JOIN sheets s ON s.doc_id = l.doc_id AND s.page = l.page WHERE NOT EXISTS (SELECT 1 FROM toc t WHERE t.doc_id = l.doc_id AND t.src_page = l.page) GROUP BY ALL) WINDOW p AS (PARTITION BY doc_id, page)) WHERE lower(text) NOT IN {tuple(headings)}"""
    TABLES[f"{name}_parts"] = f"""SELECT *, sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, n ORDER BY row_y) AS stops, first_value(kind) OVER (PARTITION BY doc_id, page, n ORDER BY row_y) AS starter
        FROM (SELECT *, sum(CASE WHEN kind IN ('whole', 'begin') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY row_y) AS n FROM {name}_rows)"""
    TABLES[f"{name}_entries"] = f"""SELECT * FROM (SELECT doc_id, page, n, trim(regexp_replace(replace(replace(string_agg(CASE kind WHEN 'whole' THEN regexp_extract(text, {w}, 2) WHEN 'begin' THEN regexp_extract(text, {b}, 2) WHEN 'stop' THEN regexp_extract(text, {e}, 1) ELSE text END, chr(1) ORDER BY row_y), '-' || chr(1), ''), chr(1), ' '), {text_of(LEADER)}, ' ', 'g')) AS title,
        max(CASE kind WHEN 'whole' THEN regexp_extract(text, {w}, 1) WHEN 'begin' THEN regexp_extract(text, {b}, 1) END) AS number, max(try_cast(CASE kind WHEN 'whole' THEN regexp_extract(text, {w}, 3) WHEN 'stop' THEN regexp_extract(text, {e}, 2) END AS INTEGER)) AS named,
        arg_max(x0, row_y) AS x0, arg_max(y0, row_y) AS y0, arg_max(x1, row_y) AS x1, arg_max(y1, row_y) AS y1 FROM {name}_parts
        WHERE n > 0 AND (kind = 'whole' OR (starter = 'begin' AND ((kind <> 'stop' AND stops = 0) OR (kind = 'stop' AND stops = 1)))) GROUP BY doc_id, page, n) WHERE named IS NOT NULL"""
    TABLES[f"{name}_runs"] = f"""SELECT *, sum(CASE WHEN opens OR coalesce(closes OR entries = 0 OR page <> before + 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM (
        SELECT r.doc_id, r.page, bool_or(opens) AS opens, bool_or(closes) AS closes, (SELECT count(*) FROM {name}_entries e WHERE e.doc_id = r.doc_id AND e.page = r.page) AS entries FROM {name}_rows r GROUP BY r.doc_id, r.page))"""
    TABLES[f"{name}_open"] = f"SELECT *, first_value(opens) OVER w AS open, first_value(entries) OVER w AS first FROM {name}_runs WINDOW w AS (PARTITION BY doc_id, run ORDER BY page)"
    TABLES[f"{name}_pages"] = f"SELECT doc_id, page FROM (SELECT *, min(CASE WHEN open AND entries >= 2 THEN page END) OVER (PARTITION BY doc_id) AS earlier FROM {name}_open) WHERE open AND entries > 0 AND NOT (first = 0 OR (first < 2 AND (earlier IS NULL OR page <= earlier)))"
    TABLES[name] = f"SELECT e.doc_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.page, n) AS seq, number, title, named AS page, e.page AS src_page, x0, y0, x1, y1 FROM {name}_entries e JOIN {name}_pages p ON p.doc_id = e.doc_id AND p.page = e.page"


_listed("tof", FIGURES, NO_FIGURES)
_listed("tot", TABLE_LISTS, NO_TABLES)


def with_tables(sql: str) -> str:
    need, todo = set(), [sql]
    while todo:
        s = todo.pop()
        for name, body in TABLES.items():
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", s):
                need.add(name)
                todo.append(body)
    order: list[str] = []

    def add(name: str) -> None:
        for other in TABLES:
            if other != name and other not in order and re.search(rf"\b(FROM|JOIN)\s+{other}\b", TABLES[name]):
                add(other)
        if name not in order:
            order.append(name)

    for name in need:
        add(name)
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in order)
    return f"WITH {ctes} {sql}" if ctes else sql


def _latex(x: str) -> str:
    for a, b in scalars.LATEX:
        x = f"replace({x}, {text_of(a)}, {text_of(b)})"
    return x


def _case(x: str, then) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {text_of(p)}) THEN {then(n, p)}" for n, p in scalars.MARKERS)


CLEAN = "trim(regexp_replace(replace(replace({x}, chr(173), ''), chr(160), ' '), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_clean = lambda x: CLEAN.replace("{x}", x)


def _spans(pattern: str, table: str = "blocks") -> str:
    """(doc_id, block_id, text, start, stop) of the matches of a pattern without capturing groups."""
    p = text_of(pattern)
    return f"""(SELECT doc_id, block_id, m AS text, CAST(s AS INTEGER) AS start, CAST(s + length(m) AS INTEGER) AS stop FROM (
        SELECT doc_id, block_id, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
          SELECT doc_id, block_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
            SELECT doc_id, block_id, regexp_extract_all(content, {p}) AS ms, string_split_regex(content, {p}) AS gs FROM {table}))
        WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def _word_sets(pattern: str) -> str:
    return f"SELECT m.doc_id, m.block_id, m.start, array_to_string(list_sort(list(DISTINCT word_index)), ',') AS ws FROM {_spans(pattern)} m JOIN words w ON w.doc_id = m.doc_id AND w.block_id = m.block_id AND m.start < w.end_char AND m.stop > w.start_char GROUP BY ALL"


_BODY: dict[str, str] = {
    "SRC10": "SELECT doc_id, seq, title, page, level, src_page FROM toc",
    "SRC14": "SELECT doc_id, seq, number, title, level FROM sections",
    "SCL01": f"SELECT doc_id, block_id, {_latex('content')} AS fixed FROM blocks",
    "SCL03": f"SELECT doc_id, block_id, {_clean('content')} AS clean FROM blocks",
    "SCL05": """SELECT doc_id, block_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(content), '^[-• ]+', '')), '^["„”](.*)["„”]$', '\\1'), '\\.$', '')) AS tidy FROM blocks""",
    "SCL06": """SELECT doc_id, page, CASE WHEN (abs(width - 420) <= 10 AND abs(height - 595) <= 10) OR (abs(width - 595) <= 10 AND abs(height - 420) <= 10) THEN 'A5'
        WHEN (abs(width - 595) <= 10 AND abs(height - 842) <= 10) OR (abs(width - 842) <= 10 AND abs(height - 595) <= 10) THEN 'A4'
        WHEN (abs(width - 842) <= 10 AND abs(height - 1191) <= 10) OR (abs(width - 1191) <= 10 AND abs(height - 842) <= 10) THEN 'A3' ELSE 'incorrect' END AS format,
        CASE WHEN height < width THEN 'landscape' ELSE 'portrait' END AS orientation FROM sheets""",
    "SCL07": "SELECT * FROM (SELECT doc_id, block_id, page, line, round_even((y1 - lag(y1) OVER (PARTITION BY doc_id, block_id, page ORDER BY line)) / 12.0 / 1.2, 2) AS spacing FROM lines) WHERE spacing > 0.5 AND spacing < 3.0",
    "SCL08": f"SELECT doc_id, block_id, page, text FROM (SELECT b.*, height, lower(trim(text)) AS t FROM boxes b JOIN (SELECT doc_id, page, height FROM sheets) USING (doc_id, page)) WHERE y0 >= height * 0.88 AND (regexp_matches(t, {text_of(scalars.FOOTERS)}) OR regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || page || '([^\\p{{L}}\\p{{N}}_]|$)'))",
    "SCL09": "SELECT doc_id, page, x0 AS left_margin, y0 AS top_margin, width - x1 AS right_margin, height - y1 AS bottom_margin FROM sheets",
    "SCL10": """SELECT doc_id, block_id, page, line, CASE WHEN dl <= 5 AND dr <= 5 THEN 'justified' WHEN abs(dl - dr) <= 5 THEN 'center' WHEN dr <= 5 THEN 'right' ELSE 'left' END AS alignment, NOT (dl <= 5 AND dr <= 5) OR coalesce(spread <= 1.0, true) AS consistent FROM (
        SELECT *, abs(x0 - min(x0) OVER (PARTITION BY doc_id, page)) AS dl, abs(x1 - max(x1) OVER (PARTITION BY doc_id, page)) AS dr FROM (SELECT doc_id, block_id, page, line, stddev_samp(gap) FILTER (gap > 0) AS spread, min(x0) AS x0, max(x1) AS x1
          FROM (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, block_id, page, line ORDER BY word_index) AS gap FROM words) GROUP BY ALL))""",
    "SCL11": f"""SELECT doc_id, block_id, marker, CASE WHEN active IS NULL THEN marker {' '.join(f"WHEN active = '{n}' AND regexp_matches(trim(content), {text_of(p)}) THEN '{n}'" for n, p in scalars.MARKERS)} END AS continued
        FROM (SELECT *, lag(marker) OVER (PARTITION BY doc_id ORDER BY block_id) AS active FROM (SELECT *, {_case('trim(content)', lambda n, p: text_of(n))} END AS marker FROM blocks))""",
    "SCL12": f"SELECT doc_id, block_id, {_case('trim(content)', lambda n, p: f'trim(regexp_replace(trim(content), {text_of(p)}, {text_of(str())}))')} ELSE trim(content) END AS stripped FROM blocks",
    "SCL13": f"SELECT doc_id, block_id, regexp_matches(trim(content), {text_of(scalars.ACRONYM_LINE)}) AS is_acronym FROM blocks",
    "SCL14": "SELECT doc_id, block_id, (bool_and(bold) AND count(*) < 15) OR (bool_and(italic) AND count(*) < 15) OR avg(size) > 12.5 AS is_header FROM words GROUP BY doc_id, block_id",
    "SCL15": "SELECT doc_id, block_id FROM blocks WHERE starts_with(lower(content), 'keywords') OR starts_with(lower(content), 'key words') OR starts_with(lower(content), 'słowa kluczowe')",
    "SCL16": f"""SELECT doc_id, block_id, CASE WHEN regexp_matches(t, '(?:\\.\\s*){{4,}}') THEN 0 WHEN (n - 1) / (chars + n - 1) > 0.3 THEN 1 WHEN m / n > 0.4 THEN 2 ELSE 0 END AS math FROM (
        SELECT doc_id, block_id, string_agg(text, ' ' ORDER BY word_index) AS t, count(*) AS n, sum(length(text)) AS chars, count(*) FILTER (regexp_matches(lower(font), '{"|".join(scalars.MATH_FONTS)}')) AS m FROM words GROUP BY ALL)""",
    "SCL17": """SELECT * FROM (SELECT doc_id, block_id, page, round(greatest(0, least(x1, vx1 + 5) - greatest(x0, vx0 - 5)) * greatest(0, least(y1, vy1 + 5) - greatest(y0, vy0 - 5)) / ((x1 - x0) * (y1 - y0)), 6) AS share
        FROM boxes JOIN (SELECT * FROM visuals WHERE kind = 'table') USING (doc_id, page)) WHERE share > 0.8""",
    "SCL27": f"""SELECT doc_id, block_id, word_index, w AS word FROM (SELECT *, trim(text, {text_of(scalars.AROUND)}) AS w, substr(text, 2, greatest(0, length(text) - 2)) AS inside FROM tokens)
        WHERE length(w) BETWEEN 2 AND 10 AND NOT regexp_matches(w, '^([A-Z]\\.)+[A-Z]?$') AND NOT (regexp_matches(w, '\\p{{Ll}}') AND NOT regexp_matches(w, '\\p{{Lu}}')) AND NOT regexp_matches(w, '[\\p{{Nd}}_+#<>*/\\\\]') AND w NOT IN {scalars.NO_ACRONYMS}
        AND ((regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}')) OR (NOT regexp_matches(w, '^\\p{{Lu}}') AND len(regexp_extract_all(w, '\\p{{Lu}}')) >= 2) OR (regexp_matches(text, '^\\(.*\\)$') AND length(inside) >= 2 AND regexp_matches(inside, '\\p{{Lu}}') AND NOT regexp_matches(inside, '\\p{{Ll}}')))""",
    "SCL28": "SELECT doc_id, block_id, word_index, text AS word FROM tokens WHERE regexp_matches(text, '^[IVXLCDM]+$')",
    "SCL29": """SELECT doc_id, block_id, acronym, regexp_matches(upper(list_aggregate(list_transform(list_filter(string_split_regex(before, '[ -]'), lambda w: w <> ''), lambda w: w[1]), 'string_agg', '')), '^.*' || array_to_string(string_split(acronym, ''), '.*')) AS matches
        FROM (SELECT doc_id, block_id, regexp_extract(content, '\\(([A-Z]{2,10})\\)', 1) AS acronym, regexp_extract(content, '^(.*) \\([A-Z]{2,10}\\)', 1) AS before FROM blocks WHERE regexp_matches(content, '^.+ \\([A-Z]{2,10}\\)'))""",
    "SCL32": "SELECT doc_id, number, title, level FROM sections",
    "SCL33": f"""SELECT doc_id, n_lines, n_headings, n_lines >= 2 AS is_toc FROM (SELECT doc_id, CAST(sum(len(regexp_extract_all(content, {text_of(scalars.TOC_LINE)}))) AS BIGINT) AS n_lines, count(*) FILTER (t <> '' AND (regexp_matches(t, '\\.{{3,}}|\\.\\s\\.\\s\\.') OR regexp_matches(lower(t), {text_of(scalars.LIST_HEADINGS)}) OR regexp_matches(t, '^\\d+\\s*$|^\\d+\\s+[A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż].*'))) AS n_headings
        FROM (SELECT *, {_clean('content')} AS t FROM blocks) GROUP BY doc_id)""",
    "SCL34": f"SELECT doc_id, block_id, array_to_string(cs, '|') AS citations FROM (SELECT doc_id, block_id, {_citations('content')} AS cs FROM blocks) WHERE len(cs) > 0",
    "SCL35": "SELECT doc_id, block_id, citation, CAST(number AS INTEGER) AS number FROM cites",
    "SCL36": f"SELECT * FROM (SELECT doc_id, block_id, regexp_extract(lower(content), {text_of(scalars.FIGURE)}, 1) AS figure, regexp_extract(lower(content), {text_of(scalars.SHORT_FIGURE)}, 1) AS short FROM blocks) WHERE figure <> '' OR short <> ''",
    "SCL37": "SELECT doc_id, i - 1 AS chunk, substr(text, CAST((i - 1) * 2500 + 1 AS BIGINT), 2500) AS piece FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 2500.0) AS BIGINT))) AS i FROM deco)",
    "SCL38": """SELECT doc_id, chunk, piece FROM (WITH RECURSIVE cut AS (SELECT doc_id, text, 0 AS chunk, 0 AS at_char, CASE WHEN 1400 < length(text) AND 1400 - length(regexp_extract(substr(text, 1, 1400), '([^.!?]*)$', 1)) > 630 THEN substr(text, 1, 1400 - length(regexp_extract(substr(text, 1, 1400), '([^.!?]*)$', 1))) ELSE substr(text, 1, 1400) END AS piece FROM deco
        UNION ALL SELECT doc_id, text, chunk + 1, n, CASE WHEN n + 1400 < length(text) AND 1400 - length(regexp_extract(substr(text, n + 1, 1400), '([^.!?]*)$', 1)) > 630 THEN substr(text, n + 1, 1400 - length(regexp_extract(substr(text, n + 1, 1400), '([^.!?]*)$', 1))) ELSE substr(text, n + 1, 1400) END
        FROM (SELECT *, CAST(at_char + greatest(1, length(piece) - 200) AS INTEGER) AS n FROM cut WHERE at_char + length(piece) < length(text) AND chunk < 39)) SELECT * FROM cut) WHERE piece <> ''""",
    "SCL39": """SELECT doc_id, CASE WHEN length(text) <= 1600 THEN text WHEN 1600 - length(regexp_extract(t, '([^.!?]*)$', 1)) > 960 AND regexp_matches(t, '[.!?]') THEN substr(t, 1, 1600 - length(regexp_extract(t, '([^.!?]*)$', 1)))
        WHEN length(regexp_extract(t, '^(.*) [^ ]*$', 1)) > 0 THEN substr(t, 1, length(regexp_extract(t, '^(.*) [^ ]*$', 1))) ELSE t END AS fragment FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text, substr(replace(text, chr(10), ' '), 1, 1600) AS t FROM deco)""",
    "SCL40": f"""SELECT doc_id, trim(CASE WHEN p > 0 THEN substr(text, p, 9000) ELSE substr(text, greatest(1, length(text) - 8999), 9000) END) AS ending FROM (SELECT doc_id, text, greatest({', '.join(f"CASE WHEN contains(lower(text), {text_of(h)}) THEN length(text) - strpos(reverse(lower(text)), reverse({text_of(h)})) - {len(h) - 2} ELSE 0 END" for h in scalars.HEADINGS_OF_END)}) AS p FROM (SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM deco))""",
    "SCL42": "SELECT doc_id, n_hits, CASE WHEN n_hits >= 2 THEN 100 WHEN n_hits = 1 THEN 50 ELSE 0 END AS percent FROM (SELECT doc_id, count(*) FILTER (regexp_matches(lower(content), 'state of the art|earlier work|research')) AS n_hits FROM blocks GROUP BY doc_id)",
    "SCL43": "SELECT doc_id, block_id, trim(regexp_replace(content, '[. ]*[0-9]+$', '')) AS chapter FROM blocks WHERE regexp_matches(content, '^[0-9]+(\\.[0-9]+)* \\p{L}')",
    "SCL44": "SELECT doc_id, page, CAST(trunc(px_width / ((vx1 - vx0) / 72)) AS INTEGER) AS dpi FROM visuals WHERE kind = 'image'",
    "SCL45": f"""SELECT doc_id, block_id, replace(replace(replace(url_encode('"' || substr({_clean('content')}, 1, 300) || '"'), '%20', '+'), '~', '%7E'), '%2A', '*') AS query FROM blocks""",
    "SCL49": "SELECT doc_id, block_id, page, line, count(*) AS n_gaps, sum(CASE WHEN gap > 7.2 THEN 2 ELSE 1 END) AS n_spaces FROM (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, block_id, page, line ORDER BY word_index) AS gap FROM words) WHERE gap IS NOT NULL GROUP BY ALL",
    "JN01": f"SELECT doc_id, seq, title, page FROM toc t WHERE NOT EXISTS (SELECT 1 FROM page_texts p WHERE p.doc_id = t.doc_id AND p.page = t.page AND contains(lower({_clean('page_text')}), lower({_clean('t.title')})))",
    "JN04": "SELECT c.doc_id, c.block_id, citation, count(*) AS missing FROM cites c JOIN blocks b USING (doc_id, block_id) LEFT JOIN bib ON bib.doc_id = c.doc_id AND bib.number = c.number WHERE bib.number IS NULL AND NOT regexp_matches(b.content, '^\\[[0-9]+\\] ') GROUP BY ALL",
    "JN05": f"SELECT m.doc_id, m.block_id, m.start, page, line, min(word_index) AS first_word, max(word_index) AS last_word, min(x0) AS x0, max(x1) AS x1 FROM {_spans('[0-9]+[.,][0-9]+')} m JOIN words w ON w.doc_id = m.doc_id AND w.block_id = m.block_id AND m.start < w.end_char AND m.stop > w.start_char GROUP BY ALL",
    "JN06": "SELECT doc_id, block_id, page FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM visuals v WHERE v.doc_id = b.doc_id AND v.page = b.page AND v.kind = 'image' AND b.x0 >= vx0 - 10 AND b.y0 >= vy0 - 10 AND b.x1 <= vx1 + 10 AND b.y1 <= vy1 + 10)",
    "JN07": "SELECT doc_id, block_id, page FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM visuals v WHERE v.doc_id = b.doc_id AND v.page = b.page AND v.kind = 'table' AND b.x0 >= vx0 - 10 AND b.y0 >= vy0 - 10 AND b.x1 <= vx1 + 10 AND b.y1 <= vy1 + 10)",
    "JN08": "SELECT doc_id, block_id, page FROM boxes WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM list_pages)",
    "JN09": """SELECT doc_id, block_id, word_index, page, line, text FROM (SELECT w.*, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x0 DESC, block_id, word_index) AS r FROM words w) w JOIN main_size USING (doc_id)
        WHERE r = 1 AND regexp_matches(text, '^[A-Za-z]$') AND size >= main_size * 0.8 AND NOT EXISTS (SELECT 1 FROM words o WHERE o.doc_id = w.doc_id AND o.page = w.page AND w.x1 + 1 <= o.x1 AND w.x1 + 50 >= o.x0 AND w.y0 <= o.y1 AND w.y1 >= o.y0)""",
    "JN10": """SELECT doc_id, block_id, page, kind, vy0, gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, page ORDER BY gap, vy0) AS r FROM (
        SELECT b.doc_id, b.block_id, b.page, v.kind, vy0, greatest(0.0, y0 - vy1, vy0 - y1) AS gap FROM boxes b JOIN captions c USING (doc_id, block_id) JOIN visuals v ON v.doc_id = b.doc_id AND v.page = b.page AND v.kind = c.kind)) WHERE r = 1""",
    "JN14": """SELECT u.doc_id, u.acronym, used[1] AS block_id, used[2] AS start, CASE WHEN defined IS NULL THEN 'undefined' ELSE 'used_before_definition' END AS problem FROM (SELECT doc_id, acronym, min([block_id, start]) AS used FROM uses GROUP BY ALL) u
        LEFT JOIN (SELECT doc_id, acronym, min([block_id, start]) AS defined FROM definitions GROUP BY ALL) d ON u.doc_id = d.doc_id AND u.acronym = d.acronym WHERE defined IS NULL OR used < defined""",
    "JN18": """SELECT c.doc_id, c.figure, count(m.block_id) AS mentions FROM captions c LEFT JOIN (SELECT DISTINCT doc_id, block_id, unnest(regexp_extract_all(lower(content), '(?:rys|fig|figure)\\.? ?([0-9]+(?:\\.[0-9]+)*)', 1)) AS n FROM blocks WHERE length(content) >= 50) m
        ON m.doc_id = c.doc_id AND m.n = c.figure AND m.block_id <> c.block_id WHERE c.kind = 'image' GROUP BY ALL""",
    "JN19": """SELECT doc_id, figure, array_to_string(rs, '; ') AS reasons, len(rs) AS n_reasons FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS figure, list_filter([a.r, b.r], lambda x: x IS NOT NULL) AS rs
        FROM (SELECT doc_id, page, 'low resolution' AS r FROM visuals WHERE trunc(px_width / ((vx1 - vx0) / 72)) < 75) a FULL JOIN (SELECT doc_id, page, 'raster' AS r FROM visuals WHERE image_type = 'raster' AND kind = 'image') b ON a.doc_id = b.doc_id AND a.page = b.page)""",
    "JN20": f"""SELECT doc_id, count(*) FILTER (p AND e) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.p, b.e FROM
        (SELECT *, true AS p, row_number() OVER (PARTITION BY doc_id, block_id, ws) AS rn FROM ({_word_sets('[0-9]+[.,][0-9]+')})) a FULL JOIN (SELECT *, true AS e, row_number() OVER (PARTITION BY doc_id, block_id, ws) AS rn FROM ({_word_sets('[0-9]+[.][0-9]+')})) b ON a.doc_id = b.doc_id AND a.block_id = b.block_id AND a.ws = b.ws AND a.rn = b.rn) GROUP BY doc_id""",
    "JN21": "SELECT s.doc_id, seq, number, title, level, count(b.block_id) AS n_blocks, coalesce(sum(length(content)), 0) AS n_chars FROM sections s LEFT JOIN blocks b ON b.doc_id = s.doc_id AND b.block_id > s.start AND (s.stop IS NULL OR b.block_id < s.stop) GROUP BY ALL",
    "JN22": "SELECT doc_id, seq, number, level, (SELECT min(o.start) FROM sections o WHERE o.doc_id = s.doc_id AND o.start > s.start AND o.level <= s.level) AS until FROM sections s",
    "JN25": "SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)), 6) AS cosine FROM embeddings",
    "JN26": "SELECT doc_id, string_agg(text, ' ' ORDER BY line) AS text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM (SELECT doc_id, line, string_agg(text, ' ' ORDER BY x0, block_id, word_index) AS text FROM words WHERE page = 0 AND x0 <= 250 AND x1 >= 100 AND y0 <= 150 AND y1 >= 80 GROUP BY doc_id, line)) WHERE before IS NULL OR before <> text GROUP BY doc_id",
    "AG01": "SELECT doc_id, count(*) - 1 AS pages FROM sheets GROUP BY doc_id",
    "AG02": "SELECT doc_id, font, size, count(*) AS n FROM words GROUP BY ALL",
    "AG03": "SELECT doc_id, arg_min(size, (-n, first)) AS dominant, max(n) AS dominant_count FROM (SELECT doc_id, size, count(*) AS n, min((block_id, word_index)) AS first FROM words GROUP BY ALL) GROUP BY doc_id",
    "AG05": "SELECT doc_id, list_sort(list(size))[count(*) // 2 + 1] AS median FROM words GROUP BY doc_id",
    "AG07": "SELECT doc_id, page, line, coalesce(median(gap) FILTER (gap > 0), 3.0) AS gap FROM (SELECT doc_id, page, line, x0 - lag(x1) OVER (PARTITION BY doc_id, block_id, page, line ORDER BY word_index) AS gap FROM words) GROUP BY ALL",
    "AG12": "SELECT doc_id, block_id, page, x0, y0, x1, y1 FROM boxes",
    "AG13": "SELECT doc_id, seq, citations FROM section_cites",
    "AG14": "SELECT label, count(*) AS n, count(*) FILTER (cosine < 0.785) AS below, round(avg(cosine), 5) AS average, round(100.0 - 100.0 * count(*) FILTER (cosine < 0.785) / count(*), 4) AS grade FROM (SELECT e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.v AS DOUBLE[])), 6) AS cosine FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) p USING (label)) GROUP BY label",
    "AG17": "SELECT doc_id, count(*) FILTER (image_type = 'raster') AS bad, count(*) FILTER (image_type <> 'raster') AS good FROM visuals WHERE kind = 'image' GROUP BY doc_id",
    "AG18": "SELECT doc_id, string_agg(number || ': ' || entry, chr(10) ORDER BY number, entry) AS summary FROM bib GROUP BY doc_id",
    "AG19": """SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy
        FROM (SELECT count(*) FILTER (p = 1 AND toxic = 1) AS tp, count(*) FILTER (p = 1 AND toxic = 0) AS fp, count(*) FILTER (p = 0 AND toxic = 1) AS fn, count(*) FILTER (p = 0 AND toxic = 0) AS tn FROM (SELECT toxic, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)))""",
    "AG21": "SELECT doc_id, lower(text) AS lemma, count(*) AS n, count(*) > 2 AS accepted FROM tokens WHERE length(text) > 12 GROUP BY ALL",
    "AG22": "SELECT w.doc_id, min(w.size) AS header_size FROM words w JOIN main_size m ON m.doc_id = w.doc_id AND w.size > m.main_size GROUP BY ALL",
    "WN01": """SELECT doc_id, block_id, kind, text FROM (SELECT doc_id, block_id, arg_max(text, word_index) AS text, CASE WHEN list(lineno ORDER BY word_index)[-1] <> list(lineno ORDER BY word_index)[-2] THEN 1 WHEN list(lineno ORDER BY word_index)[-2] <> list(lineno ORDER BY word_index)[-3] THEN 2 ELSE 0 END AS kind
        FROM (SELECT *, page * 1000 + line AS lineno FROM words) GROUP BY doc_id, block_id HAVING count(*) >= 10) WHERE kind > 0""",
    "WN02": "SELECT doc_id, block_id, page, n_words FROM (SELECT *, min(page) OVER w AS a, max(page) OVER w AS z FROM (SELECT doc_id, block_id, page, count(DISTINCT line) AS n_lines, count(*) AS n_words FROM words GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id, block_id)) WHERE a < z AND page = z AND n_lines <= 2",
    "WN03": "SELECT doc_id, block_id, page, n_words FROM (SELECT *, min(page) OVER w AS a, max(page) OVER w AS z FROM (SELECT doc_id, block_id, page, count(DISTINCT line) AS n_lines, count(*) AS n_words FROM words GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id, block_id)) WHERE a < z AND page = a AND n_lines = 1",
    "WN04": """SELECT doc_id, paragraph, count(*) AS n_lines, sum(n_words) AS n_words, min(page) AS page FROM (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY page, line) AS paragraph FROM (
        SELECT *, CASE WHEN lag(text) OVER w IS NULL THEN 1 WHEN regexp_matches(lag(text) OVER w, '[.!?:;]$') AND lag(block_id) OVER w <> block_id THEN 1 ELSE 0 END AS brk FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY page, line))) GROUP BY doc_id, paragraph""",
    "WN06": "SELECT doc_id, section, count(*) AS n_blocks FROM (SELECT *, sum(CASE WHEN n_words < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_id) AS section FROM placed) GROUP BY ALL",
    "WN09": "SELECT doc_id, min(seq) AS seq FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM toc) WHERE page < before GROUP BY doc_id",
    "WN10": """SELECT a.doc_id, a.page, count(*) AS n_gaps FROM gaps a JOIN gaps b ON a.doc_id = b.doc_id AND a.page = b.page AND b.line = a.line + 1 AND a.g0 < b.g1 AND b.g0 < a.g1 GROUP BY ALL""",
    "WN12": "SELECT doc_id, block_id FROM (SELECT *, max(CASE WHEN regexp_matches(lower(content), '^(bibliography|references|bibliografia)') THEN block_id END) OVER (PARTITION BY doc_id ORDER BY block_id) AS opened FROM blocks) WHERE block_id > opened",
    "WN15": "SELECT doc_id, block_id, min(word_index) AS first, max(word_index) AS last, string_agg(text, ' ' ORDER BY word_index) AS text FROM (SELECT w.*, word_index - row_number() OVER (PARTITION BY w.doc_id, w.block_id ORDER BY word_index) AS i FROM words w JOIN bib b ON b.doc_id = w.doc_id AND b.block_id = w.block_id WHERE italic AND word_index > 0) GROUP BY doc_id, block_id, i",
    "WN16": "SELECT doc_id, key, block_id FROM (SELECT doc_id, block_id, lower(content) AS key, row_number() OVER (PARTITION BY doc_id, lower(content) ORDER BY block_id DESC) AS r FROM placed WHERE n_words < 6) WHERE r = 1",
    "WN17": "SELECT doc_id, acronym, min(block_id) AS block_id FROM uses GROUP BY ALL",
    "WN19": "SELECT * FROM (SELECT doc_id, block_id, i AS sentence, lag(s) OVER (PARTITION BY doc_id ORDER BY block_id, i) AS previous FROM (SELECT doc_id, block_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, block_id, regexp_extract_all(content, '[^.!?]+[.!?]+') AS ss FROM blocks)) WHERE length(s) >= 40) WHERE previous IS NOT NULL",
    "WN20": "SELECT doc_id, page, kind, round(width / n * i + 5, 3) AS sx0, round(width / n * (i + 1) - 5, 3) AS sx1 FROM (SELECT v.doc_id, v.page, v.kind, s.width, count(*) OVER (PARTITION BY v.doc_id, v.page) AS n, row_number() OVER (PARTITION BY v.doc_id, v.page ORDER BY v.kind) - 1 AS i FROM visuals v JOIN sheets s USING (doc_id, page))",
    "WN21": "SELECT doc_id, block_id, 'ERR_' || row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS finding FROM placed WHERE n_words < 3",
    "SL01": "SELECT doc_id, seq, n_chars, citations, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN most > 0 THEN citations ELSE n_chars END DESC, seq) AS r FROM (SELECT *, max(citations) OVER (PARTITION BY doc_id) AS most FROM section_cites) WHERE most = 0 OR citations > 0) WHERE r <= 3",
    "SL02": "SELECT doc_id, arg_min(seq, (-citations, seq)) AS seq, max(citations) AS citations FROM section_cites WHERE citations > 0 GROUP BY doc_id",
    "SL03": f"SELECT doc_id, min(seq) AS seq FROM section_cites WHERE n_chars >= 200 AND NOT {_any('lower(title)', OTHER_CHAPTERS['en'])} AND {_any('lower(title)', ART_TITLES['en'])} GROUP BY doc_id",
    "SL07": "SELECT doc_id, source, lang FROM documents WHERE contains(lower(source), 'src1')",
    "ST03": "SELECT doc_id, count(*) AS unknown FROM (SELECT DISTINCT doc_id, number FROM cites EXCEPT SELECT doc_id, number FROM bib) GROUP BY doc_id",
    "ST04": "SELECT DISTINCT doc_id, number FROM sections",
    "ST05": "SELECT DISTINCT doc_id, text, round(x0 / 100, 1) AS x, round(y0 / 100, 1) AS y, page FROM words WHERE length(text) <= 2",
    "ST06": "SELECT DISTINCT doc_id, block_id FROM tokens a WHERE regexp_matches(text, '^[0-9]+[.,][0-9]+') AND EXISTS (SELECT 1 FROM tokens b WHERE b.doc_id = a.doc_id AND b.block_id = a.block_id AND abs(a.word_index - b.word_index) <= 3 AND lower(b.text) IN ('section', 'value', 'cost', 'kg', 'range'))",
}
TABLES["chapter_numbers"] = f"""SELECT doc_id, unnest(regexp_extract_all(t, {text_of(_CHAPTER_NUMBER)}, 2)) AS number FROM (SELECT doc_id, title AS t FROM toc UNION ALL SELECT doc_id, number || ' ' || title FROM tof UNION ALL SELECT doc_id, number || ' ' || title FROM tot)
    UNION ALL SELECT doc_id, regexp_extract(content, {text_of(_CHAPTER_NUMBER)}, 2) FROM captions WHERE regexp_extract(content, {text_of(_CHAPTER_NUMBER)}, 2) <> ''"""
TABLES["gaps"] = "SELECT * FROM (SELECT doc_id, page, line, x1 AS g0, lead(x0) OVER (PARTITION BY doc_id, page, line ORDER BY x0) AS g1 FROM words) WHERE g1 IS NOT NULL"
_BODY["WN07"] = """SELECT doc_id, min(block_id) AS block_id, count(*) AS parts, string_agg(content, ' ' ORDER BY block_id) AS title FROM (SELECT *, sum(CASE WHEN r = lag_r + 1 AND font = lag_font AND abs(size - lag_size) < 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_id) AS i FROM (
        SELECT *, lag(r) OVER w AS lag_r, lag(font) OVER w AS lag_font, lag(size) OVER w AS lag_size FROM (SELECT p.doc_id, p.block_id, content, n_words, r, font, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS r FROM placed) p JOIN words f ON f.doc_id = p.doc_id AND f.block_id = p.block_id AND f.word_index = 0 WHERE n_words < 6)
        WINDOW w AS (PARTITION BY doc_id ORDER BY block_id))) GROUP BY doc_id, i"""


def oracle_sql() -> dict[str, str]:
    from quire.plans import captions, details, inputs, rules  # noqa: F401  they add to ORACLES

    rules.complete_sql()
    return {k: with_tables(v) for k, v in {**_BODY, **rules.ORACLES}.items()}
