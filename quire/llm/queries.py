"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import audio, exact, licenses, lines, mixing, sentencepiece_codec, simhash, toxicity, units, warc
from quire.llm.text import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.report(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.report(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: source/lang/group of 64 ids/id stands for one. A licence file is one that begins with its strongest notice."""
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(d.withColumn("path", path), (F.col("block") == 0) & (F.col("paragraph") == 0) & (F.col("item") == 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sentencepiece, op2_audio, op3_line_dedup, op4_simhash_near_dedup, op5_substring_dedup,
            op6_exact_dedup, op7_warc, op8_mixing, op9_licenses, op10_toxicity,
        )
    }


EXACT = """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


LINES = """
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
  FROM documents
), l AS (
  SELECT doc_id, line, trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t,
    row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos
  FROM parts WHERE trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
), pairs AS (
  SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l
), marked AS (
  SELECT *,
    length(t) >= 100 AND row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) > 1 AS single,
    nxt IS NOT NULL AND row_number() OVER (PARTITION BY t, nxt ORDER BY doc_id, pos) > 1 AS double
  FROM pairs
), covered AS (
  SELECT doc_id, line, single OR double OR coalesce(lag(double) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM marked
), removed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM covered WHERE gone GROUP BY doc_id
), seqs AS (
  SELECT doc_id, list(md5(t) ORDER BY pos) AS s, count(*) AS n FROM l GROUP BY doc_id
), runs AS (
  SELECT doc_id, d.depth, md5(array_to_string(list_slice(s, p.i, p.i + d.depth - 1), '')) AS run
  FROM seqs, (SELECT CAST(2 ** k AS BIGINT) AS depth FROM (SELECT unnest(generate_series(0, 12)) AS k)) d, LATERAL (SELECT unnest(generate_series(1, n - d.depth + 1)) AS i) p
), repeated AS (
  SELECT doc_id, depth, count(*) OVER (PARTITION BY depth, run) AS n FROM runs
), deepest AS (
  SELECT doc_id, max(depth) AS deepest FROM repeated WHERE n > 1 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(deepest, 0) AS deepest
FROM documents d LEFT JOIN seqs s USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN deepest USING (doc_id)
"""


UNITS = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), placed AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM l
), parts AS (
  SELECT *, regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') AS ps FROM placed
), cut AS (
  SELECT doc_id, n, ofs, unnest(ps) AS part, generate_subscripts(ps, 1) AS k
  FROM parts WHERE len(list_filter(ps, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) <> '')) > 1
), pieces AS (
  SELECT doc_id, 'line' AS kind, n, line AS part, ofs FROM placed
  UNION ALL
  SELECT doc_id, 'sentence', n, part, ofs + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) FROM cut
), units AS (
  SELECT doc_id, kind, n, ofs + length(part) - length(ltrim(part, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) AS start_char,
    trim(part, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS core
  FROM pieces
), keyed AS (
  SELECT doc_id, kind, n, start_char, start_char + length(core) AS end_char, lower(regexp_replace(core, '[ \\t\\r\\v\\f]+', ' ', 'g')) AS unit FROM units
), sized AS (
  SELECT *, length(unit) - length(replace(unit, ' ', '')) + 1 AS words FROM keyed WHERE unit <> ''
), ranked AS (
  SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_doc_id, first_value(start_char) OVER w AS keep_start
  FROM sized WHERE words >= 8 WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start_char)
)
SELECT doc_id, kind, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST(words AS INTEGER) AS words,
  keep_doc_id, CAST(keep_start AS INTEGER) AS keep_start
FROM (SELECT *, min(kind) OVER (PARTITION BY doc_id, n) AS whole FROM ranked WHERE r > 1) WHERE kind = 'line' OR whole = 'sentence'
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES, "op5_substring_dedup": UNITS, "op6_exact_dedup": EXACT}
