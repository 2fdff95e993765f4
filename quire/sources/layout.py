"""Layout that was extracted elsewhere: nested JSON pages in, table rows out; PDFs by an optional parser.

A page in JSON is {doc_id, page, words: [{block_id, word_index, text, line, x0, y0, x1, y1, font, size, bold, italic, start_char, end_char}]}; what a
file lacks is null. ``quire.sources.corpus.corpus_of_words`` makes a corpus of the words, on which the rules run as they do on texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "block_id int, word_index int, text string, line int, x0 double, y0 double, x1 double, y1 double, font string, size double, bold boolean, italic boolean, start_char int, end_char int"
PAGE = f"doc_id long, page int, words array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>"
EXTRACTED = f"path string, page int, {WORD}, error string"


def to_json_text(words: DataFrame) -> DataFrame:
    """(doc_id, json): one document's page a row."""
    w = F.struct(*(x.split()[0] for x in WORD.split(", ")))
    return words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(w)).alias("words")).select("doc_id", F.to_json(F.struct("doc_id", "page", "words")).alias("json"))


def from_json_text(rows: DataFrame) -> DataFrame:
    """Words of pages in a JSON column. A page that doesn't parse gives no words."""
    p = rows.select(F.from_json("json", PAGE).alias("p")).select("p.*")
    return p.select("doc_id", "page", F.inline("words"))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Words of layout files: JSON lines, or Parquet with the same columns."""
    pages = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(PAGE).json(path)
    return pages.select("doc_id", "page", F.inline("words"))


def write_layout(words: DataFrame, path: str) -> None:
    to_json_text(words).select("json").write.text(path)


def read_documents(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]] | None = None, pattern: str = "*.pdf") -> DataFrame:
    """Words of all documents below a path by ``parser(bytes) -> [{page, block_id, ...}]``.

    A file that the parser refuses gives one row with its message in ``error``, and the others go
    on. Without a parser, PyMuPDF is used where it is installed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parsed(files, parser or _pymupdf())


def parsed(files: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """The words of files (path, content), or a file's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in EXTRACTED.split(", ")]
        for batch in batches:
            for path_, data in zip(batch["path"], batch["content"]):
                try:
                    rows, error = parser(bytes(data)), None
                except Exception as e:  # one bad file must not end the batch
                    rows, error = [{}], f"{type(e).__name__}: {e}"
                out = pd.DataFrame([{"path": path_, "error": error} | r for r in rows], columns=names, dtype=object)
                yield out.where(out.notna(), None).astype({n: "Int32" for n in ("page", "block_id", "word_index", "line", "start_char", "end_char")})

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def _pymupdf() -> Callable[[bytes], list[dict]]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDFs needs a parser, or PyMuPDF to be installed") from e

    def parse(data: bytes) -> list[dict]:
        rows = []
        for number, page in enumerate(fitz.open(stream=data, filetype="pdf")):
            spans = [(b["number"], s) for b in page.get_text("dict")["blocks"] for ln in b.get("lines", ()) for s in ln["spans"]]
            for i, (x0, y0, x1, y1, text, block, line, _) in enumerate(page.get_text("words")):
                own = next((s for n, s in spans if n == block and s["bbox"][0] - 0.2 <= x0 and x1 <= s["bbox"][2] + 0.2 and s["bbox"][1] - 1 <= y0 and y1 <= s["bbox"][3] + 1), {})
                style = {"font": own.get("font"), "size": own.get("size"), "bold": bool(own.get("flags", 0) & 16), "italic": bool(own.get("flags", 0) & 2)}
                rows.append({"page": number, "block_id": block, "word_index": i, "text": text, "line": line, "x0": x0, "y0": y0, "x1": x1, "y1": y1} | style)
        return rows

    return parse
