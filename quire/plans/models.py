"""Interfaces for what a model or a dictionary answers: each maps a column of texts in Arrow batches.

A model is a function from a list of texts to a list of answers. ``answers`` calls it once a batch
and keeps one instance a worker, made by ``make`` on first use, so nothing large is sent with the
task. Filter rows before: nothing is pushed through a Python operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import scalars as S

Model = Callable[[list[str]], list]
_made: dict[str, Model] = {}


def answers(rows: DataFrame, text: str, make: Callable[[], Model], name: str, kind: str = "string") -> DataFrame:
    """rows with a column ``name``: the model's answer to each text. Null texts get null without being asked."""

    @F.pandas_udf(kind)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _made.setdefault(name, make())
        for texts in batches:
            some = texts[texts.notna()]
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(some):
                out[some.index] = model(some.tolist())
            yield out

    return rows.withColumn(name, ask(F.col(text)))


def per_word(tokens: DataFrame, make: Callable[[], Model], name: str) -> DataFrame:
    """tokens with an answer a word, asked once for each distinct word."""
    known = answers(tokens.select("text").distinct(), "text", make, name)
    return tokens.join(known, "text", "left")


def purposes(chunks: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """(doc_id, purpose): the answer for the first chunk that gets one; an empty answer is none."""
    a = answers(chunks, "piece", make, "answer").where("answer <> ''")
    return a.groupBy("doc_id").agg(F.min_by(S.tidy_output(F.col("answer")), "chunk").alias("purpose"))


def goal_scores(texts: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """(doc_id, score): 0, 50 or 100 from the model's JSON reply to each document's ending."""
    a = answers(texts.select("doc_id", S.ending(F.col("text")).alias("ending")), "ending", make, "reply")
    return a.select("doc_id", S.parsed_score(F.col("reply")).alias("score"))


# What a vision model says of a chart that breaks a rule, and the rule.
CHART_RULES = (
    ("embedded_title", True, "title inside the chart"), ("has_axis_units", False, "axis without a unit"), ("axis_ends_with_dot", True, "axis label ends with a dot"),
    ("has_axis_arrows", True, "axis with an arrow"), ("is_polish", False, "text is not Polish"),
)


def _said(reply: Column, name: str) -> Column:
    """A boolean of a JSON reply, or of the first brace to the last, lower case; null if there is none."""
    whole = F.get_json_object(reply, f"$.{name}")
    return F.lower(F.coalesce(whole, F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), f"$.{name}")))


def chart_problems(replies: DataFrame) -> DataFrame:
    """(doc_id, figure, problems) of (doc_id, figure, reply): charts with axes that break a rule, the problems joined."""
    bad = (F.when(_said(F.col("reply"), n) == str(v).lower(), text) for n, v, text in CHART_RULES)
    r = replies.where(_said(F.col("reply"), "is_actual_chart_with_axes") == "true")
    return r.select("doc_id", "figure", F.array_join(F.array_compact(F.array(*bad)), "; ").alias("problems")).where("problems <> ''")


def chart_findings(figures: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """(doc_id, figure, problems) of (doc_id, figure, image) by a vision model's JSON replies."""
    return chart_problems(answers(figures, "image", make, "reply"))


def font_findings(replies: DataFrame) -> DataFrame:
    """(doc_id, figure, details) of (doc_id, figure, reply): figures whose fonts a vision model finds inconsistent. Without an answer a figure is consistent."""
    reason = F.coalesce(F.get_json_object("reply", "$.reason"), F.lit("font sizes differ"))
    return replies.where(F.coalesce(_said(F.col("reply"), "consistent"), F.lit("true")) == "false").select("doc_id", "figure", reason.alias("details"))


def overlapping_chunks(texts: DataFrame, size: int = 1400, overlap: int = 200, most: int = 40) -> DataFrame:
    """(doc_id, chunk, piece): pieces cut behind the last sentence end beyond 45 % of their size; the next begins ``overlap`` before that."""

    def cut(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text) and len(out) < most:
            part = text[at : at + size]
            if at + size < len(text):
                stop = max(part.rfind(x) for x in ".!?") + 1
                part = part[:stop] if stop > size * 0.45 else part
            out.append(part)
            if at + len(part) >= len(text):
                break
            at += max(1, len(part) - overlap)
        return out

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t) if t else [])

    return texts.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("chunk", "piece"))


def authors(entries: DataFrame) -> DataFrame:
    """(doc_id, number, authors): names in a row at the beginning of an entry, in one of five forms, joined by commas, "and" or "&"."""
    import re

    name = r"(?:\w\.[ -]?(?:\w\. ?)?[A-ZŁŚŻŹĆŃÓ][\w'-]+|[A-ZŁŚŻŹĆŃÓ][\w'-]+,? \w\.(?: ?\w\.)?|[A-ZŁŚŻŹĆŃÓ][a-ząćęłńóśźż]+ [A-ZŁŚŻŹĆŃÓ][a-ząćęłńóśźż]+)"
    chain = re.compile(rf"{name}(?:(?:, | and | & | i |; ){name})*")
    one = re.compile(name)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one.findall(m[0]) if t and (m := chain.match(t)) else [])

    return entries.select("doc_id", "number", found(F.col("entry")).alias("authors"))


def bare(text: Column) -> Column:
    """struct<text, index>: the text with every bracketed part, brackets included, as one space, and for each character its place in the original (and the original's length).

    Any closing bracket closes the last open one of either kind; brackets without a partner are masked singly. A stack of
    open brackets has no built-in form.
    """

    @F.pandas_udf("text string, index array<int>")
    def masked(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bare(t) if t is not None else (None, None) for t in texts], columns=["text", "index"])

    return masked(text)


def _bare(text: str) -> tuple[str, list[int]]:
    gone, opened = bytearray(len(text)), []
    for i, c in enumerate(text):
        if c in "([":
            opened.append(i)
        elif c in ")]":
            start = opened.pop() if opened else i
            gone[start : i + 1] = b"\1" * (i + 1 - start)
    for i in opened:
        gone[i] = 1
    kept = [i for i in range(len(text)) if not gone[i] or not i or not gone[i - 1]]
    return "".join(" " if gone[i] else text[i] for i in kept), [*kept, len(text)]
