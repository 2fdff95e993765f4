"""Matches with offsets, which Spark's regular expressions don't give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(text: Column, pattern: str) -> Column:
    """array<struct<text, start, stop>> of all matches, which must not be empty; offsets count characters from 0.

    The i-th match begins behind the gaps 0..i and the matches 0..i-1; gaps are what the pattern
    splits the text into.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,stop:int>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        stop = begin + F.length(pair["m"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(pair["m"].alias("text"), begin.alias("start"), stop.alias("stop")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def mask(text: Column, parts: Column) -> Column:
    """text with every span of ``parts`` blanked by as many spaces, so offsets hold."""
    return F.aggregate(parts, text, lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["stop"] - s["start"]), s["start"] + 1, s["stop"] - s["start"]))
