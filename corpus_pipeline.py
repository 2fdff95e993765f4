"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing and encoding, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
before the next one. All but the last return the columns of ``documents``; documents that the mix
takes twice are two rows from there on. When a stage's table is written, the tables that it made on
the way and its predecessor's are removed.

Cases, in every stage: null texts count as empty and stay, null ids come last among equals, null sources are a
source of their own; a row is judged by its own text and place, so repeated rows are told apart by
the order of the scan only; empty tables give no rows; further columns are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import lines, mixing, sentencepiece_codec, simhash, toxicity
from quire.llm.scratch import Scratch, released
from quire.llm.text import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go. The chain learns from the labelled documents among docs; without a toxic one none go."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents that consist of them. Of equal rows all but the first go; texts without a line stay."""
    return lines.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, shingles of five words and a similarity of 0.8 or more, that with the smallest doc_id stays; texts without words are equal."""
    return simhash.dedup(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, taken once or taken twice so that sources come near their targets. Texts without words have no size and go."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and counts of every row's whole text, decoded again to verify them."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: SQL has no conditional random field and no SimHash; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, old = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if old is not None:
            scratch.drop(old)
        old = docs
    return docs
