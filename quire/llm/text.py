"""Text expressions that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, SPACE + "+", -1))
    edge = F.when(t == "", 1).otherwise(t.rlike(f"^{SPACE}").cast("int") + t.rlike(rf"{SPACE}\z").cast("int"))
    return F.greatest(parts - edge, F.lit(0)).cast("long")


def one_space(text: Column) -> Column:
    """Each run of white space becomes one space. A lone space already is one and stays unmatched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, in any case of letters: name, with underscores behind it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to ``most``, or that are one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
