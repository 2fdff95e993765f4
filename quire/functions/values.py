"""Aggregates and predicates that rules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dominant(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str = "dominant") -> DataFrame:
    """The most frequent value of each key; of equally frequent ones, the one that is met first in ``order``."""
    each = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    rank = F.struct((-F.col("__n")).alias("n"), "__first", value)
    return each.groupBy(*keys).agg(F.min(rank).alias("__r")).select(*keys, F.col(f"__r.{value}").alias(name), (-F.col("__r.n")).alias(f"{name}_count"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def inside(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1, slack: float) -> Column:
    """Whether box a lies in box b widened by ``slack``."""
    return (ax0 >= bx0 - slack) & (ay0 >= by0 - slack) & (ax1 <= bx1 + slack) & (ay1 <= by1 + slack)


def intersect(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Whether two closed boxes meet."""
    return (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
