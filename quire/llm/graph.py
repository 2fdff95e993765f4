"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that an edge touches; root is the smallest node reachable.

    Each step hangs a node's neighbours under their minimum: large-star those larger than the
    node, small-star the rest. Minima are partial aggregates and written; the join back then reads
    both sides from an exchange and AQE may split it, so a node with very many neighbours isn't
    gathered in one task. Every round is written,
    and the rounds end when one changes nothing, after which every node hangs under its root.
    """
    hi, lo = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    e, seen = scratch.table(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges"), None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            return e.toDF("node", "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        both = e.toDF("u", "v").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        least = scratch.table(least, "least")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, "large")
        under = scratch.table(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "under")
        moved = large.join(under, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = scratch.table(moved.unionByName(under.toDF("a", "b")).distinct(), "edges")
        scratch.drop(e, large, least, under)
        e = new
