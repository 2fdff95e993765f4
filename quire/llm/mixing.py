"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a hash. A source that is to give ``r`` words beyond whole passes takes the
documents whose hash lies below a threshold. The threshold is found without sorting: words are
summed by (source, leading hash bits), the bucket in which the running sum crosses ``r`` is
refined with the next bits, and so on; all other buckets are decided. What is left after
``LEVELS`` levels is one bucket of 2**-36 of the hash range, taken if that comes nearer.

Cases: null text has size 0 and takes 0; a null source is a source of its own, last in order;
rows that agree in doc_id and text share a hash and go together; empty input gives no rows;
other columns are carried and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch
from quire.llm.text import word_count

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BITS, LEVELS = 12, 3
#: A table of one row per source is broadcast only up to this many sources.
BROADCAST_SOURCES = 100_000


def _prefix(h: Column, level: int) -> Column:
    """The leading ``BITS * level`` bits of a hash, as a number from 0."""
    return F.shiftrightunsigned(h, 64 - BITS * level)


def measured(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with __src, __size and __h, next to the columns it has."""
    return docs.withColumns({"__src": F.col(source).cast("string"), "__size": word_count(F.col(text)), "__h": F.xxhash64(F.col(key), F.col(text))})


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Water filling over (__src, source_size): adds target, a double.

    Weights go by code-point order of the sources, null last, and repeat. A source is full when
    the level (words per unit of weight) reaches ``most * size / weight``; sources sorted by that
    ratio fill up in order, so one running sum gives the level: with F the sources before i and
    R = i and all after it, level_i = (budget - sum_F most*size) / sum_R weight, and the first i
    whose ratio exceeds level_i fixes the level for all that follow.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("__src").asc_nulls_last())
    k = F.row_number().over(order) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (k % len(weights) + 1).cast("int"))
    t = sizes.withColumn("__w", w).withColumn("__ratio", F.col("source_size") * most / F.col("__w"))
    up = one.orderBy("__ratio", F.col("__src").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    rest = F.sum("__w").over(up.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("__level", (F.sum("source_size").over(one) * share - full) / rest)
    t = t.withColumn("__open", F.col("__ratio") > F.col("__level"))
    t = t.withColumn("__i", F.row_number().over(up))
    level = F.min(F.when(F.col("__open"), F.struct("__i", F.col("__level").alias("l")))).over(one)["l"]
    cap = F.col("source_size") * most
    return t.select("__src", "source_size", F.when(level.isNull(), cap).otherwise(F.least(cap, level * F.col("__w"))).alias("target"))


def fit(narrow: DataFrame, scratch: Scratch, **kw) -> DataFrame:
    """From a written table (__src, __size, __h): per source source_size, target, passes and cut.

    A document is taken ``passes`` times, and once more if the leading BITS*LEVELS bits of its
    hash are below ``cut``.
    """
    n = narrow.select("__src", "__size", "__h").where("__size > 0")
    sizes = narrow.groupBy("__src").agg(F.sum("__size").alias("source_size"))
    plan = targets(sizes, **kw).withColumn("passes", F.floor(F.try_divide(F.col("target"), F.col("source_size"))))
    plan = plan.withColumn("passes", F.coalesce("passes", F.lit(0)))
    # the words that are still to be found below the crossing bucket, and that bucket's leading bits
    plan = scratch.table(plan.withColumns({"__left": F.col("target") - F.col("passes") * F.col("source_size"), "cut": F.lit(0).cast("long")}), "targets")
    few = plan.count() <= BROADCAST_SOURCES
    for level in range(1, LEVELS + 1):
        known = (F.broadcast(plan) if few else plan).select(F.col("__src").alias("__s"), "cut", "__left")
        inside = n.join(known, n["__src"].eqNullSafe(F.col("__s")) & (F.col("__left") > 0))
        if level > 1:
            inside = inside.where(_prefix(F.col("__h"), level - 1) == F.col("cut"))
        hist = inside.groupBy("__s", "__left", _prefix(F.col("__h"), level).alias("b")).agg(F.sum("__size").alias("words"))
        # at most 2**BITS rows a source: the first bucket whose running sum passes what is left
        run = F.sum("words").over(Window.partitionBy("__s").orderBy("b"))
        hist = hist.withColumn("__sum", run).withColumn("__over", F.col("__sum") > F.col("__left"))
        cross = hist.groupBy("__s").agg(F.min(F.when(F.col("__over"), F.struct("b", "__sum", "words"))).alias("x"), F.max("b").alias("last"))
        at = F.coalesce(F.col("x.b"), F.col("last") + 1)
        below = F.coalesce(F.col("x.__sum") - F.col("x.words"), F.lit(0))
        step = cross.select("__s", at.alias("__cut"), F.when(F.col("x").isNotNull(), below).alias("__below"), F.col("x.words").alias("__in"))
        old = plan
        j = plan.join(step, plan["__src"].eqNullSafe(F.col("__s")), "left")
        left = F.col("__left") - F.coalesce(F.col("__below"), F.col("__left"))
        cut = F.coalesce(F.col("__cut"), F.shiftleft(F.col("cut"), BITS))
        if level == LEVELS:  # the last bucket is taken whole if that comes nearer to the target
            cut = cut + F.when(F.coalesce(F.col("__in"), F.lit(0)) < 2 * left, 1).otherwise(0)
        plan = scratch.table(j.select("__src", "source_size", "target", "passes", left.alias("__left"), cut.alias("cut")), f"level{level}")
        scratch.drop(old)
    return plan.drop("__left")


def apply(measured_docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds size, source_size, target, times (0 to 2) and taken (times * size); documents aren't shuffled while sources are few."""
    few = plan.count() <= BROADCAST_SOURCES
    p = plan.select(F.col("__src").alias("__s"), F.col("source_size").alias("__ss"), F.col("target").alias("__t"), "passes", "cut")
    d = measured_docs.join(F.broadcast(p) if few else p, measured_docs["__src"].eqNullSafe(F.col("__s")), "left")
    times = F.col("passes") + (_prefix(F.col("__h"), LEVELS) < F.col("cut")).cast("long")
    times = F.least(times, F.lit(int(MOST)))
    return d.withColumns({"__times": times, "__taken": times * F.col("__size")})


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **kw) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mix")
    # the columns of docs travel as one, so none of them meets a name of this module
    m = measured(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(text).alias("__text"), F.col(source).alias("__source"), F.col(key).alias("__key")), "__text", "__source", "__key")
    out = apply(m, fit(scratch.table(m.select("__src", "__size", "__h"), "narrow"), scratch, **kw))
    return out.where("__times > 0").withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int")))).select("__row.*")


def report(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **kw) -> DataFrame:
    """One row per document: key, size, source_size, target, taken. Texts are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    n = scratch.table(measured(docs.select(key, text, source), text, source, key).select(key, "__src", "__size", "__h"), "narrow")
    out = apply(n, fit(n, scratch, **kw))
    return out.select(key, F.col("__size").alias("size"), F.col("__ss").alias("source_size"), F.col("__t").alias("target"), F.col("__taken").alias("taken"))
