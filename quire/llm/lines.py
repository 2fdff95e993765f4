"""Line dedup by a suffix array over line-ID sequences. DataFrame functions only.

A document is the sequence of its non-blank lines, trimmed; a line's ID is two XXH64 values. Ranks
of runs of 1, 2, 4, ... lines come from distributed prefix doubling: the rank of 2d lines at a
position is the place of the pair (rank of d lines here, rank of d lines d further on) among all
such pairs in sorted order. Positions of one rank at depth d are an interval of the suffix array
whose longest common prefix is d lines or more. A position whose run occurs once leaves, so every round
works on the repeated ones only, and the rounds end when no run of that depth repeats.

Each later position goes to the deepest interval in which it is not the first, and its longest common prefix with
the interval's first position is measured by the ranks of all smaller depths, from the largest down: the
prefix grows by d lines wherever the two ranks of d lines behind it agree. A prefix of ``min_lines``
lines or more, or of one line of ``long_line`` characters or more, is a copied run; runs that a longer one
with the same first copy begins one line before are left out, which leaves the maximal ones (``runs``). The lines of all runs
are deleted. These are the lines of all windows of ``min_lines`` lines that are met earlier: a
run's windows are met earlier, and a window that is met earlier begins a run of its length or more.

Cases: blank lines are transparent and stay; null and empty texts have no lines and stay as they
are; earlier means smaller id, then smaller hash of the whole text, then scanned earlier, which tells equal rows apart only; of
repeated rows all but the first lose their lines; null ids come last; a document that
loses its every non-blank line is dropped by ``dedup``; a document's lines are held as one array, so a document must
fit a task; empty input gives no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch
from quire.llm.text import free

MIN_LINES, LONG_LINE = 2, 100
EDGE = " \t\r\v\f"


def items(text: Column, long_line: int = LONG_LINE) -> Column:
    """The non-blank lines as structs (line, h1, h2, long); line counts all lines from 0."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(EDGE)).alias("t"))), lambda s: s["t"] != "")
    names = lambda s: F.struct(s["line"].alias("line"), F.xxhash64(s["t"]).alias("h1"), F.xxhash64(F.lit(1), s["t"]).alias("h2"), (F.length(s["t"]) >= long_line).alias("long"))
    return F.transform(kept, names)


#: What orders positions: null ids last, the id, the text's hash, the row; then the position in it.
WHO = ("id", "hash", "rid")


def sequences(table: DataFrame) -> DataFrame:
    """(rid, id, hash, pos, line, h1, h2, long) from (rid, id, hash, items); pos counts the non-blank lines."""
    return table.select(*WHO, F.posexplode("items").alias("pos", "s")).select(*WHO, "pos", "s.*")


def _named(rows: DataFrame, x: str, y: str, scratch: Scratch) -> DataFrame:
    """(x, y, rank) of the pairs that occur twice or more; rank follows their sorted order."""
    pairs = rows.groupBy(x, y).agg(F.count("*").alias("n")).where("n > 1").select(F.col(x).alias("__x"), F.col(y).alias("__y"))
    return scratch.table(pairs.orderBy("__x", "__y").withColumn("rank", F.monotonically_increasing_id()), "names")


def _ahead(steps: int) -> Column:
    """The rank ``steps`` lines further on; null where that position has none."""
    return F.max("rank").over(Window.partitionBy("rid").orderBy("pos").rangeBetween(steps, steps))


def _doubled(ranks: DataFrame, steps: int, scratch: Scratch, name: str) -> DataFrame:
    """Ranks of runs that are ``steps`` lines longer, of the positions where they repeat."""
    p = ranks.withColumn("__far", _ahead(steps)).where("__far is not null")
    p = scratch.table(p, "pairs")
    names = _named(p, "rank", "__far", scratch)
    j = p.join(names, (p["rank"] == F.col("__x")) & (p["__far"] == F.col("__y")))
    out = scratch.table(j.select(*WHO, "pos", names["rank"]), name)
    scratch.drop(p, names)
    return out


def ranked(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Depth 1: the lines that occur twice or more, with their rank."""
    names = _named(lines, "h1", "h2", scratch)
    j = lines.join(names, (F.col("h1") == F.col("__x")) & (F.col("h2") == F.col("__y")))
    out = scratch.table(j.select(*WHO, "pos", "line", "long", "rank"), "depth1")
    scratch.drop(names)
    return out


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """(depth, (id, hash, rid, pos, rank)) for depths 1, 2, 4, ... as long as a run of that depth repeats."""
    levels = [(1, ranked(lines, scratch))]
    while True:
        depth, ranks = levels[-1]
        deeper = _doubled(ranks.select(*WHO, "pos", "rank"), depth, scratch, f"depth{2 * depth}")
        if deeper.isEmpty():
            scratch.drop(deeper)
            return levels
        levels.append((2 * depth, deeper))


def _later(ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, pos, qid, qrid, qpos) of the members of each rank but the first in corpus order, which is q."""
    who = F.struct(F.col("id").isNull().alias("no"), *WHO, "pos")
    first = ranks.groupBy(F.col("rank").alias("__rank")).agg(F.min(who).alias("q"))
    # written, so that the join reads both sides from an exchange and AQE can split a run that very many share
    first = scratch.table(first.select("__rank", F.col("q.id").alias("qid"), F.col("q.rid").alias("qrid"), F.col("q.pos").alias("qpos")), "first")
    j = ranks.join(first, F.col("rank") == F.col("__rank"))
    return j.where((F.col("rid") != F.col("qrid")) | (F.col("pos") != F.col("qpos"))).select("rid", "pos", "qid", "qrid", "qpos")


def _longer(runs_: DataFrame, ranks: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """runs_ with their common prefixes depth lines longer where the ranks behind them agree."""
    side = lambda n: ranks.select(F.col("rid").alias(f"__r{n}"), F.col("pos").alias(f"__p{n}"), F.col("rank").alias(f"__k{n}"))
    at = lambda rid, pos, n: (F.col(rid) == F.col(f"__r{n}")) & (F.col(pos) + F.col("length") == F.col(f"__p{n}"))
    j = runs_.join(side(1), at("rid", "pos", 1), "left").join(side(2), at("qrid", "qpos", 2), "left")
    more = F.coalesce((F.col("__k1") == F.col("__k2")).cast("int"), F.lit(0)) * depth
    out = scratch.table(j.withColumn("length", F.col("length") + more).select(*runs_.columns), "runs")
    scratch.drop(runs_)
    return out


def _at_depth(levels: list[tuple[int, DataFrame]], depth: int, scratch: Scratch) -> DataFrame:
    """Ranks of runs of depth lines, which lie between two levels: two overlapping runs of the lower one."""
    lower, ranks = [x for x in levels if x[0] <= depth][-1]
    return _doubled(ranks.select(*WHO, "pos", "rank"), depth - lower, scratch, "between")


def common_prefixes(levels: list[tuple[int, DataFrame]], scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """(rid, pos, qid, qrid, qpos, length): of every later position, the first position of its deepest interval and their longest common prefix.

    The intervals of min_lines lines are among the depths, so a run of that length that was met earlier is never missed.
    """
    found, depths = None, list(levels)
    if min_lines & (min_lines - 1) and min_lines < 2 * levels[-1][0]:
        depths = sorted([*levels, (min_lines, _at_depth(levels, min_lines, scratch))], key=lambda x: x[0])
    for depth, ranks in reversed(depths):
        if found is not None and not depth & (depth - 1):
            found = _longer(found, ranks, depth, scratch)
        new = _later(ranks, scratch).withColumn("length", F.lit(depth))
        if found is not None:
            new = new.join(found.select(F.col("rid").alias("__r"), F.col("pos").alias("__p")), (F.col("rid") == F.col("__r")) & (F.col("pos") == F.col("__p")), "left_anti").unionByName(found)
        old, found = found, scratch.table(new, "runs")
        if old is not None:
            scratch.drop(old)
    return found


def maximal(prefixes: DataFrame, base: DataFrame, min_lines: int) -> DataFrame:
    """The prefixes of min_lines or more that no longer one with the same first copy begins a line before, and other copied long lines."""
    along = Window.partitionBy("rid", "qrid", F.col("pos") - F.col("qpos")).orderBy("pos")
    whole = prefixes.where(F.col("length") >= min_lines)
    whole = whole.withColumn("__inner", F.coalesce(F.lag("pos").over(along) == F.col("pos") - 1, F.lit(False))).where("not __inner").drop("__inner")
    long = base.where("long").select(F.col("rid").alias("__r"), F.col("pos").alias("__p"))
    single = prefixes.where(F.col("length") < min_lines).join(long, (F.col("rid") == F.col("__r")) & (F.col("pos") == F.col("__p")), "left_semi")
    return whole.unionByName(single.withColumn("length", F.lit(1)))


def copied(levels: list[tuple[int, DataFrame]], scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """(rid, line) of every line that a run covers."""
    base = levels[0][1]
    found = maximal(common_prefixes(levels, scratch, min_lines), base, min_lines)
    starts = found.groupBy(F.col("rid").alias("__r"), F.col("pos").alias("__p")).agg(F.max(F.col("pos") + F.col("length")).alias("until"))
    j = base.select("rid", "pos", "line").join(starts, (F.col("rid") == F.col("__r")) & (F.col("pos") == F.col("__p")), "left")
    upto = F.max("until").over(Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("__upto", upto).where("__upto > pos").select("rid", "line")


def _items(docs: DataFrame, rid: Column, text: str, key: str, long_line: int) -> DataFrame:
    return docs.select(rid.alias("rid"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), items(F.col(text), long_line).alias("items"))


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """One row per maximal copied run: key, line, n_lines, first_key, first_line (lines counted from 0, blank ones included), n_lines without blank ones."""
    scratch = Scratch(docs.sparkSession, "lines")
    d = scratch.table(_items(docs, F.monotonically_increasing_id(), text, key, long_line), "lines")
    levels = suffix_ranks(sequences(d), scratch)
    base = levels[0][1]
    found = maximal(common_prefixes(levels, scratch, min_lines), base, min_lines)
    at = lambda n, *names: base.select(*(F.col(c).alias(a) for c, a in names), F.col("rid").alias(f"__r{n}"), F.col("pos").alias(f"__p{n}"))
    j = found.join(at(1, ("id", "__id"), ("line", "__line")), (F.col("rid") == F.col("__r1")) & (F.col("pos") == F.col("__p1")))
    j = j.join(at(2, ("line", "__first")), (F.col("qrid") == F.col("__r2")) & (F.col("qpos") == F.col("__p2")))
    return j.select(F.col("__id").alias(key), F.col("__line").alias("line"), F.col("length").alias("n_lines"), F.col("qid").alias("first_key"), F.col("__first").alias("first_line"))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """One row per document: key, n_lines, n_removed, removed (line numbers from 0), deepest.

    deepest is the largest power of two that a repeated run beginning in the document has lines
    for; 0 if no line of it repeats.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    d = scratch.table(_items(docs, F.monotonically_increasing_id(), text, key, long_line), "lines")
    levels = suffix_ranks(sequences(d), scratch)
    gone = copied(levels, scratch, min_lines).groupBy("rid").agg(F.array_join(F.array_sort(F.collect_list("line")).cast("array<string>"), ",").alias("removed"), F.count("*").alias("n_removed"))
    depth = levels[0][1].select("rid", F.lit(1).cast("long").alias("deepest"))
    for n, ranks in levels[1:]:
        depth = depth.unionByName(ranks.select("rid", F.lit(n).cast("long").alias("deepest")))
    depth = depth.groupBy("rid").agg(F.max("deepest").alias("deepest"))
    each = d.select(F.col("rid").alias("__rid"), F.col("id").alias(key), F.size("items").cast("long").alias("n_lines"))
    out = each.join(gone, each["__rid"] == gone["rid"], "left").drop("rid").join(depth, each["__rid"] == depth["rid"], "left")
    return out.select(key, "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"), F.coalesce("deepest", F.lit(0)).cast("long").alias("deepest"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """docs without the lines of later copies, and without documents that lose every non-blank line."""
    scratch = Scratch(docs.sparkSession, "lines")
    rid, flags, rest = free(docs, "__rid"), free(docs, "__flags"), free(docs, "__left")
    whole = scratch.table(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    d = scratch.table(_items(whole, F.col(rid), text, key, long_line), "lines")
    gone = copied(suffix_ranks(sequences(d), scratch), scratch, min_lines)
    # a byte for each line up to the last deleted one: 1 if it goes. Reading a byte takes the same time everywhere
    at = F.array_sort(F.collect_list("line"))
    gap = lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i == 0, 0).otherwise(F.col("at")[i - 1] + 1)), F.lit("1"))
    key_ = free(docs, "__r")
    gone = gone.groupBy("rid").agg(at.alias("at")).select(F.col("rid").alias(key_), F.array_join(F.transform("at", gap), "").cast("binary").alias(flags))
    gone = scratch.table(gone, "flags")
    # texts go through one shuffle at every size and aren't sorted; the small side is hashed by partition
    j = whole.join(gone.hint("shuffle_hash"), F.col(rid) == F.col(key_), "left")
    stays = lambda x, i: F.coalesce(F.substring(F.col(flags), i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))
    left = F.filter(F.split(F.col(text), "\n", -1), stays)
    j = j.withColumn(rest, F.when(F.col(flags).isNotNull(), left))
    j = j.where(F.col(rest).isNull() | F.exists(rest, lambda x: F.btrim(x, F.lit(EDGE)) != ""))
    new = F.coalesce(F.array_join(rest, "\n"), F.col(text))
    return j.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
