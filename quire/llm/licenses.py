"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down the directory tree. DataFrame functions only.

A file is compared in parts of every size: the whole file; its blocks (between blank lines; in a comment,
the whole comment); the paragraphs of a block (between lines without a letter or digit, such as a bare
comment mark); and a paragraph's lines and sentences. Files and blocks are compared with templates of several
paragraphs, paragraphs also with those of several sentences, and lines, sentences and paragraphs of one sentence
with those of one sentence. A part's vector has a weight (1 + ln tf) * idf for each of its
terms, with idf from the templates; a term that no template has counts in the norm with the idf of a
term met once. The cosine to a template is a join of the part's terms with the template's terms, summed by part
and template. A part's template is that of the highest cosine, if that is ``LEAST`` or more; a file's
own license is that of the part with the most evidence, which is the squared cosine times the squared length of
the shorter vector, so a whole header counts more than one of its lines.

Before cosines are taken, parts that can't reach ``LEAST`` leave. By Cauchy and Schwarz a part needs a
share of ``LEAST ** 2`` of a template's squared weights among its terms. Each template has anchors, rare terms
that hold ``1 - LEAST ** 2 + SPARE`` of its squared weights or more, so a part must have anchors that hold ``SPARE``.
That is tested in the row, first for whole texts, then for their parts; what is left is tested with all of
its terms (``Reach.notices``). It loses nothing: whichever terms are anchors, the same parts reach ``LEAST``.
A part that has one term of a template only is not compared with it.

A directory's license is that of the licence files that lie in it. A file without a license of its own
inherits from the nearest directory above it that has one: the ancestors of each distinct directory, one
row each, are joined with the licensed directories by path, the deepest wins, and files are joined
with their directory. Licence files are aggregated to one row a directory before that join.

Cases: null and empty texts have no license of their own and inherit; a null path has no
ancestors; among equal cosines of a part the heavier template wins, then the one named first in code-point order;
among parts of equal evidence the license named first; among licence files of a directory the one with
the highest cosine, then the first path; repeated rows get equal rows; empty input gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.license_texts import TEMPLATES
from quire.llm.scratch import Scratch

LEAST, SPARE = 0.75, 0.1
#: Taken as anchors last and in this order, as most texts have them. Any order of terms finds the same notices.
COMMON = "version file work following code name names data public form list see terms material materials copy copies free provided other source used under use any all out one its into only no such shall may must will can above more even it either but on as from your was an not are you so if do or by at for that this with is in a to and of the".split()
TERM = r"[0-9\p{L}]+(?:\.[0-9]+)*"
#: Blank lines end a block, lines without a letter or digit a paragraph.
BLANK, BARE, STOP = r"\n(?:[^\S\n]*\n)+", r"\n(?:[^0-9\p{L}\n]*\n)+", r"(?<=[.!?])\s+"
PART = ("kind", "block", "paragraph", "item")
#: Sizes of templates, and of the templates a part is compared with: bits of one number.
SENTENCE, PASSAGE, WHOLE = 1, 2, 4


def terms(text: Column) -> Column:
    """Lower-case words and version numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def _vectors(notices) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """(term -> weight of each notice, term -> idf, idf of a term that no notice has)."""
    tf = [Counter(re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())) for _, text in notices]
    n, df = len(notices), Counter(t for c in tf for t in c)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    return [{t: (1 + math.log(k)) * idf[t] for t, k in c.items()} for c in tf], idf, math.log((n + 1) / 2) + 1


def size_of(notice: str) -> int:
    """SENTENCE, PASSAGE (several sentences) or WHOLE (several paragraphs)."""
    return WHOLE if len(re.split(BLANK, notice)) > 1 else PASSAGE if len(re.split(STOP, notice)) > 1 else SENTENCE


def templates(spark: SparkSession, notices=TEMPLATES) -> tuple[DataFrame, float]:
    """((license, notice, size, term, idf, w, weight) with w of unit length and weight the squared length, idf of a term that no template has)."""
    vectors, idf, rare = _vectors(notices)
    rows = []
    for i, ((name, text), v) in enumerate(zip(notices, vectors)):
        weight = sum(x * x for x in v.values())
        rows += [(name, i, size_of(text), t, idf[t], x / math.sqrt(weight), weight) for t, x in v.items()]
    values = ", ".join(f"('{name}', {i}, {size}, '{t}', {df!r}D, {w!r}D, {weight!r}D)" for name, i, size, t, df, w, weight in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(license, notice, size, term, idf, w, weight)"), rare


def anchors(least: float = LEAST, notices=TEMPLATES) -> tuple[dict[str, list[tuple[int, float]]], list[float]]:
    """(anchor -> (notice, share of its squared weights), the shares that a part must have of each notice's anchors)."""
    shares: dict[str, list[tuple[int, float]]] = {}
    bounds = []
    vectors, idf, _ = _vectors(notices)
    for i, v in enumerate(vectors):
        total, held = sum(x * x for x in v.values()), 0.0
        for t in sorted(v, key=lambda t: (COMMON.index(t) + 1 if t in COMMON else 0, -idf[t], t)):
            if held >= 1 - least**2 + SPARE:
                break
            shares.setdefault(t, []).append((i, v[t] ** 2 / total))
            held += v[t] ** 2 / total
        bounds.append(least**2 - (1 - held) - 1e-6)
    return shares, bounds


def _any_of(words) -> str:
    """A pattern for any of the words that looks at each letter once, longer words first."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(node[c]) for c in sorted(node) if c]
        inner = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return "" if not branches else f"(?:{inner})?" if "" in node else inner

    return r"(?<![0-9\p{L}])" + pattern(tree) + r"(?![0-9\p{L}])"


class Reach:
    """Whether a text can come to ``least`` with any notice of some sizes: by its anchors, and by all terms that it shares."""

    def __init__(self, least: float, notices):
        self.least = least
        self.shares, self.bounds = anchors(least, notices)
        self.sizes = [size_of(t) for _, t in notices]
        self.pattern = _any_of(self.shares)
        self.vectors, self.idf, self.rare = _vectors(notices)

    def _needs(self, sizes: int) -> Column:
        return F.expr("array(" + ", ".join(f"{b!r}D" if size & sizes else "2D" for b, size in zip(self.bounds, self.sizes)) + ")")

    def __call__(self, text: Column, sizes: int = SENTENCE | PASSAGE | WHOLE) -> Column:
        """Whether the anchors are enough."""
        if min(self.bounds) <= 0:  # nothing can be left out
            return F.lit(True)
        entry = lambda own: ", ".join(f"named_struct('i', {i}, 'w', {w!r}D)" for i, w in own)
        table = F.expr("map(" + ", ".join(f"'{t}', array({entry(own)})" for t, own in self.shares.items()) + ")")
        need = self._needs(sizes)
        hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(self.pattern), F.lit(0)))
        held = F.flatten(F.transform(hits, lambda t: F.element_at(table, t)))
        share = lambda h, i: F.aggregate(F.filter(h, lambda s: s["i"] == i), F.lit(0.0), lambda a, s: a + s["w"])
        # an array of one element binds what is found in the text, so that the text is searched once
        enough = F.exists(F.array(held), lambda h: F.exists(F.array_distinct(F.transform(h, lambda s: s["i"])), lambda i: share(h, i) >= F.element_at(need, i + 1)))
        return F.when(F.lower(text).rlike(self.pattern), enough).otherwise(F.lit(False))

    def notices(self, text: Column, sizes: Column) -> Column:
        """The numbers of the notices that the text's terms allow: it shares two of a notice's terms or more, these
        hold ``least ** 2`` of its squared weights, and the terms that no notice has don't outweigh them even if every repeated word is a shared one."""
        all_terms = terms(text)
        vocabulary = F.expr("array(" + ", ".join(f"'{t}'" for t in self.idf) + ")")
        table = []
        for i, (v, size) in enumerate(zip(self.vectors, self.sizes)):
            total = sum(x * x for x in v.values())
            own = ", ".join(f"named_struct('t', '{t}', 'w', {x * x / total!r}D, 'q', {self.idf[t] ** 2!r}D)" for t, x in v.items())
            table.append(f"named_struct('i', {i}, 'size', {size}, 'terms', array({own}))")
        notices = F.expr("array(" + ", ".join(table) + ")")
        least, spare = F.lit(self.least**2 - 1e-6), 1e-6 + 1 - self.least**2
        plus = lambda xs, name: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x[name])

        def fits(found, shared):
            often = F.log(found["n"] - found["distinct"] + 1) + 1
            other = (found["distinct"] - F.size(found["known"])) * self.rare**2
            return (F.size(shared) >= 2) & (plus(shared, "w") >= least) & (other * least <= spare * often * often * plus(shared, "q"))

        def allowed(found):
            shared = lambda n: F.filter(n["terms"], lambda x: F.array_contains(found["known"], x["t"]))
            mine = F.filter(notices, lambda n: n["size"].bitwiseAND(sizes) != 0)
            return F.transform(F.filter(mine, lambda n: F.exists(F.array(shared(n)), lambda s: fits(found, s))), lambda n: n["i"])

        counted = lambda xs: F.struct(F.size(xs).alias("n"), F.size(F.array_distinct(xs)).alias("distinct"), F.array_intersect(xs, vocabulary).alias("known"))
        return F.flatten(F.transform(F.transform(F.array(all_terms), counted), allowed))


def parts(files: DataFrame, text: str, key: str, reach: Reach) -> DataFrame:
    """(key, kind, block, paragraph, item, text, notice) of the parts that reach far enough, and what they may be; numbers count from 0. A part that is its whole larger part isn't given twice."""
    whole = F.btrim(F.col(text), F.lit(" \t\r\n\v\f"))
    zero = [F.lit(0).alias(n) for n in PART[1:]]
    large = lambda kind: (F.lit(kind).alias("kind"), F.lit(WHOLE).alias("sizes"), F.col("__t").alias("text"))
    f = files.select(F.col(key), whole.alias("__t"), F.split(whole, BLANK, -1).alias("__blocks"))
    file = f.where((F.size("__blocks") > 1) & reach(F.col("__t"), WHOLE)).select(key, *zero, *large("file"))
    b = f.select(key, F.posexplode("__blocks").alias("block", "__t")).where(reach(F.col("__t")))
    b = b.withColumn("__paras", F.split("__t", BARE, -1))
    block = b.where((F.size("__paras") > 1) & reach(F.col("__t"), WHOLE)).select(key, "block", *zero[1:], *large("block"))
    p = b.select(key, "block", F.posexplode("__paras").alias("paragraph", "__t")).where(reach(F.col("__t")))
    one = lambda kind, i, sizes, t: F.struct(F.lit(kind).alias("kind"), i.alias("item"), sizes.alias("sizes"), t.alias("text"))
    none = F.array().cast("array<struct<kind:string,item:int,sizes:int,text:string>>")
    several = lambda kind, xs: F.when(F.size(xs) > 1, F.transform(xs, lambda t, i: one(kind, i, F.lit(SENTENCE), t))).otherwise(none)
    lines, sentences = F.split("__t", "\n", -1), F.split("__t", STOP, -1)
    own = F.array(one("paragraph", F.lit(0), F.when(F.size(sentences) > 1, PASSAGE | WHOLE).otherwise(SENTENCE | PASSAGE | WHOLE), F.col("__t")))
    small = p.select(key, "block", "paragraph", F.inline(F.concat(own, several("line", lines), several("sentence", sentences))))
    able = F.when(F.col("sizes") == SENTENCE, reach(F.col("text"), SENTENCE)).when(F.col("sizes") == PASSAGE | WHOLE, reach(F.col("text"), PASSAGE | WHOLE)).otherwise(True)
    names = [key, *PART, "sizes", "text"]
    every = file.select(names).unionByName(block.select(names)).unionByName(small.where(able).select(names))
    # exploding drops the parts without any, and keeps the test out of a filter that would repeat it
    return every.select(key, *PART, "text", F.explode(reach.notices(F.col("text"), F.col("sizes"))).alias("notice"))


def notices(files: DataFrame, scratch: Scratch, text: str = "text", key: str = "__rid", least: float = LEAST, templates_=TEMPLATES, reach: Reach | None = None) -> DataFrame:
    """(key, kind, block, paragraph, item, license, cosine, evidence): each part's best template, if at ``least`` or more."""
    vocabulary, rare = templates(files.sparkSession, templates_)
    vocabulary = scratch.table(vocabulary, "templates")  # as many rows as the templates have terms
    found = parts(files, text, key, reach or Reach(least, templates_))
    at = [key, *PART, "notice"]
    tf = found.select(*at, F.explode(terms(F.col("text"))).alias("term")).groupBy(*at, "term").agg(F.count("*").alias("tf"))
    tf = scratch.table(tf, "terms")
    idf = F.broadcast(vocabulary.select(F.col("term").alias("__t"), "idf").distinct())
    x = tf.join(idf, F.col("term") == F.col("__t"), "left").withColumn("x", (F.log("tf") + 1) * F.coalesce("idf", F.lit(rare)))
    norm = x.groupBy(*(F.col(c).alias(f"__{c}") for c in at)).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    v = F.broadcast(vocabulary.select("license", F.col("notice").alias("__n"), "weight", F.col("term").alias("__v"), "w"))
    dot = x.join(v, (F.col("term") == F.col("__v")) & (F.col("notice") == F.col("__n"))).groupBy(*at, "license", "weight").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    same = [F.col(c) == F.col(f"__{c}") for c in at]
    dot = dot.join(norm, same).withColumn("cosine", F.round(F.least(F.col("dot") / F.col("norm"), F.lit(1.0)), 9)).where(F.col("cosine") >= least)
    top = F.min(F.struct((-F.col("cosine")).alias("c"), (-F.round("weight", 6)).alias("w"), "license")).alias("top")
    best = dot.groupBy(key, *PART).agg(top, F.max("norm").alias("norm"))
    cosine, matched = -F.col("top.c"), F.least(-F.col("top.w"), F.col("norm") * F.col("norm"))
    return best.select(key, *PART, "top.license", cosine.alias("cosine"), F.round(cosine * cosine * matched, 6).alias("evidence"))


def parents(path: Column) -> Column:
    """(dir, depth) of a directory and every one above it, the root "" at depth 0 included."""
    names = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/", -1))
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.struct(F.array_join(F.slice(names, 1, n), "/").alias("dir"), n.alias("depth")))


def scan(files: DataFrame, is_file: Column, text: str = "text", path: str = "path", key: str = "doc_id", least: float = LEAST, templates_=TEMPLATES) -> DataFrame:
    """One row per file: key, path, own_license, cosine, kind, license, origin ("own", "inherited" or null), from_dir.

    is_file: whether a file is a licence file of its directory, from the columns path, kind, block, paragraph, item
    and cosine of the file's strongest part.
    """
    scratch, reach = Scratch(files.sparkSession, "licenses"), Reach(least, templates_)
    whole = files.select(F.monotonically_increasing_id().alias("__rid"), F.col(key).alias("__key"), F.col(path).alias("path"), F.col(text).alias("__text"))
    # the texts are read once: later steps need those only that may have a notice
    lines = scratch.table(whole.withColumn("__text", F.when(reach(F.col("__text")), F.col("__text"))), "files")
    found = notices(lines.where("__text is not null"), scratch, "__text", "__rid", least, templates_, reach)
    best = found.groupBy("__rid").agg(F.min(F.struct((-F.col("evidence")).alias("e"), "license", "block", "paragraph", "item", "kind", "cosine")).alias("b"))
    best = scratch.table(best.select(F.col("__rid").alias("__b"), "b.license", "b.cosine", *(f"b.{c}" for c in PART)), "best")
    own = lines.drop("__text").join(best, F.col("__rid") == F.col("__b"), "left").drop("__b")
    own = scratch.table(own.withColumn("__in", F.regexp_replace("path", r"/?[^/]*$", "")), "own")
    scratch.drop(lines, best)
    dirs = own.where(F.col("license").isNotNull() & F.col("path").isNotNull() & is_file)
    dirs = dirs.groupBy(F.col("__in").alias("__dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", F.col("license"))).alias("d")).select("__dir", F.col("d.license").alias("__lic"))
    dirs = scratch.table(dirs, "dirs")
    bare = own.where("license is null and path is not null").select(F.col("__in").alias("__of")).distinct().withColumn("up", F.explode(parents(F.col("__of"))))
    above = bare.join(dirs, F.col("up.dir") == F.col("__dir")).groupBy("__of").agg(F.max(F.struct("up.depth", "up.dir", F.col("__lic").alias("lic"))).alias("n"))
    above = scratch.table(above, "above")
    out = own.join(above, (F.col("__in") == F.col("__of")) & F.col("license").isNull(), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited")
    return out.select(F.col("__key").alias(key), "path", F.col("license").alias("own_license"), "cosine", "kind", F.coalesce("license", "n.lic").alias("license"), origin.alias("origin"), F.col("n.dir").alias("from_dir"))
