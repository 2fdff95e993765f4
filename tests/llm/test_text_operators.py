"""Line dedup and unit hashing against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import lines, units

SCHEMA = "doc_id long, text string, lang string, rid string, line string, start string"


def corpus(seed=4):
    rng = random.Random(seed)
    long = ["word " * 30 + str(i) + "." for i in range(6)]
    pool = [f"line {i}" for i in range(40)] + long + ["", "  ", "\t", "One two three four five six seven eight nine. Ten.", "a. b. c."]
    rows = [None, "", "\n\n", "x", "x\ny", "x\ny"]
    for _ in range(60):
        n = rng.randint(1, 25)
        rows.append("\n".join(rng.choice(pool + [f"unique {rng.random()}"] * 30) for _ in range(n)))
        if rng.random() < 0.4:
            rows.append(rows[-1])
        if rng.random() < 0.4:
            rows.append("head\n" + rows[-1] + "\r\n" + f"tail {rng.random()}")
    rows.append("x\ny\n" * 2000)
    out = [(i, t, "en", "r", "l", "s") for i, t in enumerate(rows)]
    rng.shuffle(out)
    return out + [(None, "x\ny", "en", "r", "l", "s"), (None, None, None, None, None, None)]


def brute_lines(rows, least, long_line=100):
    """{row index: (non-blank lines, deleted line numbers)} with the copies of windows of ``least`` lines."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))  # equal ids here have equal texts
    seqs = {i: [(n, s) for n, x in enumerate((rows[i][1] or "").split("\n")) if (s := x.strip(" \t\r\v\f"))] for i in order}
    seen, gone = set(), defaultdict(set)
    for i in order:
        s = [x for _, x in seqs[i]]
        for p in range(len(s)):
            sizes = {1} if len(s[p]) >= long_line else set()
            for size in sizes | ({least} if p + least <= len(s) else set()):
                run = tuple(s[p : p + size])
                if run in seen:
                    gone[i] |= {seqs[i][q][0] for q in range(p, p + size)}
                seen.add(run)
    return {i: (len(seqs[i]), sorted(gone[i])) for i in order}, seqs


def brute_depth(seqs):
    out = dict.fromkeys(seqs, 0)
    depth = 1
    while True:
        runs = defaultdict(list)
        for i, s in seqs.items():
            for p in range(len(s) - depth + 1):
                runs[tuple(x for _, x in s[p : p + depth])].append(i)
        if not any(len(v) > 1 for v in runs.values()):
            return out
        for v in runs.values():
            if len(v) > 1:
                out.update(dict.fromkeys(v, depth))
        depth *= 2


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines_against_brute_force(spark, least):
    rows = corpus(least)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = lines.report(df, min_lines=least).collect()
    want, seqs = brute_lines(rows, least)
    depth = brute_depth(seqs)
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=rows[i][0], n_lines=n, n_removed=len(g), removed=",".join(map(str, g)), deepest=depth[i])) for i, (n, g) in want.items())


def brute_runs(rows, least, long_line=100):
    """(id, line, n_lines, first id, first line) of the copied runs, by the longest common prefix of every position with earlier ones."""
    _, seqs = brute_lines(rows, least)
    at, out = [(i, p) for i, s in seqs.items() for p in range(len(s))], []
    text = lambda i, p: seqs[i][p][1] if p < len(seqs[i]) else None

    def prefix(a, b):
        n = 0
        while text(a[0], a[1] + n) is not None and text(a[0], a[1] + n) == text(b[0], b[1] + n):
            n += 1
        return n

    deep = {}
    for k, a in enumerate(at):
        common = [(prefix(a, b), b) for b in at[:k]]
        best = max((n for n, _ in common), default=0)
        if best:
            depth = max(d for d in [2**j for j in range(20)] + [least] if d <= best)
            deep[a] = next((n, b) for n, b in common if n >= depth)
    for (i, p), (n, (j, q)) in deep.items():
        inner = deep.get((i, p - 1), (0, None))
        if n >= least and not (inner[0] >= least and inner[1] == (j, q - 1)):
            out.append((rows[i][0], seqs[i][p][0], n, rows[j][0], seqs[j][q][0]))
        elif n < least and len(text(i, p)) >= long_line:
            out.append((rows[i][0], seqs[i][p][0], 1, rows[j][0], seqs[j][q][0]))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_maximal_runs_against_brute_force(spark, least):
    rows = [r for r in corpus(least + 10) if r[0] is not None and (r[1] or "").count("\n") < 100][:60]
    rows.append((900, "\n".join(["again"] * 23), "en", "r", "l", "s"))
    got = lines.runs(spark.createDataFrame(rows, SCHEMA).coalesce(1), min_lines=least).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_runs(rows, least))) and len(got) > 20


def test_lines_do_not_depend_on_order(spark):
    """Texts of one id: the hash of the text decides, not the order of rows."""
    rows = [(1, "p\nq\nx"), (1, "p\nq\ny"), (1, "q\nx\np\nq"), (None, "p\nq")]
    kept = [sorted((str(r[0]), r[1]) for r in lines.dedup(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)).collect()) for x in (rows, rows[::-1])]
    assert kept[0] == kept[1]


def test_lines_dedup(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("__rid", F.lit(77))
    got = lines.dedup(df)
    assert got.columns == df.columns and {r["__rid"] for r in got.collect()} == {77}
    want = []
    for i, (n, gone) in brute_lines(rows, 2)[0].items():
        if not n or len(gone) < n:
            t = rows[i][1]
            want.append((rows[i][0], t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_unit_offsets_and_first_occurrence(spark):
    rows = corpus()
    got = units.report(spark.createDataFrame(rows, SCHEMA).coalesce(1), min_words=3).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, want = {}, []
    for i in order:
        at, found = 0, []
        gone = set()  # lines that are removed whole
        for n, line in enumerate((rows[i][1] or "").split("\n")):
            found.append(("line", at, line, n))
            parts = re.findall(r"[^.!?]*[.!?]+|[^.!?]+", line)
            here = at
            for p in parts if sum(bool(x.strip()) for x in parts) > 1 else []:
                found.append(("sentence", here, p, n))
                here += len(p)
            at += len(line) + 1
        for kind, start, part, n in sorted(found, key=lambda x: x[1]):
            words = re.findall(r"[^ \t\r\v\f]+", part.lower())
            if len(words) >= 3:
                core = part.strip(" \t\r\v\f")
                s = start + part.index(core)
                assert rows[i][1][s : s + len(core)] == core
                key = tuple(words)
                if key in first and kind == "line":
                    gone.add(n)
                if key in first and not (kind == "sentence" and n in gone):
                    want.append((rows[i][0], kind, s, s + len(core), len(words), *first[key]))
                first.setdefault(key, (rows[i][0], s))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_unit_cases(spark):
    """Null and empty texts, repeated rows, texts of one id in either order, and columns of the module's own names."""
    u = " ".join(f"u{i}" for i in range(9)) + "."
    rows = [(None, u), (1, None), (1, ""), (2, u + " x"), (2, u + " y"), (3, "a\n" + u), (3, "a\n" + u), (4, (u + " ") * 30_000)]
    kept = []
    for x in (rows, rows[::-1]):
        df = spark.createDataFrame(x, "doc_id long, text string").coalesce(1).withColumns({"__rid": F.lit(7), "__spans": F.lit("s"), "__new": F.lit(1)})
        got = units.dedup(df)
        assert got.columns == df.columns and {r["__rid"] for r in got.collect()} <= {7}
        kept.append(sorted(str((r.doc_id, r.text)) for r in got.collect()))
    assert kept[0] == kept[1] and sum(u in x for x in kept[0]) == 1 and sum("None" in x for x in kept[0]) == 1


def test_unit_dedup_leaves_one_copy(spark):
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows = [(1, f"Intro one. {passage} More here", "a"), (2, f"{passage}", "b"), (3, "clean text of its own that nobody else has at all", "c"), (4, f"Well.{passage}", "d")]
    got = {r.doc_id: r.text for r in units.dedup(spark.createDataFrame(rows, "doc_id long, text string, spans string").coalesce(1)).collect()}
    assert set(got) == {1, 3, 4} and got[3] == rows[2][1]
    assert sum(passage in t for t in got.values()) == 1 and got[4] == "Well."


@pytest.mark.parametrize("f", [lines.report, lines.dedup, units.report, units.dedup])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []
