"""License scans: real headers and files, every candidate and the inheritance against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import license_texts as L
from quire.llm import licenses
from quire.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, path string"
GPL3 = next(t for n, t in L.TEMPLATES if n == "GPL-3.0-or-later")


def scan(spark, rows, is_file=None):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cosine", F.lit("x")).withColumn("kind", F.lit("x")).withColumn("__rid", F.lit(7))
    return licenses.scan(df, F.lit(False) if is_file is None else is_file).collect()


def test_real_texts(spark):
    """Whole files, headers in comments, wrapped or not, single lines, identifiers, and a sentence behind another."""
    comment = lambda t, mark: "\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    holder = "Copyright (c) 2020, Some Body and others\n\n"
    want = [
        ("MIT License\n\n" + holder + "\n\n".join((L._MIT, L._MIT_KEEP, L._MIT_AS_IS)), "MIT"),
        (L._MIT.replace("\n", " "), "MIT"),
        ("BSD 2-Clause License\n\n" + holder + "\n\n".join((L._BSD, L._BSD_1_2, L._BSD_AS_IS)), "BSD-2-Clause"),
        (holder + "\n\n".join((L._BSD, L._BSD_1_2, L._BSD_3, L._BSD_AS_IS)), "BSD-3-Clause"),
        (L._BSD, "BSD-3-Clause"),
        ("/*\n" + comment(GPL3, " *") + "\n */\nint main(void) { return 0; }", "GPL-3.0-or-later"),
        (GPL3.replace("\n", " "), "GPL-3.0-or-later"),
        ("#!/bin/sh\n" + comment(L._APACHE + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + L._APACHE_AS_IS, "#") + "\n\necho 1", "Apache-2.0"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        (L._ISC, "ISC"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"),
        (" * This Source Code Form is subject to the terms of the Mozilla Public", "MPL-2.0"),
        ("(c) 2020 X. All rights reserved.", "proprietary"),
        ("Released under the MIT License. It was written in a hurry.", "MIT"),
        ("Apache License", "Apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Preamble\n\n" + "The free software of the users. " * 50, "GPL-3.0"),
        ("the terms of use of this form are in the source", None),
        ("a driver needs a license, and all his rights are in the software", None),
        ("# SPDX-License-Identifier: EUPL-1.2", None),
        ("Er kommt\nmit\nihr", None),
    ]
    got = {r.doc_id: r.own_license for r in scan(spark, [(i, t, f"d{i}/x") for i, (t, _) in enumerate(want)])}
    assert [got[i] for i in range(len(want))] == [w for _, w in want]


def parts(text):
    """(kind, block, paragraph, item, sizes of templates, text), as the module's docstring says."""
    text = text.strip(" \t\r\n\v\f")
    blocks, out = re.split(r"\n(?:[^\S\n]*\n)+", text), []
    if len(blocks) > 1:
        out.append(("file", 0, 0, 0, "w", text))
    for i, b in enumerate(blocks):
        paras = re.split(r"\n(?:[^0-9a-zA-Z\n]*\n)+", b)
        if len(paras) > 1:
            out.append(("block", i, 0, 0, "w", b))
        for j, p in enumerate(paras):
            lines, sentences = p.split("\n"), re.split(r"(?<=[.!?])\s+", p)
            out.append(("paragraph", i, j, 0, "pw" if len(sentences) > 1 else "spw", p))
            for kind, xs in (("line", lines), ("sentence", sentences)):
                out += [(kind, i, j, k, "s", x) for k, x in enumerate(xs) if len(xs) > 1]
    return out


def size_of(template):
    return "w" if "\n\n" in template else "p" if re.search(r"[.!?]\s", template) else "s"


def brute(templates):
    """text -> [(kind, block, paragraph, item, license, cosine, evidence)] of every part at LEAST or more."""
    tok = lambda t: Counter(re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower()))
    n, df = len(templates), Counter(w for _, t in templates for w in tok(t))
    idf = lambda w: math.log((n + 1) / (df.get(w, 1) + 1)) + 1
    vec = lambda t: {w: (1 + math.log(k)) * idf(w) for w, k in tok(t).items()}
    square = lambda v: sum(x * x for x in v.values())
    known = [(name, v, square(v), size_of(t)) for name, t in templates for v in [vec(t)]]

    def of(text):
        out = []
        for *at, sizes, t in parts(text):
            v = vec(t)
            if not v:
                continue
            own = square(v)
            c = [(round(min(1.0, sum(v.get(w, 0) * x for w, x in u.items()) / math.sqrt(own * s)), 9), s, name) for name, u, s, size in known if size in sizes and len(v.keys() & u) > 1]
            cosine, s, name = min(c, key=lambda x: (-x[0], -round(x[1], 6), x[2]), default=(0, 0, ""))
            if cosine >= licenses.LEAST:
                out.append((*at, name, cosine, round(cosine**2 * min(s, own), 6)))
        return out

    return of


def mixed_texts(seed, n):
    """Parts of templates with words taken out, put in and shuffled, beside plain text."""
    rng = random.Random(seed)
    plain = "the work of all users under any name is free to use software code with rights and a license in it".split()
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, 3)):
            w = re.split(r"(?<=\s)", rng.choice(L.TEMPLATES)[1])
            if rng.random() < 0.6:
                w = [x for x in w if rng.random() < rng.choice([0.5, 0.8, 0.95])]
            for _ in range(rng.choice([0, 0, 1, 5])):
                w.insert(rng.randrange(len(w) + 1), rng.choice(plain) + " ")
            text.append("".join(w))
            if rng.random() < 0.4:
                text.append(" ".join(rng.choice(plain) for _ in range(rng.randint(1, 60))) + ".")
        mark = rng.choice(["", "", "# ", " * "])
        out.append("\n".join((mark + x).rstrip() for x in rng.choice(["\n", "\n\n", " "]).join(text).split("\n")))
    return out


def test_every_part_against_brute_force(spark):
    texts = mixed_texts(3, 120)
    of = brute(L.TEMPLATES)
    want = {(i, *r[:5]): r[5:] for i, t in enumerate(texts) for r in of(t)}
    rows = licenses.notices(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), Scratch(spark, "t"), "t", "k").collect()
    got = {(r.k, r.kind, r.block, r.paragraph, r.item, r.license): (r.cosine, r.evidence) for r in rows}
    assert len(got) > 100
    # a part whose best two templates or whose cosine and LEAST are equal but for rounding may differ
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=3e-6)


def test_scan_against_brute_force(spark):
    """Own licenses and the nearest licensed directory above, over random trees."""
    rng, of = random.Random(8), brute(L.TEMPLATES)
    texts = [t for t in mixed_texts(5, 60)] + ["plain text"] * 60 + [None, ""]
    dirs = ["", "a", "a/b", "a/b/c", "a/b/c/d", "q", "q/r", "z/y/x"]
    rows = []
    for i, t in enumerate(texts):
        d = rng.choice(dirs)
        rows.append((i, t, f"{d}/{rng.choice(['LICENSE', 'f' + str(i)])}".lstrip("/")))
    rows += [(500, "plain", None), (501, L._MIT, None), rows[3], rows[3]]
    own = {}
    for i, t, _ in rows:
        found = of(t) if t else []
        own[i] = min(found, key=lambda r: (-r[6], r[4], r[1], r[2], r[3], r[0])) if found else None
    licensed = {}
    for i, _, path in rows:
        if path and own[i] and path.rpartition("/")[2] == "LICENSE":
            d = path.rpartition("/")[0]
            licensed[d] = min(licensed.get(d, (0, "", "")), (-own[i][5], path, own[i][4]))
    want = []
    for i, _, path in rows:
        if own[i]:
            want.append((i, own[i][4], own[i][4], "own", None))
            continue
        up = path.rpartition("/")[0] if path else None
        while up is not None and up not in licensed:
            up = up.rpartition("/")[0] if up else None
        want.append((i, None, licensed[up][2] if up is not None else None, None if up is None else "inherited", up))
    got = scan(spark, rows, F.regexp_extract("path", "[^/]*$", 0) == "LICENSE")
    assert sorted(map(str, ((r.doc_id, r.own_license, r.license, r.origin, r.from_dir) for r in got))) == sorted(map(str, want))


def test_cases(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        (1, apache + "\nbody", "a/LICENSE"), (2, "code " * 5000, "a/b/c.py"), (3, "text\n" + mit, "a/b/d.py"), (4, mit, "a/x/LICENSE"), (5, "code", "a/x/y/z/e.py"), (7, None, "a/x/g.py"),
        (8, None, None), (9, "", "h.py"), (10, "l\n" * 3000 + mit, "q/g.py"), (10, "l\n" * 3000 + mit, "q/g.py"), (11, "word " * 200_000 + "\n\nAll rights reserved.", "q/r"),
        # equal cosines: the path that comes first gives the directory's license
        (12, "Licensed under CC BY-NC 4.0.", "t/LICENSE"), (13, mit, "t/LICENSE.a"), (14, "x", "t/y"),
    ]
    got = scan(spark, rows, F.contains("path", F.lit("LICENSE")))
    by = {r.doc_id: (r.own_license, r.license, r.origin, r.from_dir) for r in got}
    assert len(got) == len(rows)
    assert by == {
        1: ("Apache-2.0", "Apache-2.0", "own", None), 2: (None, "Apache-2.0", "inherited", "a"), 3: ("MIT", "MIT", "own", None), 4: ("MIT", "MIT", "own", None),
        5: (None, "MIT", "inherited", "a/x"), 7: (None, "MIT", "inherited", "a/x"), 8: (None,) * 4, 9: (None,) * 4, 10: ("MIT", "MIT", "own", None), 11: ("proprietary", "proprietary", "own", None),
        12: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own", None), 13: ("MIT", "MIT", "own", None), 14: (None, "CC-BY-NC-4.0", "inherited", "t"),
    }
    assert scan(spark, [], F.lit(True)) == []
