"""Toxicity by a linear-chain conditional random field over tokens.

Every token has features: its word, its beginnings and endings, its shape, and the words beside it. Two
states, clean and toxic, with start and move potentials make a chain. Labels are given for documents, so
the tokens of the training documents are labelled first: a token of a toxic document is toxic if its word or one of
its beginnings is met in so many more toxic than clean documents that less than one such feature is
expected by chance, with as many different neighbours. All other tokens, and every token of a clean document, are
negatives. The chain is fitted to these labels by maximum conditional likelihood, labels the toxic
documents' tokens again by its own marginals, and is fitted once more.

Scoring runs forward-backward over every token of the whole text. The marginals of all tokens enter the
noisy-or, weighted by themselves, that gives the document's score by a logistic curve; tokens of half or more make the offending
offsets. A batch of documents is one long chain that begins anew at every document; it is cut into
blocks whose 2 x 2 matrix products are taken side by side, which is exact.

The chain is fitted on a bounded sample of the labelled rows: ``TOXIC_ROWS`` and ``CLEAN_ROWS`` of
the training rows in order of a hash, of each ``ROW_WINDOWS`` windows of ``WINDOW`` tokens spread evenly over its whole text
(all of them, if it has no more), and of these windows ``FIT_WINDOWS`` with toxic tokens and twice as many without.
The curve is fitted to the scores of the same rows' whole texts. Everything
else covers all rows. Inputs of a score are the text's characters alone.

Cases: null and empty texts have no tokens and get the lowest score; a labelled id that occurs
twice counts once, as toxic if any of its labels is, and with the text of the smallest hash; null labels and ids teach nothing;
without any toxic training row every score is 0; a text of any length is scored whole, as ``CHUNK`` tokens or one
document at once; empty input gives no rows; other columns are not read by ``scores`` and are carried by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch
from quire.llm.text import parts

TOXIC_ROWS, CLEAN_ROWS, ROW_WINDOWS, WINDOW, FIT_WINDOWS = 800, 1600, 40, 48, 1500
#: Toxic documents that a marking feature needs, clean documents it may have for each of them, and the features expected to mark by chance.
MIN_SUPPORT, MOST_CLEAN, BY_CHANCE, FOLDS = 5, 0.02, 0.5, 5
#: Letters of a beginning that may mark tokens, of beginnings and endings as features, and rows a feature must be met in.
MARKING, BEGINNINGS, ENDINGS, MET = (4, 5, 6, 7), (3, 4, 5, 6, 7), (2, 3), 3
ROUNDS, RIDGE = 100, 1e-5
#: Words whose weights a worker keeps before it begins anew, tokens scored at once, and tokens of a block.
KNOWN_WORDS, CHUNK, BLOCK = 100_000, 50_000, 64
#: Added to the exponent, so that all texts without a suspicious token score alike.
FLOOR = 0.01
#: Bytes of text that are Python objects at once.
BATCH_BYTES = 4 << 20
TOKEN = re.compile(r"\w+")


def shape(token: str) -> str:
    """Runs of capitals, small letters, digits and others as X, x, 9 and _."""
    kind = lambda c: "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else "_"
    runs = [kind(c) for c in token]
    return "#" + "".join(a for a, b in zip(runs, ["", *runs]) if a != b)


def features(token: str) -> list[str]:
    """A token's own features; those of its neighbours are "<" and ">" with their words."""
    w = token.lower()
    return ["=" + w, *("^" + w[:n] for n in BEGINNINGS if len(w) >= n), *("$" + w[-n:] for n in ENDINGS if len(w) > n), shape(token)]


@dataclass
class Chain:
    """State 1 is toxic. start and move are log potentials; a token's state 1 has bias plus its features' weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: tuple[float, float] = (0.0, 0.0)
    move: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple[float, float] | None = None


def forward_backward(potential: np.ndarray, begins: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token of chains that follow each other; begins marks their first tokens."""
    n = len(potential)
    blocks = max(1, -(-n // BLOCK))
    f, new = np.ones(blocks * BLOCK), np.ones(blocks * BLOCK, bool)
    f[:n], new[:n] = potential, begins
    f, new = f.reshape(blocks, BLOCK).T, new.reshape(blocks, BLOCK).T
    # step t of every block: row vector times a[t]; after a boundary both rows are the start
    a = np.empty((BLOCK, 2, 2, blocks))
    for i in (0, 1):
        a[:, i, 0] = np.where(new, start[0], move[i, 0])
        a[:, i, 1] = np.where(new, start[1], move[i, 1]) * f
    whole = a[0].copy()
    for t in range(1, BLOCK):
        whole = np.stack([np.stack([whole[i, 0] * a[t, 0, j] + whole[i, 1] * a[t, 1, j] for j in (0, 1)]) for i in (0, 1)])
        whole /= whole.max(axis=(0, 1))
    into, out = np.empty((2, blocks)), np.empty((2, blocks))
    v, w = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    for b in range(blocks):
        into[:, b] = v
        v = v @ whole[:, :, b]
        v = v / v.sum()
    for b in range(blocks - 1, -1, -1):
        out[:, b] = w
        w = whole[:, :, b] @ w
        w = w / w.sum()
    fore, p = np.empty((BLOCK, 2, blocks)), np.empty((BLOCK, blocks))
    v0, v1 = into
    for t in range(BLOCK):
        v0, v1 = v0 * a[t, 0, 0] + v1 * a[t, 1, 0], v0 * a[t, 0, 1] + v1 * a[t, 1, 1]
        total = v0 + v1
        v0, v1 = v0 / total, v1 / total
        fore[t, 0], fore[t, 1] = v0, v1
    w0, w1 = out
    for t in range(BLOCK - 1, -1, -1):
        x0, x1 = fore[t, 0] * w0, fore[t, 1] * w1
        p[t] = x1 / (x0 + x1)
        w0, w1 = a[t, 0, 0] * w0 + a[t, 0, 1] * w1, a[t, 1, 0] * w0 + a[t, 1, 1] * w1
        total = w0 + w1
        w0, w1 = w0 / total, w1 / total
    return p.T.reshape(-1)[:n]


class Scorer(dict):
    """raw token -> its row in the tables of own weights, and weights as the token before and behind."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain
        self.start, self.move = np.exp(np.array(chain.start)), np.exp(np.array(chain.move))
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.table = np.zeros((1 << 12, 3))

    def __missing__(self, token: str) -> int:
        get, w = self.chain.weights.get, token.lower()
        self[token] = at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = sum(get(f, 0.0) for f in features(token)), get("<" + w, 0.0), get(">" + w, 0.0)
        return at

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each token of the documents, one after another; where each document begins)."""
        size = np.array([len(d) for d in docs])
        first = np.r_[0, np.cumsum(size)[:-1]]
        ids = np.fromiter((self[t] for d in docs for t in d), np.int64, int(size.sum()))
        begins = np.zeros(len(ids), bool)
        begins[first[size > 0]] = True
        u = self.chain.bias + self.table[ids, 0]
        if len(ids):
            inner = ~begins[1:]
            u[1:] += self.table[ids[:-1], 1] * inner
            u[:-1] += self.table[ids[1:], 2] * inner
        p = forward_backward(np.exp(np.clip(u, -30, 30)), begins, self.start, self.move) if len(ids) else np.zeros(0)
        if len(self) > KNOWN_WORDS:
            self._empty()
        return p, first

    def evidence(self, texts: list[str]) -> Iterator[tuple[float, np.ndarray]]:
        """Per text the log of its noisy-or's exponent, each token weighted by its marginal, and the tokens' marginals.

        The exponent is -log of the probability that no token is toxic. Without the weights, very many plain tokens would add up.
        """
        held, n = [], 0
        for i, t in enumerate(texts):
            held.append(TOKEN.findall(t))
            n += len(held[-1])
            if n >= CHUNK or i == len(texts) - 1:
                p, first = self.marginals(held)
                for a, b in zip(first, np.r_[first[1:], len(p)]):
                    own = np.clip(p[a:b], 0, 1 - 1e-12)
                    yield float(np.log(FLOOR - (own * np.log1p(-own)).sum())), p[a:b]
                held, n = [], 0

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """Probability that each document is toxic, and the offsets of its toxic spans."""
        if self.chain.curve is None:
            yield from ((0.0, []) for _ in texts)
            return
        a, b = self.chain.curve
        for t, (x, p) in zip(texts, self.evidence(texts)):
            yield float(1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))), _spans(t, p >= 0.5)


def _spans(text: str, bad: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    if bad.any():
        last = False
        for m, now in zip(TOKEN.finditer(text), bad):
            if now and last:
                spans[-1] = (spans[-1][0], m.end())
            elif now:
                spans.append(m.span())
            last = now
    return spans


def windows(text: str) -> list[list[str]]:
    """Windows of WINDOW tokens, at most ROW_WINDOWS of them, spread evenly over the whole text."""
    w = TOKEN.findall(text)
    n = -(-len(w) // WINDOW)
    at = range(n) if n <= ROW_WINDOWS else (i * n // ROW_WINDOWS for i in range(ROW_WINDOWS))
    return [w[i * WINDOW : (i + 1) * WINDOW] for i in at]


def marking(docs: list[tuple[list[list[str]], int]]) -> set[str]:
    """The features that mark toxic tokens: "=word" and "^beginning"."""
    own = lambda t: [f for f in features(t) if f[0] == "=" or (f[0] == "^" and len(f) - 1 in MARKING)]
    met: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for ws, y in docs:
        met[y].update({f for t in {t for w in ws for t in w} for f in own(t)})
    n_toxic = sum(y for _, y in docs)
    if not n_toxic:
        return set()
    base, least = min(n_toxic / len(docs), 1 - 1e-9), np.log(max(1, sum(n + met[0][f] >= MIN_SUPPORT for f, n in met[1].items())) / BY_CHANCE)

    def surprise(n: int, clean: int) -> float:
        """-log of the chance (Chernoff's bound) that of n + clean rows n or more are toxic."""
        share = n / (n + clean)
        return (n + clean) * (share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if clean else 0.0))

    marks = {f for f, n in met[1].items() if n >= MIN_SUPPORT and met[0][f] <= MOST_CLEAN * n and surprise(n, met[0][f]) >= least}
    beside: dict[str, set] = defaultdict(set)
    for ws, y in docs:
        for w in ws if y else ():
            for i, t in enumerate(w):
                for f in own(t):
                    if f in marks:
                        beside[f].add((w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""))
    return {f for f in marks if len(beside[f]) >= MIN_SUPPORT}


def train(docs: list[tuple[list[list[str]], int]]) -> Chain:
    """A chain without a curve from (windows, label) of the sampled rows."""
    marks = marking(docs)
    if not marks:
        return Chain()
    mark = lambda t: not marks.isdisjoint(features(t))
    marked = {t: mark(t) for ws, y in docs if y for w in ws for t in w}
    labels = [[np.array([marked[t] for t in w], int) for w in ws] if y else None for ws, y in docs]
    met = Counter()
    for ws, _ in docs:
        words = {t for w in ws for t in w}
        low = {t.lower() for t in words}
        met.update({f for t in words for f in features(t)} | {"<" + t for t in low} | {">" + t for t in low})
    known = {f: i + 1 for i, f in enumerate(sorted(f for f, n in met.items() if n >= MET))}
    chain = Chain()
    for _ in range(2):
        bad = [(w, z) for (ws, y), zs in zip(docs, labels) if y for w, z in zip(ws, zs) if z.any()]
        good = [(w, np.zeros(len(w), int)) for (ws, y), zs in zip(docs, labels) for i, w in enumerate(ws) if w and not (y and zs[i].any())]
        every = lambda xs, n: [xs[i * len(xs) // n] for i in range(n)] if len(xs) > n else xs
        chain = _fit(Windows(every(bad, FIT_WINDOWS) + every(good, 2 * FIT_WINDOWS), known), known)
        # the chain labels the toxic rows' tokens again; a row keeps its old labels where it would have none
        scorer = Scorer(chain)
        for k, (ws, y) in enumerate(docs):
            if y and ws:
                p, first = scorer.marginals(ws)
                new = [p[a : a + len(w)] >= 0.5 for a, w in zip(first, ws)]
                if any(z.any() for z in new):
                    labels[k] = [z.astype(int) for z in new]
    return chain


class Windows:
    """Windows as arrays of token types, with the features of each type."""

    def __init__(self, rows: list[tuple[list[str], np.ndarray]], known: dict[str, int]):
        types: dict[str, int] = {"": 0}  # type 0: no token
        self.n = len(rows)
        self.type, self.label = np.zeros((self.n, WINDOW), np.int64), np.zeros((self.n, WINDOW), np.int64)
        for i, (w, z) in enumerate(rows):
            self.type[i, : len(w)] = [types.setdefault(t, len(types)) for t in w]
            self.label[i, : len(w)] = z
        self.real = self.type > 0
        own = [[known[f] for f in features(t) if f in known] if t else [] for t in types]
        self.of = np.repeat(np.arange(len(types)), [len(x) for x in own])
        self.own = np.array([f for x in own for f in x], np.int64)
        self.before, self.behind = (np.array([known.get(mark + t.lower(), 0) if t else 0 for t in types], np.int64) for mark in "<>")
        self.left, self.right = np.zeros_like(self.type), np.zeros_like(self.type)
        self.left[:, 1:], self.right[:, :-1] = self.type[:, :-1], self.type[:, 1:]
        self.left *= self.real
        self.size = len(types)


def objective(theta: np.ndarray, x: Windows, size: int) -> tuple[float, np.ndarray]:
    """Log likelihood of the labels and its gradient. theta: weights (0 unused), bias, start, move."""
    w = theta[:size].copy()
    w[0] = 0
    own = np.bincount(x.of, w[x.own], minlength=x.size)
    u = np.clip(own[x.type] + w[x.before][x.left] + w[x.behind][x.right] + theta[size], -30, 30)
    pot = np.stack([np.ones_like(u), np.exp(u)], axis=2)
    start, move = np.exp(theta[size + 1 : size + 3]), np.exp(theta[size + 3 :]).reshape(2, 2)
    fore, back, log_z = np.ones((x.n, WINDOW, 2)), np.ones((x.n, WINDOW, 2)), np.zeros(x.n)
    for t in range(WINDOW):
        v = (start[None] if t == 0 else fore[:, t - 1] @ move) * pot[:, t]
        total = v.sum(axis=1, keepdims=True)
        here = x.real[:, t, None]
        log_z += np.where(here, np.log(total), 0)[:, 0]
        fore[:, t] = np.where(here, v / total, fore[:, t - 1] if t else v / total)
    for t in range(WINDOW - 2, -1, -1):
        v = (back[:, t + 1] * pot[:, t + 1]) @ move.T
        back[:, t] = np.where(x.real[:, t + 1, None], v / v.sum(axis=1, keepdims=True), 1.0)
    both = fore * back
    p = np.where(x.real, both[..., 1] / both.sum(axis=2), 0)
    pair = x.real[:, 1:]
    joint = fore[:, :-1, :, None] * move * (back[:, 1:] * pot[:, 1:])[:, :, None, :]
    joint = joint / joint.sum(axis=(2, 3), keepdims=True) * pair[:, :, None, None]
    z = x.label
    counts = np.bincount((2 * z[:, :-1] + z[:, 1:])[pair], minlength=4)
    first = np.bincount(z[:, 0], minlength=2)
    gold = (u * z)[x.real].sum() + theta[size + 1 : size + 3] @ first + theta[size + 3 :] @ counts
    d = np.where(x.real, z - p, 0).ravel()
    grad = np.zeros_like(theta)
    by_type = np.bincount(x.type.ravel(), d, minlength=x.size)
    grad[:size] = np.bincount(x.own, by_type[x.of], minlength=size)
    for mark, beside in ((x.before, x.left), (x.behind, x.right)):
        grad[:size] += np.bincount(mark, np.bincount(beside.ravel(), d, minlength=x.size), minlength=size)
    grad[0] = 0
    grad[size] = d.sum()
    grad[size + 1 : size + 3] = first - np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])
    grad[size + 3 :] = counts - joint.sum(axis=(0, 1)).ravel()
    return float(gold - log_z.sum()), grad


def _fit(x: Windows, known: dict[str, int]) -> Chain:
    """Maximum conditional likelihood with a ridge on all weights, by limited-memory BFGS steps."""
    size = len(known) + 1

    def loss(theta):
        like, grad = objective(theta, x, size)
        return -like / x.n + RIDGE / 2 * float(theta @ theta), RIDGE * theta - grad / x.n

    theta = np.zeros(size + 1 + 2 + 4)
    theta[size] = -3.0
    value, grad = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        d, alphas = -grad, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, r), alpha in zip(past, reversed(alphas)):
            d = d + s * (alpha - r * (y @ d))
        step, slope = 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum()), grad @ d
        while True:
            new = theta + step * d
            new_value, new_grad = loss(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - theta, new_grad - grad
        theta, grad, gain, value = new, new_grad, value - new_value, new_value
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    weights = {f: round(float(theta[i]), 4) for f, i in known.items() if abs(theta[i]) >= 1e-3}
    return Chain(weights, float(theta[size]), tuple(map(float, theta[size + 1 : size + 3])), tuple((float(a), float(b)) for a, b in theta[size + 3 :].reshape(2, 2)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, with a ridge."""
    w = np.full(len(y), 1 / len(y))
    d, theta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ theta, -30, 30)))
        grad = d.T @ (w * (y - p)) - 1e-3 * theta * (0, 1)
        hess = (d * (w * p * (1 - p))[:, None]).T @ d + np.diag([1e-6, 1e-3])
        theta += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(theta[0]), float(theta[1])


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Chain:
    """A chain from the training folds (all but fold 0) of the labelled rows."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(key)) != 0))
    known = known.groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    pick = lambda y, n: known.where(F.col("__y") == y).orderBy(F.xxhash64("__k"), "__k").limit(n)
    chosen = F.broadcast(pick(1, TOXIC_ROWS).unionByName(pick(0, CLEAN_ROWS)))  # TOXIC_ROWS + CLEAN_ROWS rows of two numbers at most
    texts = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(chosen, F.col("__id") == F.col("__k"))
    texts = texts.groupBy("__k").agg(F.first("__y").alias("__y"), F.min(F.struct(F.xxhash64("__t").alias("h"), "__t")).alias("s"))
    texts = scratch.table(texts.select("__k", "__y", F.col("s.__t").alias("__t")), "sample")

    def sampled(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"k": pdf["__k"].astype(str), "y": pdf["__y"].astype("int32"), "w": [" ".join(" ".join(w) + "\n" for w in windows(t)) for t in pdf["__t"]]})

    rows = sorted(texts.select(F.col("__k").cast("string"), "__y", "__t").mapInPandas(sampled, "k string, y int, w string").collect())
    one: dict[str, str] = {}  # each word once
    chain = train([([[one.setdefault(t, t) for t in w.split()] for w in r["w"].split("\n") if w.strip()], r["y"]) for r in rows])
    del rows, one
    if chain.weights:

        def judged(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(chain)
            for pdf in it:
                yield pd.DataFrame({"k": pdf["__k"].astype(str), "x": [x for x, _ in scorer.evidence(list(pdf["__t"]))], "y": pdf["__y"].astype(float)})

        got = sorted(texts.select(F.col("__k").cast("string"), "__y", "__t").mapInPandas(judged, "k string, x double, y double").collect())
        chain.curve = _curve(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))
    scratch.drop(texts)
    return chain


def scores(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, spans): spans are start and end offsets in characters of every offending run of tokens."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(chain)
        for pdf in it:
            out = list(scorer.scores(list(pdf["__t"])))
            yield pd.DataFrame({"__k": pdf["__k"], "score": [s for s, _ in out], "spans": [[{"start": a, "end": b} for a, b in x] for _, x in out]})

    # keys go as strings: pandas has no whole numbers beside nulls
    rows = docs.select(F.col(key).cast("string").alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    out = rows.mapInPandas(run, "__k string, score double, spans array<struct<start:int,end:int>>")
    return out.select(F.col("__k").cast(docs.schema[key].dataType).alias(key), "score", "spans")


def report(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted, n_spans, spans ("start-end,...")."""
    s = scores(docs, fit(docs, labels, text, key), text, key)
    joined = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return s.select(key, (fold(F.col(key)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), joined.alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """docs without the documents that score ``threshold`` or more; each row is scored by its own text, with no join."""
    chain, at = fit(docs, labels, text, key), docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for batch in it:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for a, b in parts(sizes, BATCH_BYTES):  # a part of the batch at a time is Python objects
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([s < threshold for s, _ in scorer.scores(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
