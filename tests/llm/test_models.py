"""SentencePiece codec, audio and toxicity: parity, exact round trips, brute force and held-out accuracy."""

import hashlib
import itertools
import os
import random
import struct
import zlib

import numpy as np
import pytest

from quire.llm import audio, sentencepiece_codec as sp, toxicity

needs_model = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no tokenizer files")


def odd_texts():
    rng = random.Random(3)
    alpha = "ab cdé ñ日本語😀\t\n  <unk></s><0x41>ßﬁ١"
    fixed = ["", " ", "  ", "a", "a   b    c ", "\n\n", "<s>", "日本語😀🏳️‍🌈", "\x00\x01", "é", " " * 50 + "x", "word " * 30_000]
    return fixed + ["".join(rng.choice(alpha) for _ in range(rng.randint(1, 40))) for _ in range(400)]


@needs_model
def test_parity_and_round_trip(spark):
    import sentencepiece

    texts = odd_texts()
    assert sp.parity([*texts, "a▁b", "▁"]) == []
    theirs = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (2**60 + 1, "big id", "x")]
    got = sp.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    ids = {r.doc_id: r for r in got.collect()}
    for i, t, _ in rows:
        assert ids[i].ids == theirs.encode(t or "") and ids[i].round_trip and ids[i].n_bytes == len((t or "").encode())
    back = {r.doc_id: r.text for r in sp.decode(got).collect()}
    assert back == {i: t or "" for i, t, _ in rows}


def test_unigram_model_is_rebuilt():
    """A tiny unigram file, written by hand, gives the library's ids."""
    import struct

    import sentencepiece

    def field(n, wire, body):
        return bytes([n << 3 | wire]) + body

    def blob(n, b):
        size, out = len(b), b""
        while True:
            out += bytes([size & 127 | (128 if size > 127 else 0)])
            size >>= 7
            if not size:
                return field(n, 2, out + b)

    piece = lambda p, s, k=1: blob(1, blob(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + (field(3, 0, bytes([k])) if k != 1 else b""))
    pieces = [("<unk>", 0, 2), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -3), ("a", -4), ("b", -4), ("c", -4.5), ("ab", -5), ("▁a", -3.5), ("▁ab", -4.2), ("abc", -6), ("bc", -5.2)]
    data = b"".join(piece(*p) for p in pieces) + blob(2, field(3, 0, b"\x01") + b"\x98\x02\x01") + blob(3, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = sp.WordEncoder(data)
    assert coder.model.kind == sp.UNIGRAM and coder.model.byte_fallback
    for t in ["abc", "ab abc", "a b c", "cab bc", "é ab", "  abab", "xyz"]:
        assert coder.encode([t])[0].tolist() == theirs.encode(t), t


def test_audio_report(spark):
    texts = ["", "a", "é" * 300, "x" * 576, "y" * 577, "long " * 60_000, None, "x" * 576] + ["z" * (576 * n) for n in range(1, 8)]
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(2**60 + 1, "a", "m"), (None, "a", "m")]
    got = {r.doc_id: r for r in audio.report(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        b, r = (t or "").encode(), got[i]
        p = b + b"\xff" * (-len(b) % 576 or 576 * (not b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[3][1:] == got[7][1:] and len({got[i].feature.split(";")[0] for i in range(len(texts))}) == 3


def plain_samples(media):
    """Samples of a WAV file one by one: G.711 by its rules, IMA ADPCM from each block's header."""
    (tag, _, _, _, align), at, out = struct.unpack_from("<HHIIH", media, 20), media.index(b"data") + 8, []
    data = media[at : at + struct.unpack_from("<I", media, at - 4)[0]]
    if tag == 7:
        for b in data:
            c = ~b & 255
            size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
            out.append(-size if c & 128 else size)
    elif tag == 6:
        for b in data:
            c = b ^ 0x55
            seg, part = c >> 4 & 7, (c & 15) << 4
            size = part + 8 if seg == 0 else (part + 264) << (seg - 1)
            out.append(size if c & 128 else -size)
    else:
        for k in range(0, len(data), align):
            value, index = struct.unpack_from("<hB", data, k)
            out.append(value)
            for b in data[k + 4 : k + align]:
                for c in (b & 15, b >> 4):
                    step = int(audio.STEPS[index])
                    diff = (step >> 3) + (step if c & 4 else 0) + (step >> 1 if c & 2 else 0) + (step >> 2 if c & 1 else 0)
                    value = max(-32768, min(32767, value - diff if c & 8 else value + diff))
                    index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[c & 7]))
                    out.append(value)
    return out


def plain_resampled(x):
    return [v for i, a in enumerate(x) for v in (a, (a + x[i + 1]) >> 1 if i + 1 < len(x) else a)]


def test_stored_pcm_and_features(spark, tmp_path):
    texts = ["", "é" * 300, "Hello, world. " * 100, "z" * 1800, None, "The quick brown fox. " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {r.doc_id: bytes(r.media) for r in audio.stored(df).collect()}
    got = {r.doc_id: r for r in audio.store_pcm(df, f"{tmp_path}/pcm").collect()}
    assert set(got) == set(range(len(texts))) and len({r.codec for r in got.values()}) == 3
    for i, m in media.items():
        x = plain_samples(m)
        up = plain_resampled(x)
        assert np.frombuffer(got[i].pcm, "<i2").tolist() == up
        rms, cross = int((sum(v * v for v in x) / len(x)) ** 0.5), sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        crc = zlib.crc32(struct.pack(f"<{len(up)}h", *up))
        assert got[i].feature == f"codec={got[i].codec};samples={len(x)};peak={max(map(abs, x))};rms={rms};crossings={cross};pcm16k={len(up)};pcm_crc32={crc}"
    assert {r.doc_id: r.feature for r in audio.report(df).collect()} == {i: r.feature for i, r in got.items()}


@pytest.mark.parametrize("codec", audio.CODECS)
def test_wav_round_trip(codec):
    p = bytes(np.random.default_rng(1).integers(0, 256, 576 * 7, dtype=np.uint8))
    back = audio.unwav(audio.wav(p, codec))
    assert (back.codec, back.rate, back.payload) == (codec, 8000, p)
    with pytest.raises(ValueError):
        audio.unwav(audio.wav(p, codec)[:-5])
    two = bytearray(audio.wav(p, codec))
    two[22] = 2  # channels
    with pytest.raises(ValueError, match="channels"):
        audio.unwav(bytes(two))


def test_adpcm_blocks_begin_with_their_headers():
    """Files from elsewhere: other predictors, step indices and block sizes, and a sample count that ends inside a block."""
    rng = np.random.default_rng(5)
    sounds, want = [], []
    for align, blocks, count in ((256, 3, 1300), (580, 2, None), (36, 5, 7)):
        body = rng.integers(0, 256, (blocks, align), dtype=np.uint8)
        body[:, 2:4] = 0
        body[:, 2] = rng.integers(0, 89, blocks)
        body[0, :3] = (0x10, 0x27, 40)  # 10000, step index 40
        fmt = struct.pack("<HHIIHHHH", 0x11, 1, 8000, 4000, align, 4, 2, 2 * (align - 4) + 1)
        chunk = lambda name, x: name + struct.pack("<I", len(x)) + x
        parts = b"WAVE" + chunk(b"fmt ", fmt) + (chunk(b"fact", struct.pack("<I", count)) if count else b"") + chunk(b"data", body.tobytes())
        media = b"RIFF" + struct.pack("<I", len(parts)) + parts
        sounds.append(audio.unwav(media))
        want.append(plain_samples(media)[:count])
    assert [x.tolist() for x in audio.decode_all(sounds)] == want and all(w[0] == 10000 for w in want)


def test_law_tables():
    mu, a = audio.LAWS["mulaw"].astype(int), audio.LAWS["alaw"].astype(int)
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80], mu[0x8F]) == (0, 0, -32124, 32124, 16764)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA], a[0x80]) == (8, -8, -32256, 32256, 5504)
    assert (np.sort(mu) == np.sort(-mu)).all() and (np.sort(a) == np.sort(-a)).all() and len(set(a)) == 256


def labelled(n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    bad = ["zuqqa", "zuqqen", "xorvik", "xorvom", "wyzzt"]
    docs = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randint(2, 6) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "", "la", "tu"]))
        docs.append((i, " ".join(w), toxic))
    return docs


@pytest.fixture(scope="module")
def chain():
    return toxicity.train([(toxicity.windows(t), y) for i, t, y in labelled() if zlib.crc32(str(i).encode()) % 5])


def single(chain, tokens):
    """Forward-backward over single tokens with every feature summed up."""
    get, low = chain.weights.get, [t.lower() for t in tokens]
    m, start, u = np.exp(np.array(chain.move)), np.exp(np.array(chain.start)), []
    for i, t in enumerate(tokens):
        x = chain.bias + sum(get(f, 0) for f in toxicity.features(t))
        x += get("<" + low[i - 1], 0) if i else 0
        x += get(">" + low[i + 1], 0) if i + 1 < len(low) else 0
        u.append(np.array([1, np.exp(x)]))
    fore, back = [start * u[0] / (start * u[0]).sum()], [np.ones(2)]
    for x in u[1:]:
        v = fore[-1] @ m * x
        fore.append(v / v.sum())
    for x in u[:0:-1]:
        v = m @ (x * back[-1])
        back.append(v / v.sum())
    both = np.array(fore) * np.array(back[::-1])
    return both[:, 1] / both.sum(axis=1)


def test_marginals_against_single_tokens(chain):
    """The blocks of a batch of documents give what forward-backward over each document's tokens gives, for every token."""
    texts = [t for _, t, _ in labelled(60, 9)] + ["", "zuqqa", "plain " * 9000 + "zuqqa wyzzt " + "plain " * 9000, ""]
    docs = [toxicity.TOKEN.findall(t) for t in texts]
    p, first = toxicity.Scorer(chain).marginals(docs)
    assert len(p) == sum(map(len, docs))
    for d, a in zip(docs, first):
        if d:
            assert np.allclose(single(chain, d), p[a : a + len(d)], atol=1e-9)
    scored = list(toxicity.Scorer(chain).evidence(texts))
    for d, (x, own) in zip(docs, scored):
        q = single(chain, d) if d else np.zeros(0)
        assert len(own) == len(d) and x == pytest.approx(np.log(0.01 - sum(v * np.log1p(-min(v, 1 - 1e-12)) for v in q)), abs=1e-6)
    assert p.max() > 0.9 and all(0 <= x < 1e-3 for x in single(chain, ["plain"] * 50))


def test_objective_against_all_labellings(monkeypatch):
    """The likelihood of windows of four tokens as a sum over all 16 labellings, and its gradient by differences."""
    monkeypatch.setattr(toxicity, "WINDOW", 4)
    rows = [(["Bad", "dog", "Bad", "9"], [1, 0, 1, 0]), (["dog", "bad"], [0, 1]), (["cat"], [0]), (["a", "dog", "cat"], [0, 0, 0])]
    names = sorted({f for w, _ in rows for t in w for f in [*toxicity.features(t), "<" + t.lower(), ">" + t.lower()]})
    known = {f: i + 1 for i, f in enumerate(names)}
    x, size = toxicity.Windows([(w, np.array(z)) for w, z in rows], known), len(known) + 1
    theta = np.random.default_rng(3).normal(size=size + 7)
    theta[0] = 0

    def weight(w, z):
        get = lambda f: theta[known[f]]
        out = theta[size + 1 + z[0]] + sum(theta[size + 3 + 2 * a + b] for a, b in zip(z, z[1:]))
        for i, t in enumerate(w):
            if z[i]:
                out += theta[size] + sum(map(get, toxicity.features(t)))
                out += (get("<" + w[i - 1].lower()) if i else 0) + (get(">" + w[i + 1].lower()) if i + 1 < len(w) else 0)
        return out

    want = sum(weight(w, z) - np.log(sum(np.exp(weight(w, y)) for y in itertools.product((0, 1), repeat=len(w)))) for w, z in rows)
    value, grad = toxicity.objective(theta, x, size)
    assert value == pytest.approx(want, abs=1e-9)
    for i in range(1, len(theta)):
        d = np.zeros_like(theta)
        d[i] = 1e-5
        slope = (toxicity.objective(theta + d, x, size)[0] - toxicity.objective(theta - d, x, size)[0]) / 2e-5
        assert grad[i] == pytest.approx(slope, abs=1e-5), i


def test_windows_cover_the_whole_text():
    words = [f"w{i}" for i in range(100_000)]
    got = toxicity.windows(" ".join(words))
    assert len(got) == toxicity.ROW_WINDOWS and got[0][0] == "w0" and int(got[-1][0][1:]) > 97_000
    assert [t for w in toxicity.windows(" ".join(words[:500])) for t in w] == words[:500] and toxicity.windows("") == []


def test_marking_needs_more_than_chance():
    """Words that are met in toxic rows alone, but in no more than chance brings, mark nothing."""
    rng = random.Random(2)
    docs = [([[f"w{rng.randrange(4000)}" for _ in range(40)]], int(i % 8 == 0)) for i in range(400)]
    assert toxicity.marking(docs) == set()
    bad = [([["zuqqa" if j % 9 == 4 else t for j, t in enumerate(w[0])]], y) if y else (w, y) for w, y in docs]
    assert "=zuqqa" in toxicity.marking(bad) and all(f[1:4] == "zuq" for f in toxicity.marking(bad))


def test_choice_among_repeated_ids(spark):
    """Two texts of one labelled id: the fit doesn't depend on the order of rows."""
    rows = labelled()
    twice = [(i, t) for i, t, _ in rows] + [(i, t[::-1]) for i, t, _ in rows[:50]]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    chains = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((twice, 1), (twice[::-1], 5))]
    assert chains[0] == chains[1] and chains[0].weights


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "zuqqa xorvik", "x"), (3, rows[3][1], "x"), (9003, "plain " * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, None if i % 50 == 0 else y) for i, _, y in rows] + [(None, 1), (5, rows[5][2])], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows) + 5
    truth = {i: y for i, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    assert all(r.score < 0.2 and r.n_spans == 0 for r in got if r.doc_id in (9001, 9002, 9003))
    text = dict((i, t) for i, t, _ in rows)
    spans = [text[r.doc_id][int(a) : int(b)] for r in got if r.spans and r.doc_id is not None for a, b in (s.split("-") for s in r.spans.split(","))]
    assert spans and np.mean([s[:3] in ("zuq", "xor", "wyz") for s in spans]) > 0.95
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.report(docs, labels).first().score == 0.0
    assert toxicity.report(docs.limit(0), labels).collect() == []
