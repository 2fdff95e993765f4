"""The pipeline against a brute-force version, stage by stage, and the queries' SQL is well named."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import queries, sentencepiece_codec, toxicity
from quire.llm.text import read
from tests.llm.test_dedup import near_groups
from tests.llm.test_text_operators import brute_lines
from tests.llm.test_warc_mixing import fill

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.exists(SF) and os.path.exists(sentencepiece_codec.MODEL)), reason="no test data")


def test_stages(spark):
    docs = read(spark, SF, "documents")
    plain = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    labels = read(spark, SF, "labels")
    bad = {r.doc_id for r in toxicity.report(docs, labels).where("predicted = 1").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    rows = [r for r in plain if r[0] not in bad]
    assert sorted(map(tuple, clean.collect())) == rows

    deduped = corpus_pipeline.drop_repeated_lines(spark, clean, SF)
    want = []
    for i, (n, gone) in brute_lines(rows, 2)[0].items():
        if not n or len(gone) < n:
            want.append((rows[i][0], "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k not in gone), *rows[i][2:]))
    assert sorted(map(tuple, deduped.collect())) == sorted(want)

    want.sort()
    single = corpus_pipeline.drop_near_copies(spark, deduped, SF)
    kept = {tuple(r) for r in single.collect()}
    texts = [r[1] for r in want]
    # one threshold: nothing goes that no text of similarity 0.8 keeps, and nearly all that such a text keeps go
    first = {want[i] for i in near_groups(texts)[0]}
    assert kept >= first and len(kept - first) <= 0.05 * (len(want) - len(first))
    want = sorted(kept)

    mixed = corpus_pipeline.mix_sources(spark, single, SF)
    assert mixed.columns == docs.columns
    took = Counter(map(tuple, mixed.collect()))
    assert set(took) <= set(want) and max(took.values()) <= 2
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in want}
    by, got = Counter(), Counter()
    for r in want:
        by[r[3]] += size[r]
        got[r[3]] += size[r] * took[r]
    for s, t in fill(by).items():
        assert abs(got[s] - t) <= max(size[r] for r in want if r[3] == s)

    ids = corpus_pipeline.encode(spark, mixed, SF)
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rows = ids.select("doc_id", "ids", "round_trip").collect()
    text = {r[0]: r[1] for r in want}
    assert all(r.round_trip and r.ids == theirs.encode(text[r.doc_id]) for r in rows) and len(rows) == sum(took.values())


def test_run_equals_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.select("doc_id", "n_tokens").collect())
    assert key(got) == key(docs)


def test_every_oracle_names_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert [f"op{n}" for n in range(1, 11)] == [q.split("_")[0] for q in queries.queries()]


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "pages"):
        read(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in queries.queries().items():
        assert q(spark, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_everywhere(spark, tmp_path):
    """Every column of every row null, beside some rows of the tables."""
    for t in ("documents", "labels", "pages"):
        df = read(spark, SF, t).limit(30)
        null = df.limit(3).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
        df.unionByName(null).withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in queries.queries().items():
        n = len(q(spark, str(tmp_path)).collect())
        assert n == 33 or name.startswith("op5"), name
    corpus_pipeline.run(spark, str(tmp_path)).collect()
