"""The factorisation machine: the identity, held-out accuracy, inputs, and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import fm

SMALL = fm.Settings(buckets=256, rank=3, sample_rows=400, epochs=30, batch=32)


def corpus(n=400):
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(1, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(random.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            words = random.choice([[w.upper() + "!!" for w in words], [words[0]] * len(words), [w + "###" for w in words]])
        rows.append((i, " ".join(words), int(not bad)))
    return rows


@pytest.fixture()
def tables(spark, docs_of):
    rows = corpus()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (99_999, 0)], "doc_id long, quality int")
    return docs_of([(i, t) for i, t, _ in rows]), labels, {i: q for i, _, q in rows}


def test_pairs_by_the_identity_equal_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = fm.Machine(0.2, rng.normal(size=30), rng.normal(size=(30, 4)), np.zeros(len(fm.STATISTICS)), np.ones(len(fm.STATISTICS)))
    which, value = rng.choice(30, 9, replace=False), rng.normal(size=9)
    got, _ = machine.margin(which, value, np.zeros(9, np.int64), 1)
    pairs = sum(value[a] * value[b] * machine.factors[which[a]] @ machine.factors[which[b]] for a in range(9) for b in range(a))
    assert np.isclose(got[0], 0.2 + machine.weights[which] @ value + pairs)


def test_slices_do_not_change_features(monkeypatch):
    texts = pa.array([t for _, t, _ in corpus(60)] + ["", None], pa.large_string())
    whole = fm.features(texts, 64)
    monkeypatch.setattr("terrane.llm.text.SLICE_BYTES", 300)
    assert all(np.array_equal(a, b) for a, b in zip(whole, fm.sliced_features(texts, 64)))


def test_held_out_accuracy(tables):
    docs, labels, good = tables
    machine = fm.train(docs, labels, SMALL)
    rows = fm.score(docs, machine, ["doc_id"]).withColumn("held_out", fm.held_out()).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [((r.score >= SMALL.threshold) == bool(good[r.doc_id])) for r in rows if r.held_out]
    assert len(judged) > 50 and np.mean(judged) > 0.97
    kept = fm.good_documents(docs, machine, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= SMALL.threshold}


def test_scores_do_not_depend_on_other_columns(tables):
    docs, labels, _ = tables
    machine = fm.train(docs, labels, SMALL)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("zz"), "doc_id": F.col("doc_id") + 10_000})
    scores = lambda d: sorted(r.score for r in fm.score(d, machine, ["doc_id"]).collect())
    assert scores(docs) == scores(other)


def test_odd_rows(spark, odd_docs, tables):
    _, labels, _ = tables
    machine = fm.train(odd_docs, labels, SMALL)
    rows = fm.score(odd_docs, machine, ["doc_id"]).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert fm.good_documents(odd_docs, machine).columns == odd_docs.columns
    for docs, marks in ((odd_docs, labels.limit(0)), (odd_docs.limit(0), labels), (odd_docs, labels.where("quality = 1"))):
        assert fm.score(odd_docs, fm.train(docs, marks, SMALL), ["doc_id"]).count() == 11
    assert fm.score(odd_docs.limit(0), machine, ["doc_id"]).count() == 0
