"""The toxicity classifier: features, ratios, held-out accuracy, long texts and odd rows."""

import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import toxicity

SETTINGS = toxicity.Settings()
RUDE = ("grimbol", "fleckwit", "Übelkram")


def corpus(n=500):
    random.seed(31)
    word = lambda: "".join(random.choice(("ta", "ri", "no", "el", "su", "ö")) for _ in range(random.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(random.choice((3, 20, 60, 400)))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randrange(len(words)), random.choice(RUDE) if random.random() < 0.7 else random.choice(RUDE).upper())
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture()
def tables(spark, docs_of):
    rows = corpus()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, toxic int")
    return docs_of([(i, t) for i, t, _ in rows]), labels, {i: q for i, _, q in rows}, {i: t for i, t, _ in rows}


def test_grams_are_runs_of_characters():
    texts = ["Aé b", "", "xy", "ÉÉÉ\tz"]
    seen = {}
    for size in (2, 3):
        for text, key in toxicity.grams(pa.array(texts), (size,)):
            spelt = [(i, t[j : j + size]) for i, t in enumerate(texts) for j in range(len(t) - size + 1)]
            assert text.tolist() == [i for i, _ in spelt]
            for (_, gram), k in zip(spelt, key.tolist()):
                folded = "".join(" " if c.isspace() else c.lower() if "A" <= c <= "Z" else c for c in gram)
                assert seen.setdefault(folded, k) == k
    assert len(set(seen.values())) == len(seen)


def test_counts_and_ratios_equal_plain_ones(tables):
    docs, labels, toxic, texts = tables
    used = [i for i in texts if zlib.crc32(str(i).encode()) % 5 and i != 5] + [5]
    have, lack = Counter(), Counter()
    for i in used:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])
        (have if toxic[i] else lack).update({folded[j : j + 4] for j in range(len(folded) - 3)})
    settings = replace(SETTINGS, sizes=(4,))
    sample = toxicity.sampled(docs, labels, settings)
    counts = {r.key: (r.toxic, r.other) for r in toxicity.counted(sample, settings).collect()}
    whole = counts.pop(None)
    assert whole == (sum(toxic[i] for i in used), sum(not toxic[i] for i in used))
    assert Counter(counts.values()) == Counter((have[g], lack[g]) for g in {*have, *lack})
    keys, ratio, odds = toxicity.ratios(toxicity.counted(sample, settings), settings)
    share = whole[0] / sum(whole)
    expected = {round(math.log((have[g] + share) / (lack[g] + 1 - share)) - odds, 9) for g in have}
    assert len(keys) > 10 and {round(x, 9) for x in ratio[ratio > 0]} <= expected


def test_held_out_accuracy_whatever_the_length(tables, llm_ws):
    docs, labels, toxic, texts = tables
    classifier = toxicity.train(docs, labels, llm_ws)
    rows = toxicity.score(docs, classifier, ["doc_id"]).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.score >= 0.5) == bool(toxic[r.doc_id]) for r in held]
    assert len(held) > 60 and np.mean(right) > 0.98
    # A long clean text stays clean, and one word at its end is found.
    long = " ".join(t for i, t in texts.items() if not toxic[i])
    long_text = long * (1 + 200_000 // len(long))
    scores = classifier.scores(pa.array([long_text, long_text + " " + RUDE[0], "", None, RUDE[1].upper() + " so"]))
    assert scores[0] < 0.5 <= scores[1] and scores[2] == scores[3] < 0.5 <= scores[4]


def test_scores_come_from_the_text_alone(tables, llm_ws):
    docs, labels, _, _ = tables
    classifier = toxicity.train(docs, labels, llm_ws)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("zz"), "doc_id": F.col("doc_id") + 10_000})
    scores = lambda d: sorted(r.score for r in toxicity.score(d, classifier, ["doc_id"]).collect())
    assert scores(docs) == scores(other)


def test_partitions_do_not_change_the_model(tables, llm_ws):
    docs, labels, _, _ = tables
    before, after = (toxicity.train(d, labels, llm_ws.child("model")) for d in (docs, docs.repartition(7)))
    assert np.array_equal(before.keys, after.keys) and np.allclose(before.weights, after.weights) and len(before.keys) > 10


def test_odd_rows(spark, odd_docs, tables, llm_ws):
    docs, labels, _, _ = tables
    classifier = toxicity.train(odd_docs, labels, llm_ws)
    rows = toxicity.score(odd_docs, classifier, ["doc_id", "host"]).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    by_text = {(r.doc_id, round(r.score, 9)) for r in rows if r.doc_id == 6}
    assert len(by_text) <= 2
    for d, marks in ((odd_docs, labels.limit(0)), (odd_docs.limit(0), labels), (docs, labels.where("toxic = 1")), (docs, labels.where("toxic = 0"))):
        found = toxicity.score(odd_docs, toxicity.train(d, marks, llm_ws.child("odd")), ["doc_id"]).collect()
        assert len(found) == 11 and len({r.score for r in found}) == 1
    assert toxicity.score(odd_docs.limit(0), classifier, ["doc_id"]).count() == 0
