"""Exact best k against scores over all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import search


def brute(rows, queries, k):
    fold = {c: c + 32 for c in range(65, 91)}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
    docs = [(i, collections.Counter(words(t))) for i, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = collections.Counter(w for _, c in docs for w in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in docs:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in set(words(text)) if w in c)
            if s > 0:
                scores.append((-round(s, 9), i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("seed,block_terms,shard", [(1, 10_000, 1 << 20), (2, 60, 3000)])
def test_best_k(docs_of, llm_ws, monkeypatch, seed, block_terms, shard):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    random.seed(seed)
    word = lambda: f"w{int(random.paretovariate(0.5)) % 300}"
    rows = [(i, " ".join(word() for _ in range(random.randint(0, 60)))) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (202, None), (None, rows[3][1])]
    queries = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] % 10 == 3] + [(500, "nowhere"), (501, "")]
    docs = docs_of(rows)
    asked = docs.sparkSession.createDataFrame(queries, "query_id long, text string")
    got = search.top_k(docs, asked, llm_ws, k=5, block_terms=block_terms).collect()
    got = sorted(((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in got), key=lambda x: x[:2])
    want = brute(rows, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-7 for g, w in zip(got, want))


def shard_of(texts: list[list[int]], width: int, ids=None):
    """A shard of documents given as term numbers, its queries' unit, and all scores of a query."""
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    term = np.array([t for own in texts for t in own])
    length = np.array([len(t) for t in texts])
    idf = np.log1p(len(texts) / (1 + np.bincount(term, minlength=width)))
    unit = search.quantum(idf, [np.unique(t) for t in texts[:50]])
    ids = np.arange(len(texts)) if ids is None else ids
    mean = length.mean()

    def scores(query):
        found = np.zeros(len(texts))
        for d, own in enumerate(texts):
            for t, tf in collections.Counter(own).items():
                if t in query:
                    norm = 1.2 * (0.25 + 0.75 * len(own) / mean)
                    found[d] += round(idf[t] * tf * 2.2 / (tf + norm) / unit) * unit
        return found

    return search.Shard(doc, term, length, ids, idf, mean, unit), scores


def test_blocks_are_skipped():
    """With common terms and strong matches, most blocks are passed over, and the result is exact."""
    rng = np.random.default_rng(1)
    texts = [np.concatenate([np.arange(20), 20 + rng.integers(0, 3000, 40)]).tolist() for _ in range(2000)]
    for i in range(1, 5):
        texts[500 * i - 7] = texts[77][:-i]
    shard, scores = shard_of(texts, 3020)
    queries = [np.unique(texts[77]), np.unique(texts[1500][:25])]
    found = {q: (ids, values) for q, ids, values in shard.best(queries, np.zeros(2), 3)}
    for q, query in enumerate(queries):
        want = scores(set(query.tolist()))
        order = np.lexsort((np.arange(2000), -want))[:3]
        ids, values = found[q]
        rank = np.lexsort((ids, -values))
        assert np.array_equal(ids[rank], order) and np.array_equal(values[rank], want[order])
    blocks = shard.blocks * len(queries)
    assert shard.skipped > blocks / 3 and shard.scored + shard.skipped * search.BLOCK_DOCS == blocks * search.BLOCK_DOCS


def test_a_third_of_equal_documents():
    """Ties leave a shard as the k smallest ids, not as all copies."""
    rng = np.random.default_rng(2)
    copy = rng.integers(0, 200, 30).tolist()
    texts = [copy if i % 3 == 0 else rng.integers(0, 200, 30).tolist() for i in range(900)]
    ids = rng.permutation(900)
    shard, scores = shard_of(texts, 200, ids)
    want = np.sort(ids[::3])[:10]
    found = list(shard.best([np.unique(copy)] * 3, np.zeros(3), 10))
    assert [q for q, _, _ in found] == [0, 1, 2]
    for _, got, values in found:
        assert np.array_equal(np.sort(got), want) and len(set(values.tolist())) == 1
    assert values[0] == scores(set(copy)).max()
    # From the best score up, the equal ones are still all within reach.
    assert all(np.array_equal(np.sort(got), want) for _, got, _ in shard.best([np.unique(copy)], np.array([values[0]]), 10))


def test_odd_rows(odd_docs, llm_ws):
    asked = odd_docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("query_id"), "text")
    assert search.top_k(odd_docs, asked, llm_ws).where("rank = 1").count() >= 4
    assert search.top_k(odd_docs.limit(0), asked, llm_ws.child("a")).count() == 0
    assert search.top_k(odd_docs, asked.limit(0), llm_ws.child("b")).count() == 0


def test_postings_of_rare_terms_are_summed_in_parts(monkeypatch):
    rng = random.Random(8)
    texts = [[rng.randrange(3000) for _ in range(120)] for _ in range(600)]
    shard, _ = shard_of(texts, 3000)
    queries = [np.unique(t).astype(np.int32) for t in texts[:200]]
    best = lambda: [(q, list(i), list(v)) for q, i, v in shard.best(queries, np.zeros(200), 5)]
    whole, longest, plain = best(), [], np.bincount
    monkeypatch.setattr(search.np, "bincount", lambda x, *a, **k: longest.append(len(x)) or plain(x, *a, **k))
    # More than one query has at a time, less than all.
    monkeypatch.setattr(search, "POSTINGS", 20_000)
    assert best() == whole
    assert max(longest) <= 200 * 120  # query and term pairs; the postings come in parts


def test_texts_are_read_once(docs_of, llm_ws):
    """However many groups the queries go in, each text is read once."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(30))) for i in range(60)]
    docs = docs_of(rows)
    read = docs.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    queries = docs.where("doc_id % 6 = 0").selectExpr("doc_id AS query_id", "text")
    found = search.top_k(docs.mapInArrow(counted, docs.schema), queries, llm_ws, k=3, block_terms=60).collect()
    assert len(search._groups(queries.selectExpr("query_id", "split(text, ' ') AS terms"), 60)) > 3
    assert read.value == len(rows)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in found)
    assert got == [w[:3] for w in brute(rows, [r for r in rows if r[0] % 6 == 0], 3)]


def test_more_words_than_one_table_holds(docs_of, llm_ws, monkeypatch):
    """Groups with many distinct words get tables of their own, with the same result."""
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{rng.randrange(100 * (i % 4) + 100)}" for _ in range(25))) for i in range(40)]
    docs = docs_of(rows)
    queries = docs.where("doc_id % 5 = 0").selectExpr("doc_id AS query_id", "text")
    tables = []
    plain = search._numbered
    monkeypatch.setattr(search, "_numbered", lambda *a: tables.append(1) or plain(*a))
    monkeypatch.setattr(search, "VOCABULARY", 60)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 100)
    monkeypatch.setattr(search, "PART_DOCS", 7)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.top_k(docs, queries, llm_ws, k=4, block_terms=50).collect())
    assert got == [w[:3] for w in brute(rows, [r for r in rows if r[0] % 5 == 0], 4)]
    assert 1 < len(tables) <= 8
