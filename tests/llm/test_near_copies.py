"""Near copies against exact Jaccard similarity of five-word shingles."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from terrane.llm import near_copies
from terrane.llm.text import table
from tests.conftest import SF_DIR


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts, least=0.5):
    """{(id, id): similarity} of all pairs of `texts` (id -> text) at `least` or more that share a shingle."""
    sets, holders, shared = {i: shingle_set(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        shared.update(combinations(sorted(ids), 2))
    found = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    return {p: s for p, s in found.items() if s >= least}


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def same_group(found, pairs):
    group = {r.doc_id: r.component_id for r in found}
    return sum(group[a] == group[b] for a, b in pairs)


@pytest.mark.parametrize("busy", [4096, 5])
def test_planted_copies(docs_of, llm_ws, busy):
    rng = random.Random(3)
    texts = {}
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k, edits in enumerate([0, 0, 1, 2, 4, 5]):  # the last has a similarity of about 0.85
            texts[base * 10 + k] = edited(words, edits, rng)
        texts[base * 10 + 9] = edited(words, 60, rng)
    found = near_copies.groups(docs_of(list(texts.items())), llm_ws, busy=busy).collect()
    pairs = similar_pairs(texts, 0.1)
    close = [p for p, s in pairs.items() if s >= 0.8]
    assert same_group(found, close) >= 0.97 * len(close)
    assert same_group(found, [p for p, s in pairs.items() if s < 0.5]) == 0
    for r in found:
        assert r.kept == (r.doc_id == r.component_id)


def test_one_large_group_is_walked_in_chunks(docs_of, llm_ws):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, edited(words, 1, rng)) for i in range(300)]
    found = near_copies.groups(docs_of(rows), llm_ws, busy=16).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


@pytest.mark.parametrize("busy", [4096, 16, 3])
def test_no_link_of_a_busy_value_is_lost(spark, llm_ws, busy):
    # All meet under one value only. Chains link neighbours alone, so in chunks mostly others than the roots link.
    rng, bits, chain = np.random.default_rng(5), [], []
    for c in range(12):
        base = rng.integers(0, 2, near_copies.SHINGLE_BITS, dtype=np.uint8)
        for k in range(10):
            bits.append(base.copy())
            chain.append(c)
            base[100 * k : 100 * k + 100] ^= 1
    words = rng.integers(0, 1 << 32, (len(bits), near_copies.SEGMENTS), dtype=np.uint32)
    words[:, 0] = 0
    rows = [(i, w.tobytes(), np.packbits(b).tobytes()) for i, (w, b) in enumerate(zip(words, bits))]
    nodes = spark.createDataFrame(rows, "node long, words binary, shingles binary").repartition(3)
    links = [(r.a, r.b) for r in near_copies.close_pairs(nodes, llm_ws, busy).collect()]
    assert all((bits[a] != bits[b]).sum() <= near_copies.DISTANCE for a, b in links)
    group = list(range(len(rows)))
    for a, b in links:
        group = [group[a] if g == group[b] else g for g in group]
    assert len(set(zip(chain, group))) == 12 and len(set(group)) == 12


def test_test_table(spark, llm_ws):
    docs = table(spark, SF_DIR, "documents")
    pairs = similar_pairs({r.doc_id: r.text for r in docs.collect()})
    found = near_copies.groups(docs, llm_ws).collect()
    close = [p for p, s in pairs.items() if s >= 0.8]
    assert close and same_group(found, close) >= 0.9 * len(close)


def test_majority_is_the_plain_one():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 600).astype(np.uint64)
    single = np.unpackbits(np.frombuffer(b"".join(near_copies._majority(hashes[i : i + 1], 256) for i in range(600)), np.uint8).reshape(600, -1), axis=1)
    assert near_copies._majority(hashes, 256) == np.packbits(2 * single.sum(axis=0) > 600).tobytes()
    assert near_copies._majority(hashes[:0], 256) == bytes(32)


def test_odd_rows(odd_docs, llm_ws):
    assert near_copies.groups(odd_docs, llm_ws).count() == 11
    kept = near_copies.one_of_each(odd_docs, llm_ws.child("odd"))
    assert kept.columns == odd_docs.columns
    texts = sorted(r.text or "" for r in kept.select("text").collect())
    assert texts.count("same words here again") == 1 and texts.count("one two three four") == 1
    assert near_copies.one_of_each(odd_docs.limit(0), llm_ws.child("none")).count() == 0
