"""Word bounds, range hashes and sliding minima against plain Python."""

import random

import numpy as np
import pyarrow as pa

from terrane.llm.text import PrefixHash, slices, sliding_min, text_bytes, word_bounds

TEXTS = ["ab  c\td", "", None, " x", "é ß\x0bz ", "\n", "one"]


def test_words_stay_in_their_row():
    data, rows = text_bytes(pa.array(TEXTS))
    starts, ends, first = word_bounds(data, rows)
    got = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [(t or "").encode().split() for t in TEXTS]


def test_equal_ranges_hash_alike():
    data = np.frombuffer(b"abcabdabc", dtype=np.uint8)
    of = PrefixHash(data).of(np.array([0, 6, 3, 0]), np.array([3, 9, 6, 2]))
    assert of[0] == of[1] != of[2] and of[3] == PrefixHash(data[:2]).of(np.array([0]), np.array([2]))[0]


def test_sliding_minimum():
    random.seed(1)
    values = np.array([random.randrange(50) for _ in range(60)], dtype=np.uint64)
    for width in (1, 2, 3, 7, 43):
        assert sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(60 - width + 1)]


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr("terrane.llm.text.SLICE_BYTES", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    parts = list(slices([batch, batch.slice(0, 0)]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == TEXTS and len(parts) > 2
