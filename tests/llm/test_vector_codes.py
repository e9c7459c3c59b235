"""Vector codes against plain k-means over integers: candidates, ties, rounds, labels and odd rows."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error, label_error)} and the digest, with Python integers and every part against every entry."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    cut = {}
    for vec_id, vector, _ in kept:
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        whole += [0] * (-len(whole) % parts)
        width = len(whole) // parts
        cut[vec_id] = [whole[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut[r[0]][p] for r in kept[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for c in cut.values():
                own.setdefault(near(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else e for i, e in enumerate(book)]
    found = {i: [near(c[p], books[p]) for p in range(parts)] for i, c in cut.items()}
    errors = {i: sum(d for d, _ in f) for i, f in found.items()}
    by_label = {}
    for vec_id, _, label in kept:
        by_label[label] = by_label.get(label, 0) + errors[vec_id]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {(r[0], bytes(e for _, e in found[r[0]]).hex(), errors[r[0]], by_label[r[2]], digest) for r in kept}


def run(spark, ws, rows, **settings):
    found = vc.compressed(spark.createDataFrame(rows, SCHEMA).repartition(4), ws, **settings)
    return {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()}


def vectors(n, length, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return [(i * 3, [float(x) for x in rng.normal(0, spread, length).astype(np.float32)], [None, 1, 1, 2][i % 4]) for i in range(n)]


@pytest.mark.parametrize("n, length", [(300, 64), (40, 32), (200, 16)])
def test_equals_plain_k_means(spark, llm_ws, n, length):
    rows = vectors(n, length, n)
    assert run(spark, llm_ws, rows) == plain(rows)


def test_ties_and_repeated_vectors(spark, llm_ws):
    """Few values, so that many entries are equal and many distances tie."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) / 64 for x in rng.integers(-2, 3, 32)], 1) for i in range(250)] + [(1000 + i, [0.25] * 32, 2) for i in range(120)]
    assert run(spark, llm_ws, rows) == plain(rows)


def test_candidates_hold_the_nearest_and_leave_most_out():
    rng = np.random.default_rng(2)
    entries, parts = rng.integers(-200, 200, (64, 4)), rng.integers(-250, 250, (5000, 4))
    book = vc.Codebook(entries)
    distances = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    entry, best = book.nearest(parts)
    assert np.array_equal(entry, distances.argmin(axis=1)) and np.array_equal(best, distances.min(axis=1))
    radius = book.radius(parts)
    assert (radius >= best).all()
    sets = book.candidates(parts, radius)
    inside = (np.abs(parts[:, None, :] - entries[None]) <= np.sqrt(radius)[:, None, None]).all(axis=2)
    bits = (sets[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert (bits.astype(bool) >= inside).all()
    assert np.bitwise_count(sets).mean() < 16  # of 64 entries


def test_odd_rows(spark, llm_ws):
    good = vectors(70, 16, 9)
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [nan] * 16, 1), (4, [inf] + [0.0] * 15, 1), (5, [None] + [0.0] * 15, 1)]
    assert run(spark, llm_ws, good + odd) == plain(good)
    # A missing id comes last, another length has no code, a repeated row counts twice.
    more = run(spark, llm_ws, [*good, (None, [0.5] * 16, None), (7, [0.5] * 3, 1), (8, [], 1)])
    assert len(more) == 73 and {(r[0], r[1], r[2]) for r in more if r[1] is None} == {(7, None, None), (8, None, None)}
    table = spark.createDataFrame([*good, good[5]], SCHEMA).withColumns({c: F.lit(1) for c in ("code", "error", "vector", "_label", "_n", "part", "entry")})
    assert vc.compressed(table, llm_ws).count() == 71
    assert run(spark, llm_ws, []) == set() and run(spark, llm_ws, odd) == set()
    assert {r[1:3] for r in run(spark, llm_ws, [(1, [], 1), (2, [], 2)])} == {("", 0)}
    # Values beyond what sums can hold are held at the bound.
    assert all(r[2] >= 0 for r in run(spark, llm_ws, [(i, [3e38 * (-1) ** i, 1.0] * 8, 1) for i in range(80)]))
    with pytest.raises(ValueError):
        vc.compressed(table, llm_ws, entries=65)


def test_lengths_that_parts_do_not_divide(spark, llm_ws):
    rows = vectors(90, 21, 3)
    assert run(spark, llm_ws, rows) == plain(rows)


def test_label_errors_with_hot_labels(spark):
    rows = [(i, None if i % 3 == 0 else (7 if i % 3 == 1 else i), 1) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, error long")
    found = {r.vec_id: r.label_error for r in vc.with_label_error(frame).collect()}
    assert found == {i: 300 if i % 3 < 2 else 1 for i in range(900)}
    assert vc.with_label_error(frame.withColumn("label", F.lit(None).cast("int"))).select("label_error").distinct().collect()[0][0] == 900


def test_integers_floor_down():
    got = vc.integers(pa.array([[-0.001, 0.001, 0.5, -1.0]], pa.list_(pa.float64())))
    assert got.tolist() == [[-1, 0, 128, -256]]
