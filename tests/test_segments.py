"""Whole fits, choice and numbering of segments, new regions, and mergeable counts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import bitmaps, kmeans, matching, nmf


def cells_of(spark, v):
    rows = [(i, f"f{j}", float(v[i, j])) for i in range(v.shape[0]) for j in range(v.shape[1]) if v[i, j] > 0]
    return spark.createDataFrame(rows, "geo int, label string, value double")


def plain_sweeps(w, numerators, gram, sweeps):
    w = w.copy()
    for _ in range(sweeps):
        for c in range(w.shape[1]):
            w[:, c] = np.maximum(0, w[:, c] + (numerators[:, c] - w @ gram[c]) / gram[c, c])
    return w


@pytest.fixture()
def matrix():
    rng = np.random.default_rng(21)
    v = rng.random((12, 3)) @ rng.random((3, 20)) + 0.05 * rng.random((12, 20))
    v[v < 0.3] = 0
    return v


def test_settled_fit_equals_numpy(spark, ws, matrix):
    cells = cells_of(spark, matrix)
    columns = [f"f{j}" for j in range(matrix.shape[1])]
    w = nmf.initial_factor(cells, "geo", 3).toPandas().sort_values("geo").iloc[:, 1:].to_numpy()
    h = nmf.initial_factor(cells, "label", 3).toPandas().set_index("label").reindex(columns).fillna(0).to_numpy()
    losses = []
    while len(losses) < 2 or losses[-2] - losses[-1] > 1e-4 * losses[-1]:
        w = plain_sweeps(w, matrix @ h, h.T @ h, 5)
        h = plain_sweeps(h, matrix.T @ w, w.T @ w, 5)
        losses.append(((matrix - w @ h.T) ** 2).sum())
    got = nmf.settled(cells, "geo", "label", 3, 200, 5, ws, 1e-4)
    assert np.allclose(got.losses, losses, rtol=1e-8)
    assert np.allclose(got.w.toPandas().sort_values("geo").iloc[:, 1:].to_numpy(), w)
    with pytest.raises(RuntimeError):
        nmf.settled(cells, "geo", "label", 3, 2, 1, ws, 1e-9)


def test_rows_folded_in_are_least_squares_on_the_fixed_features(spark, ws, matrix):
    cells = cells_of(spark, matrix)
    columns = [f"f{j}" for j in range(matrix.shape[1])]
    h = ws.save(nmf.initial_factor(cells, "label", 3), "h")
    own = h.toPandas().set_index("label").reindex(columns).fillna(0).to_numpy()
    expected = plain_sweeps(np.zeros((12, 3)), matrix @ own, own.T @ own, 3000)
    got = nmf.folded_in(cells, h, "geo", "label", 3).toPandas().sort_values("geo").iloc[:, 1:].to_numpy()
    assert np.abs(got - expected).max() < 1e-6 * expected.max()
    unknown = spark.createDataFrame([(99, "never seen", 0.5)], "geo int, label string, value double")
    assert nmf.folded_in(unknown, h, "geo", "label", 3).first()[1:] == (0.0, 0.0, 0.0)


def blobs(spark, centres, n=30, spread=0.3, seed=5):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(c, spread, (n, 2)) for c in centres])
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double"), xy


def test_fits_side_by_side_reach_plain_fixed_points(spark, ws):
    points, xy = blobs(spark, [(0, 0), (5, 1), (2, 6)])
    stored = ws.save(kmeans.as_points(points, ("x", "y")), "points")
    fits = [kmeans.Fit(0, 1, 3, 1), kmeans.Fit(0, 2, 3, 2), kmeans.Fit(0, 3, 5, 1), kmeans.Fit(0, 4, 1, 1)]
    start = kmeans.start_centres(stored, fits)
    centres, costs = kmeans.settled_centres(stored, fits)
    rows = kmeans.labelled(stored, fits, centres).collect()
    assert kmeans.start_centres(stored.repartition(5), fits) == start
    for f in fits:
        assert len({tuple(c) for c in start[0, f.run]}) == f.k
        plain = np.array(start[0, f.run])
        for _ in range(100):
            tags = ((xy[:, None] - plain[None]) ** 2).sum(axis=2).argmin(axis=1)
            plain = np.array([xy[tags == s].mean(axis=0) if (tags == s).any() else plain[s] for s in range(f.k)])
        assert np.allclose(plain, centres[0, f.run])
        assert [r.segment for r in sorted((r for r in rows if r.run == f.run), key=lambda r: r.id)] == tags.tolist()
        assert math.isclose(costs[0, f.run], ((xy - plain[tags]) ** 2).sum(), rel_tol=1e-9)


def test_kmeans_with_too_few_points(spark, ws):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0)], "id long, x double, y double")
    stored = ws.save(kmeans.as_points(points, ("x", "y")), "points")
    centres, costs = kmeans.settled_centres(stored, [kmeans.Fit(0, 0, 4, 1)])
    assert sorted(centres[0, 0]) == [[0.0, 0.0], [1.0, 1.0]] and costs[0, 0] == 0
    assert kmeans.settled_centres(stored.limit(0), [kmeans.Fit(0, 0, 4, 1)])[0] == {(0, 0): []}


@pytest.mark.parametrize("centres, k", [([(0, 0)], 1), ([(0, 0), (6, 0), (3, 5)], 3)])
def test_gap_finds_the_number_of_blobs(spark, ws, centres, k):
    points, _ = blobs(spark, centres, n=40)
    rows = kmeans.gap_statistic(points, ("x", "y"), range(1, 6), 8, 1, ws).orderBy("k").collect()
    assert [r.k for r in rows if r.chosen] == [k]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_assignment_is_the_best_of_all(n):
    random.seed(n)
    for _ in range(20):
        gain = [[random.randint(0, 9) for _ in range(n)] for _ in range(n)]
        got = matching.best_assignment(gain)
        assert sorted(got) == list(range(n))
        best = max(sum(gain[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(gain[i][got[i]] for i in range(n)) == best


def labels_of(spark, values):
    return spark.createDataFrame(list(values.items()), "geo int, segment int")


def as_dict(df):
    return {r.geo: r.segment for r in df.collect()}


def test_segments_keep_their_numbers(spark):
    old = {g: g % 4 for g in range(40)}
    renamed = {g: (s * 3 + 1) % 4 for g, s in old.items()}
    assert as_dict(matching.renumbered(labels_of(spark, renamed), labels_of(spark, old))) == old
    moved = {**renamed, 7: renamed[8]}
    assert as_dict(matching.renumbered(labels_of(spark, moved), labels_of(spark, old))) == {**old, 7: old[8]}
    split = {g: 9 if g % 8 == 0 else s for g, s in renamed.items()}
    found = as_dict(matching.renumbered(labels_of(spark, split), labels_of(spark, old)))
    assert {found[g] for g in range(40) if g % 8 == 0} - set(old.values()) == {4} or {found[g] for g in range(40) if g % 8 == 4} == {4}
    fewer = {g: min(s, 2) for g, s in renamed.items()}
    assert set(as_dict(matching.renumbered(labels_of(spark, fewer), labels_of(spark, old))).values()) < set(old.values())
    assert matching.renumbered(labels_of(spark, old), None).count() == 40
    nulls = spark.createDataFrame([(1, None), (2, 5)], "geo int, segment int")
    assert as_dict(matching.renumbered(nulls, labels_of(spark, {2: 3}))) == {1: None, 2: 3}


def test_history_changes_by_what_moved(spark):
    first = matching.with_history(labels_of(spark, {1: 0, 2: 1, 3: 1}), None, "2024-01-01")
    assert matching.with_history(labels_of(spark, {1: 0, 2: 1, 3: 1}), first, "2024-02-01").exceptAll(first).isEmpty()
    second = matching.with_history(labels_of(spark, {1: 0, 2: 0, 4: 1}), first, "2024-02-01")
    rows = {(r.geo, r.segment, str(r.valid_from), str(r.valid_to)) for r in second.collect()}
    assert rows == {
        (1, 0, "2024-01-01", "None"), (2, 1, "2024-01-01", "2024-02-01"), (2, 0, "2024-02-01", "None"),
        (3, 1, "2024-01-01", "2024-02-01"), (4, 1, "2024-02-01", "None"),
    }


def test_bitmaps_merge_to_direct_counts(spark):
    random.seed(3)
    rows = [(random.randrange(5), random.choice(("a", "b", None)), random.choice((None, random.randrange(100_000)))) for _ in range(3000)] + [(9, "c", None)]
    df = spark.createDataFrame(rows, "day int, kind string, who long")
    bits = bitmaps.distinct_bits(df, ["day", "kind"], "who")
    for keys in (["day", "kind"], ["kind"], ["day"]):
        direct = {tuple(r) for r in df.groupBy(*keys).agg(F.count_distinct("who").alias("n")).collect()}
        assert {tuple(r) for r in bitmaps.rolled_up(bits, keys, "n").collect()} == direct
