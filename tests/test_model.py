"""Model operators against plain numpy on small inputs."""

import glob
import math

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from terrane.operators import clusters, neighbours, nmf, tsne

COORDS = ["w0", "w1", "w2"]


def point_table(spark, values):
    rows = [(i, *map(float, row)) for i, row in enumerate(values)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COORDS[: values.shape[1]]))


def brute_neighbours(values, k):
    d2 = ((values[:, None, :] - values[None, :, :]) ** 2).sum(axis=2)
    found = {}
    for i, row in enumerate(d2):
        order = sorted((d, j) for j, d in enumerate(row) if j != i)
        found[i] = [j for _, j in order[:k]]
    return found


def grouped(df):
    found = {}
    for r in df.orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["other"])
    return found


@pytest.mark.parametrize("chunk_points", [8, 64, 1000])
def test_neighbours_equal_brute_force(spark, ws, chunk_points):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=(90, 3)), rng.normal(size=(60, 3)) * 0.01, rng.normal(size=(10, 3)) * 50])
    df = neighbours.nearest_neighbours(point_table(spark, values), COORDS, 7, ws, chunk_points)
    assert grouped(df) == brute_neighbours(values, 7)


def test_neighbours_on_a_lattice_break_ties_by_id(spark, ws):
    values = np.array([(x, y) for x in range(9) for y in range(9)], dtype=float)
    df = neighbours.nearest_neighbours(point_table(spark, values), COORDS[:2], 5, ws, 16)
    assert grouped(df) == brute_neighbours(values, 5)


def test_neighbours_with_a_third_of_equal_points(spark, ws):
    rng = np.random.default_rng(4)
    values = np.round(np.concatenate([np.full((30, 2), 0.5), rng.random(size=(60, 2))]), 6)
    df = neighbours.nearest_neighbours(point_table(spark, values), COORDS[:2], 4, ws, 8)
    assert grouped(df) == brute_neighbours(values, 4)
    kept = neighbours.distinct_points(point_table(spark, values), COORDS[:2])
    assert sorted(r["id"] for r in kept.collect()) == [0, *range(30, 90)]


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e7])
def test_neighbours_do_not_depend_on_the_unit(spark, ws, scale):
    values = np.random.default_rng(11).normal(size=(60, 3)) * scale
    df = neighbours.nearest_neighbours(point_table(spark, values), COORDS, 5, ws, 8)
    assert grouped(df) == brute_neighbours(values, 5)


def test_visits_stay_flat_when_points_grow(spark, ws):
    """Chunks visited by a point, for ten times the points, and with an upper tree that is too small for them."""
    per_point = []
    for n in (400, 4000):
        values = np.random.default_rng(n).uniform(size=(n, 2))
        own_ws = ws.child(str(n))
        points = point_table(spark, values)
        found = neighbours.nearest_neighbours(points, COORDS[:2], 4, own_ws, 16)
        assert found.count() == 4 * n
        saved = glob.glob(f"{own_ws.root.removeprefix('file:')}/neighbours-*/visits")
        per_point.append(spark.read.parquet(saved[0]).count() / n)
    assert per_point[1] < 2 * per_point[0] + 1


def test_small_leaves_are_joined():
    counts = np.array([3, 40, 0, 0, 50, 60, 9, 30])
    stands_for = neighbours._merged(counts, 4)
    sizes = {leaf: counts[stands_for == leaf].sum() for leaf in set(stands_for.tolist())}
    assert min(sizes.values()) > 4 and sum(sizes.values()) == counts.sum()
    assert stands_for[4] == 4 and stands_for[5] == 5


def test_neighbours_of_fewer_points_than_asked(spark, ws):
    values = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0]])
    df = neighbours.nearest_neighbours(point_table(spark, values), COORDS[:2], 10, ws, 1)
    assert grouped(df) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_affinities_reach_the_perplexity(spark, ws):
    values = np.random.default_rng(5).normal(size=(60, 3)) * np.array([1.0, 30.0, 0.01])
    near = neighbours.nearest_neighbours(point_table(spark, values), COORDS, 18, ws)
    conditional = tsne.conditional_affinities(near, 6.0).collect()
    for i in range(60):
        p = np.array([r["p"] for r in conditional if r["id"] == i])
        assert math.isclose(p.sum(), 1.0, abs_tol=1e-9)
        p = p[p > 0]
        assert math.isclose(math.exp(-(p * np.log(p)).sum()), 6.0, rel_tol=1e-6)
    joint = tsne.joint_affinities(tsne.conditional_affinities(near, 6.0), 60).collect()
    cells = {(r["id"], r["other"]): r["p"] for r in joint}
    assert math.isclose(sum(cells.values()), 1.0, abs_tol=1e-9)
    assert all(math.isclose(p, cells[j, i], abs_tol=1e-15) for (i, j), p in cells.items())


@pytest.mark.parametrize("scale", [1e-4, 1.0, 30.0])
def test_grid_repulsion_is_close_to_all_pairs(spark, scale):
    xy = np.random.default_rng(6).normal(size=(80, 2)) * scale
    layout = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    width = tsne.interval_width(2 * np.abs(xy).max())
    field = tsne.Field(tsne.charges(layout, width).toPandas(), width)
    diff = xy[:, None, :] - xy[None, :, :]
    kernel = 1.0 / (1.0 + (diff**2).sum(axis=2))
    np.fill_diagonal(kernel, 0.0)
    expected = (kernel[:, :, None] ** 2 * diff).sum(axis=1) / kernel.sum()
    assert math.isclose(field.normaliser, kernel.sum(), rel_tol=0.02)
    assert np.allclose(field.mean, xy.mean(axis=0), atol=1e-9 + 1e-9 * scale)
    got = np.stack(tsne.repulsion(field.shared(), xy[:, 0], xy[:, 1]), axis=1)
    assert np.abs(got - expected).max() <= 0.03 * np.abs(expected).max()


def test_attraction_equals_plain_sums(spark):
    xy = np.random.default_rng(7).normal(size=(10, 2))
    edges = [(i, (i + s) % 10, 0.05) for i in range(10) for s in (1, 9)]
    layout = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    pulls = tsne.attraction(spark.createDataFrame(edges, "id long, other long, p double"), layout)
    for r in pulls.groupBy("id").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay")).collect():
        total = np.zeros(2)
        for i, j, p in edges:
            if i == r["id"]:
                d = xy[i] - xy[j]
                total += p * d / (1 + d @ d)
        assert np.allclose([r["ax"], r["ay"]], total)


def test_layout_separates_two_groups(spark, ws):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=(20, 3)), rng.normal(size=(20, 3)) + 12.0])
    points = point_table(spark, values)
    edges = tsne.joint_affinities(
        tsne.conditional_affinities(neighbours.nearest_neighbours(points, COORDS, 15, ws), 5.0), 40
    )
    before = tsne.divergence(edges, tsne.start_layout(points, COORDS))
    layout = tsne.embed(points, COORDS, 5.0, 30, ws)
    assert tsne.divergence(edges, layout) < before / 2
    xy = {r["id"]: np.array([r["x"], r["y"]]) for r in layout.collect()}
    assert len(xy) == 40
    for i in range(40):
        nearest = min((j for j in range(40) if j != i), key=lambda j: ((xy[i] - xy[j]) ** 2).sum())
        assert (nearest < 20) == (i < 20)


def test_factorisation_equals_numpy_and_never_gets_worse(spark, ws):
    rng = np.random.default_rng(9)
    v = rng.random((8, 12)) * (rng.random((8, 12)) > 0.4)
    v[:, 0] += 0.1
    v[0, :] += 0.1
    cells = spark.createDataFrame(
        [(i, f"f{j}", float(v[i, j])) for i in range(8) for j in range(12) if v[i, j] > 0],
        "geo int, label string, value double",
    )
    got = nmf.factorise(cells, "geo", "label", 3, 4, 2, ws, trace=True)
    start_w = nmf.initial_factor(cells, "geo", 3).toPandas().sort_values("geo").iloc[:, 1:].to_numpy()
    columns = [f"f{j}" for j in range(12)]
    start_h = nmf.initial_factor(cells, "label", 3).toPandas().set_index("label").loc[columns].to_numpy()
    w, h = start_w, start_h
    losses = [((v - w @ h.T) ** 2).sum()]
    for _ in range(4):
        for _ in range(2):
            w = w * (v @ h) / (w @ (h.T @ h) + 1e-12)
        for _ in range(2):
            h = h * (v.T @ w) / (h @ (w.T @ w) + 1e-12)
        losses.append(((v - w @ h.T) ** 2).sum())
    assert np.allclose(got.losses, losses, rtol=1e-9)
    assert all(a >= b - 1e-12 for a, b in zip(got.losses, got.losses[1:]))
    assert np.allclose(got.w.toPandas().sort_values("geo").iloc[:, 1:].to_numpy(), w)
    assert np.allclose(got.h.toPandas().set_index("label").loc[columns].to_numpy(), h)
    assert (w >= 0).all() and (h >= 0).all()


def plain_metrics(values, labels):
    segments = sorted(set(labels))
    centres = {s: values[labels == s].mean(axis=0) for s in segments}
    within = sum(((values[labels == s] - centres[s]) ** 2).sum() for s in segments)
    total = ((values - values.mean(axis=0)) ** 2).sum()
    spread = {s: np.sqrt(((values[labels == s] - centres[s]) ** 2).sum(axis=1)).mean() for s in segments}
    worst = [
        max((spread[s] + spread[t]) / np.linalg.norm(centres[s] - centres[t]) for t in segments if t != s)
        for s in segments
    ]
    n, k = len(values), len(segments)
    return within, total - within, ((total - within) / (k - 1)) / (within / (n - k)), float(np.mean(worst))


def test_metrics_equal_numpy_and_the_built_in_silhouette(spark):
    rng = np.random.default_rng(10)
    values = np.concatenate([rng.normal(size=(15, 3)), rng.normal(size=(20, 3)) + 4, [[20.0, 0.0, 0.0]]])
    values[np.abs(values) < 0.3] = 0.0
    labels = np.array([0] * 15 + [1] * 20 + [2])
    points = point_table(spark, values)
    cells = clusters.long_form(points, COORDS).where(F.col("value") != 0)  # absent cells are zeros
    runs = spark.createDataFrame(
        [(1, i, int(s)) for i, s in enumerate(labels)] + [(2, i, int(i % 2)) for i in range(36)],
        "run int, id long, segment int",
    )
    for run, tags in ((1, labels), (2, np.arange(36) % 2)):
        row = clusters.cluster_metrics(cells, runs).where(F.col("run") == run).first()
        expected = plain_metrics(values, tags)
        names = ("within_cost", "between_cost", "calinski_harabasz", "davies_bouldin")
        assert np.allclose([row[c] for c in names], expected)
        assert (row["points"], row["segments"]) == (36, len(set(tags)))
        vectors = VectorAssembler(inputCols=COORDS, outputCol="features").transform(points)
        tagged = vectors.join(runs.where(F.col("run") == run), "id")
        built_in = ClusteringEvaluator(predictionCol="segment", featuresCol="features").evaluate(tagged)
        assert math.isclose(row["silhouette"], built_in, rel_tol=1e-9)


def test_adjusted_rand(spark):
    base = spark.createDataFrame([(i, s) for i, s in enumerate([0, 0, 1, 1])], "id long, segment int")
    runs = spark.createDataFrame(
        [(1, i, s) for i, s in enumerate([5, 5, 3, 3])]
        + [(2, i, s) for i, s in enumerate([0, 0, 1, 2])]
        + [(3, i, s) for i, s in enumerate([0, 1, 0, 1])],
        "run int, id long, segment int",
    )
    found = {r["run"]: r["adjusted_rand"] for r in clusters.adjusted_rand(runs, base).collect()}
    assert math.isclose(found[1], 1.0) and math.isclose(found[2], 4 / 7) and math.isclose(found[3], -0.5)


def test_sweeps_are_one_cheap_expression(spark):
    """Built in few calls whatever the number of sweeps, and the same numbers as by hand."""
    gram = [[2.0, 0.5], [0.5, 1e-20]]
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (0.0, 5.0, -1.0, 2.0)], "a double, b double, n double, m double")
    calls = []
    whole = spark.sparkContext._gateway._gateway_client.send_command
    spark.sparkContext._gateway._gateway_client.send_command = lambda *a, **k: calls.append(a) or whole(*a, **k)
    try:
        made = nmf.swept("array(a, b)", "array(n, m)", gram, 3)
    finally:
        spark.sparkContext._gateway._gateway_client.send_command = whole
    assert len(calls) < 20
    want = []
    for r in rows.collect():
        w, n = [r.a, r.b], [r.n, r.m]
        for _ in range(3):
            for c in range(2):
                own = gram[c][c]
                w[c] = max(w[c] + (n[c] - sum(gram[c][d] * w[d] for d in range(2))) / own, 0.0) if own > nmf.EPSILON else 0.0
        want.append(w)
    assert [list(r.w) for r in rows.select(made.alias("w")).collect()] == want
