"""t-SNE to two dimensions (van der Maaten & Hinton, 2008) as rounds of DataFrame jobs.

Attraction runs over the edges of a nearest-neighbour graph. Repulsion is interpolated from
a grid (Linderman et al., 2019): the points spread charges onto grid nodes by a group-by, the
nodes are convolved with the kernel, and each point reads its force back from the nodes near
it. The grid is bounded whatever the number of points, and no pairs of points are formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrane.operators.neighbours import nearest_neighbours
from terrane.session import Workspace

NODES = 3  # interpolation nodes per interval and dimension
FINE_INTERVALS = 64  # intervals across a layout, where that keeps them within these widths
FINE_WIDTH, COARSE_WIDTH = 1 / 8, 1 / 2  # forces within 1 % of the exact ones
MAX_INTERVALS = 512  # intervals across a very large layout: bounds the grid at (3 * 512)^2 nodes
SEARCH_STEPS = 100
EXAGGERATION = 4.0  # of the attraction, in the first quarter of the rounds
POINTS_PER_RATE = 12.0  # the learning rate grows with the number of points
START_SPREAD = 1e-4
MIN_GAIN = 0.01


def conditional_affinities(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """Gaussian weights of each point's neighbours at the given perplexity: id, other, p (sums to 1 per id).

    A point's neighbours are one bounded array; the bandwidth of many points is searched at once.
    """
    target = math.log(perplexity)
    rows = neighbours.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "other", "distance"))).alias("found")
    )
    packed = rows.select("id", F.col("found.other").alias("other"), F.col("found.distance").alias("distance"))

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            width = batch["distance"].map(len).max()
            d2 = np.full((len(batch), width), np.inf)
            for row, found in enumerate(batch["distance"]):
                d2[row, : len(found)] = np.square(found)
            d2 -= d2.min(axis=1, keepdims=True)
            finite = np.isfinite(d2)
            filled = np.where(finite, d2, 0.0)
            scale = np.maximum(filled.mean(axis=1), 1e-300)
            low, high = np.full(len(batch), -60.0), np.full(len(batch), 60.0)
            for _ in range(SEARCH_STEPS):
                middle = (low + high) / 2.0
                beta = np.exp(middle) / scale
                e = np.where(finite, np.exp(-filled * beta[:, None]), 0.0)
                total = e.sum(axis=1)
                entropy = np.log(total) + beta * (filled * e).sum(axis=1) / total
                flat = entropy > target
                low, high = np.where(flat, middle, low), np.where(flat, high, middle)
            p = e / total[:, None]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "other": batch["other"],
                    "p": [p[row, : len(found)] for row, found in enumerate(batch["distance"])],
                }
            )

    searched = packed.mapInPandas(weights, "id long, other array<long>, p array<double>")
    pairs = searched.select("id", F.explode(F.arrays_zip("other", "p")).alias("pair"))
    return pairs.select("id", "pair.other", "pair.p")


def joint_affinities(conditional: DataFrame, points: int) -> DataFrame:
    """Symmetric affinities over both directions of every edge; they sum to 1."""
    both = conditional.select(
        F.explode(
            F.array(
                F.struct(F.col("id"), F.col("other"), F.col("p")),
                F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.col("p")),
            )
        ).alias("edge")
    ).select("edge.*")
    return both.groupBy("id", "other").agg((F.sum("p") / F.lit(2.0 * points)).alias("p"))


def start_layout(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """First two principal components, scaled to a small spread, with speed 0 and gain 1."""
    assembled = VectorAssembler(inputCols=list(coords), outputCol="v").transform(points)
    model = PCA(k=min(2, len(coords)), inputCol="v", outputCol="pc").fit(assembled)
    projected = model.transform(assembled).select("id", vector_to_array("pc").alias("pc"))
    second = F.col("pc")[1] if len(coords) > 1 else F.lit(0.0)
    flat = projected.select("id", F.col("pc")[0].alias("x"), second.alias("y"))
    stats = flat.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx")).first()
    factor = START_SPREAD / stats["sx"] if stats["sx"] else 1.0
    zero, one = F.lit(0.0), F.lit(1.0)
    return flat.select(
        "id",
        ((F.col("x") - stats["mx"]) * factor).alias("x"),
        ((F.col("y") - stats["my"]) * factor).alias("y"),
        zero.alias("vx"),
        zero.alias("vy"),
        one.alias("gx"),
        one.alias("gy"),
    )


def interval_width(span: float) -> float:
    """A power of two. The kernel varies on a scale of 1, so finer than FINE_WIDTH is of no use."""
    fine = max(span / FINE_INTERVALS, FINE_WIDTH)
    full = max(span / MAX_INTERVALS, FINE_WIDTH)
    return max(min(_power_of_two(fine), COARSE_WIDTH), _power_of_two(full))


def _power_of_two(value: float) -> float:
    return 2.0 ** math.ceil(math.log2(value))


def _transform_size(least: int) -> int:
    """A size with small prime factors only, at least `least`."""
    return int(min(_power_of_two(least), 3 * _power_of_two(least / 3)))


def _lagrange(t: np.ndarray) -> np.ndarray:
    """Quadratic weights of the nodes 0.5, 1.5, 2.5 at offsets t in [0, 3)."""
    return np.stack([(t - 1.5) * (t - 2.5) / 2, -(t - 0.5) * (t - 2.5), (t - 0.5) * (t - 1.5) / 2])


def charges(layout: DataFrame, width: float) -> DataFrame:
    """Charges (1, x, y) spread over the grid nodes: nx, ny, c, cx, cy.

    The grid is fixed at the origin, so no pass over the layout is needed to place it. Every
    task combines its points first; the result has at most one row per node in use.
    """
    step = width / NODES

    def axis(column: str) -> str:
        """Array of the three nodes (number n, weight w) near a coordinate."""
        first = f"floor({column} / {width!r}D) * {NODES}"
        t = f"({column} / {step!r}D - {first})"
        weights = (
            f"({t} - 1.5D) * ({t} - 2.5D) / 2D",
            f"({t} - 0.5D) * (2.5D - {t})",
            f"({t} - 0.5D) * ({t} - 1.5D) / 2D",
        )
        return ", ".join(f"named_struct('n', {first} + {k}, 'w', {w})" for k, w in enumerate(weights))

    spread = (
        layout.selectExpr("x", "y", f"array({axis('y')}) AS by", f"inline(array({axis('x')})) AS (nx, wx)")
        .selectExpr("x", "y", "nx", "wx", "inline(by) AS (ny, wy)")
        .selectExpr("x", "y", "nx", "ny", "wx * wy AS w")
    )
    return spread.groupBy("nx", "ny").agg(
        F.expr("sum(w) AS c"), F.expr("sum(w * x) AS cx"), F.expr("sum(w * y) AS cy")
    )


Shared = tuple[np.ndarray, tuple[int, int], float, float, tuple[float, float]]


class Field:
    """Repulsion potentials on the grid nodes."""

    def __init__(self, nodes: pd.DataFrame, width: float):
        self.step = width / NODES
        nx, ny = nodes["nx"].to_numpy(), nodes["ny"].to_numpy()
        self.origin = (int(nx.min()), int(ny.min()))
        shape = (int(nx.max()) - self.origin[0] + 1, int(ny.max()) - self.origin[1] + 1)
        grid = np.zeros((3, *shape))
        grid[:, nx - self.origin[0], ny - self.origin[1]] = nodes[["c", "cx", "cy"]].to_numpy().T
        double = tuple(_transform_size(2 * side) for side in shape)
        dx = np.fft.fftfreq(double[0], 1.0 / double[0]) * self.step
        dy = np.fft.fftfreq(double[1], 1.0 / double[1]) * self.step
        kernel = 1.0 / (1.0 + dx[:, None] ** 2 + dy[None, :] ** 2)
        spectra = np.fft.rfft2(grid, double)

        def convolved(values: np.ndarray, spectrum: np.ndarray) -> np.ndarray:
            return np.fft.irfft2(spectrum * np.fft.rfft2(values), double)[..., : shape[0], : shape[1]]

        self.points = float(nodes["c"].sum())
        self.mean = (float(nodes["cx"].sum() / self.points), float(nodes["cy"].sum() / self.points))
        # Sum of the kernel over all ordered pairs; a point with itself gives 1.
        self.normaliser = float((grid[0] * convolved(kernel, spectra[0])).sum()) - self.points
        self.potentials = convolved(kernel**2, spectra)

    def shared(self) -> Shared:
        """Plain data for the workers."""
        return self.potentials, self.origin, self.step, self.normaliser, self.mean


def repulsion(field: Shared, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all points of squared kernel times difference, divided by the normaliser."""
    potentials, origin, step, normaliser, _ = field
    weights, columns = [], []
    for values, start in ((x, origin[0]), (y, origin[1])):
        first = np.floor(values / (step * NODES)).astype(np.int64) * NODES
        weights.append(_lagrange(values / step - first))
        columns.append(first - start)
    total = np.zeros((3, len(x)))
    for a in range(NODES):
        for b in range(NODES):
            total += weights[0][a] * weights[1][b] * potentials[:, columns[0] + a, columns[1] + b]
    return (x * total[0] - total[1]) / normaliser, (y * total[0] - total[2]) / normaliser


def attraction(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Pull of each neighbour on each point, one row per edge: id, ax, ay.

    The layout is a stored table, so Catalyst broadcasts it below the threshold and shuffles
    it above.
    """
    here = layout.select("id", "x", "y")
    there = layout.selectExpr("id AS other", "x AS ox", "y AS oy")
    pull = "p / (1D + (x - ox) * (x - ox) + (y - oy) * (y - oy))"
    return edges.join(here, "id").join(there, "other").selectExpr(
        "id", f"{pull} * (x - ox) AS ax", f"{pull} * (y - oy) AS ay"
    )


STATE = "id long, x double, y double, vx double, vy double, gx double, gy double"


def _moved(
    layout: DataFrame, edges: DataFrame, shared: Broadcast[Shared], exaggeration: float, momentum: float, rate: float
) -> DataFrame:
    """One gradient step with momentum and per-coordinate gains."""
    # One group-by sums the pulls of a point, map-side first, and carries its state: no further join.
    state = ("x", "y", "vx", "vy", "gx", "gy")
    pulls = attraction(edges, layout).selectExpr("id", "ax", "ay", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in state])
    carried = layout.selectExpr("id", "0D AS ax", "0D AS ay", *state)
    totals = ["sum(ax) AS ax", "sum(ay) AS ay", *[f"max({c}) AS {c}" for c in state]]
    pulled = pulls.unionAll(carried).groupBy("id").agg(*[F.expr(text) for text in totals])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean_x, mean_y = shared.value[4]
        for b in batches:
            rx, ry = repulsion(shared.value, b["x"].to_numpy(), b["y"].to_numpy())
            moved = {"id": b["id"]}
            for at, speed, gain, pull, push, mean in (
                ("x", "vx", "gx", "ax", rx, mean_x),
                ("y", "vy", "gy", "ay", ry, mean_y),
            ):
                gradient = 4.0 * (exaggeration * b[pull].to_numpy() - push)
                velocity = b[speed].to_numpy()
                same = np.sign(gradient) == np.sign(velocity)
                gains = np.maximum(np.where(same, b[gain] * 0.8, b[gain] + 0.2), MIN_GAIN)
                velocity = momentum * velocity - rate * gains * gradient
                moved[at], moved[speed], moved[gain] = b[at].to_numpy() - mean + velocity, velocity, gains
            yield pd.DataFrame(moved)[["id", "x", "y", "vx", "vy", "gx", "gy"]]

    return pulled.mapInPandas(step, STATE)


def embed(
    points: DataFrame,
    coords: Sequence[str],
    perplexity: float,
    rounds: int,
    ws: Workspace,
    tolerance: float | None = None,
    early: int | None = None,
) -> DataFrame:
    """Two-dimensional layout of distinct points: id, x, y.

    The first `early` rounds (a quarter unless given) exaggerate the attraction. With a
    `tolerance`, a run stops when the points move by less than that share of the layout's span
    on average; `rounds` is then a safety net, and reaching it is an error. Each round is two
    jobs: one reads the charged grid nodes to the driver (a bounded grid), one moves the points
    and writes them. Too few points for the perplexity are an error.
    """
    ws = ws.child("layout")
    points = ws.save(points, "points")
    count = points.count()
    if count < 3 * perplexity + 1:
        raise ValueError(f"{count} distinct points are too few for a perplexity of {perplexity}")
    layout = start_layout(points, coords)
    neighbours = nearest_neighbours(points, coords, math.ceil(3 * perplexity), ws)
    edges = ws.save(joint_affinities(conditional_affinities(neighbours, perplexity), count), "edges")
    layout, span, _ = _saved_with_span(layout, "layout0", ws)
    rate = max(count / POINTS_PER_RATE, 1.0)
    early = rounds // 4 if early is None else early
    for number in range(1, rounds + 1):
        width = interval_width(span)
        field = Field(charges(layout, width).toPandas(), width)
        shared = layout.sparkSession.sparkContext.broadcast(field.shared())
        exaggeration, momentum = (EXAGGERATION, 0.5) if number <= early else (1.0, 0.9)
        moved = _moved(layout, edges, shared, exaggeration, momentum, rate)
        layout, span, speed = _saved_with_span(moved, f"layout{number}", ws)
        shared.destroy()
        ws.drop(f"layout{number - 1}")
        if tolerance is not None and number > early and speed <= tolerance * span:
            return layout.select("id", "x", "y")
    if tolerance is not None:
        raise RuntimeError(f"the layout has not settled after {rounds} rounds")
    return layout.select("id", "x", "y")


def _saved_with_span(layout: DataFrame, name: str, ws: Workspace) -> tuple[DataFrame, float, float]:
    """Write a layout and collect its extent and mean movement on the way."""
    observed = Observation()
    reach, speed = F.expr("greatest(max(abs(x)), max(abs(y)))"), F.expr("sqrt(avg(vx * vx + vy * vy))")
    stored = ws.save(layout.observe(observed, reach.alias("reach"), speed.alias("speed")), name)
    return stored, 2.0 * observed.get["reach"], observed.get["speed"]


def divergence(edges: DataFrame, layout: DataFrame, width: float | None = None) -> float:
    """Kullback-Leibler divergence of a layout, for checking runs."""
    span = layout.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    width = width or interval_width(max(span))
    normaliser = Field(charges(layout, width).toPandas(), width).normaliser
    there = layout.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    log_q = -F.log(F.lit(1.0) + dx * dx + dy * dy) - F.lit(math.log(normaliser))
    joined = edges.join(layout.select("id", "x", "y"), "id").join(there, "other")
    return joined.agg(F.sum(F.col("p") * (F.log("p") - log_q))).first()[0]
