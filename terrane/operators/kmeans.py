"""k-means as column work: several fits of several point sets at once, one job a round.

Points are rows (dataset, id, v) with v an array of coordinates. A fit is a number of segments and a seed
on one dataset. Only centres come to the driver: fits x segments rows. They go back as a small
table, so a round is one scan with a map-side combined sum per segment, whatever the number of fits.

Starts are drawn like k-means++ (Arthur & Vassilvitskii, 2007), by a race: the point with the least
-ln(u) / d2 is next, where u is a hash of its id and the seed and d2 its squared distance to the
nearest centre so far. So a start can be repeated, in SQL too, whatever the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.expressions import uniform
from terrane.session import Workspace

POINTS = "dataset int, id long, v array<double>"


class Fit(NamedTuple):
    dataset: int
    run: int
    k: int
    seed: int


Centres = dict[tuple[int, int], list[list[float]]]


def as_points(rows: DataFrame, coords: Sequence[str], dataset: int = 0) -> DataFrame:
    """Coordinates in columns to points of one dataset."""
    v = F.array(*[F.col(c).cast("double") for c in coords])
    return rows.select(F.lit(dataset).alias("dataset"), F.col("id").cast("long").alias("id"), v.alias("v"))


def squared_distances(centres: Column, v: Column) -> Column:
    """The squared distance of a point to each of an array of centres."""
    return F.transform(centres, lambda c: F.aggregate(F.zip_with(c, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x))


def _with_centres(points: DataFrame, fits: Sequence[Fit], centres: Centres) -> DataFrame:
    rows = [(f.dataset, f.run, f.seed, centres[f.dataset, f.run]) for f in fits]
    table = points.sparkSession.createDataFrame(rows, "dataset int, run int, seed int, c array<array<double>>")
    # As many rows as fits, each of k centres: bounded by the settings.
    return points.join(F.broadcast(table), "dataset")


def start_centres(points: DataFrame, fits: Sequence[Fit]) -> Centres:
    """The drawn start of every fit; with fewer distinct points than segments, one centre for each of them."""
    centres: Centres = {(f.dataset, f.run): [] for f in fits}
    open_fits = list(fits)
    for drawn in range(max((f.k for f in fits), default=0)):
        open_fits = [f for f in open_fits if f.k > drawn]
        paired = _with_centres(points, open_fits, centres)
        d2 = F.when(F.size("c") == 0, F.lit(1.0)).otherwise(F.array_min(squared_distances(F.col("c"), F.col("v"))))
        race = -F.log(uniform(F.col("id"), F.col("seed") * 1000 + drawn)) / d2
        racing = paired.select("dataset", "run", "id", "v", race.alias("race"), d2.alias("d2")).where("d2 > 0")
        first = racing.groupBy("dataset", "run").agg(F.min_by("v", F.struct("race", "id")).alias("v")).collect()
        for r in first:
            centres[r["dataset"], r["run"]].append(list(r["v"]))
        found = {(r["dataset"], r["run"]) for r in first}
        open_fits = [f for f in open_fits if (f.dataset, f.run) in found]
    return centres


def labelled(points: DataFrame, fits: Sequence[Fit], centres: Centres) -> DataFrame:
    """(dataset, run, id, v, segment, d2): every point's nearest centre in each fit, the first of equal ones."""
    fits = [f for f in fits if centres[f.dataset, f.run]]
    paired = _with_centres(points, fits, centres).withColumn("_d2", squared_distances(F.col("c"), F.col("v")))
    least = F.array_min("_d2")
    return paired.select("dataset", "run", "id", "v", (F.array_position("_d2", least) - 1).cast("int").alias("segment"), least.alias("d2"))


def moved_centres(points: DataFrame, fits: Sequence[Fit], centres: Centres) -> tuple[Centres, float, dict[tuple[int, int], float]]:
    """Centres at the mean of their points, the largest squared move, and each fit's cost before the move. A centre without points stays."""
    width = max((len(c) for own in centres.values() for c in own), default=0)
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]
    rows = labelled(points, fits, centres).groupBy("dataset", "run", "segment").agg(F.count("*").alias("n"), F.sum("d2").alias("cost"), *sums).collect()
    now = {key: [list(c) for c in own] for key, own in centres.items()}
    largest, costs = 0.0, dict.fromkeys(centres, 0.0)
    for r in rows:
        key, old = (r["dataset"], r["run"]), centres[r["dataset"], r["run"]][r["segment"]]
        new = [r[f"s{i}"] / r["n"] for i in range(width)]
        now[key][r["segment"]] = new
        largest = max(largest, sum((a - b) ** 2 for a, b in zip(new, old)))
        costs[key] += r["cost"]
    return now, largest, costs


def settled_centres(points: DataFrame, fits: Sequence[Fit], limit: int = 500, tolerance: float = 1e-6) -> tuple[Centres, dict[tuple[int, int], float]]:
    """Centres of all fits, moved until none moves by more than `tolerance`, and the costs. Reaching `limit` is an error.

    `points` is read once a round: pass a stored table. An empty dataset has no centres.
    """
    centres = start_centres(points, fits)
    for _ in range(limit):
        centres, moved, costs = moved_centres(points, fits, centres)
        if moved <= tolerance * tolerance:
            return centres, costs
    raise RuntimeError(f"the centres have not settled after {limit} rounds")


def gap_statistic(points: DataFrame, coords: Sequence[str], counts: Sequence[int], references: int, seed: int, ws: Workspace) -> DataFrame:
    """(k, cost, gap, error, chosen) per number of segments, which must follow each other (Tibshirani et al., 2001).

    `points` has an id and two columns of coordinates. Reference sets have as many points, drawn
    evenly from the box along the principal axes of the points. `chosen` marks the smallest k whose
    gap is no more than one error below the next one's; the last one if there is none.
    """
    x, y = coords
    m = points.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy")).first()
    angle = 0.5 * math.atan2(2 * m["xy"], m["xx"] - m["yy"])
    c, s = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    along, across = (F.col(x) - m["x"]) * c + (F.col(y) - m["y"]) * s, (F.col(y) - m["y"]) * c - (F.col(x) - m["x"]) * s
    box = points.agg(F.min(along).alias("a0"), F.max(along).alias("a1"), F.min(across).alias("b0"), F.max(across).alias("b1")).first()
    drawn = points.select("id", F.explode(F.sequence(F.lit(1), F.lit(references))).alias("dataset"))
    a, b = (F.lit(box[f"{n}0"]) + uniform(F.col("id"), F.col("dataset") * 2 + side + seed * 100_000) * (box[f"{n}1"] - box[f"{n}0"]) for side, n in ((0, "a"), (1, "b")))
    drawn = drawn.select(F.col("dataset").cast("int"), "id", F.array(m["x"] + a * c - b * s, m["y"] + a * s + b * c).alias("v"))
    every = ws.child("gap").save(as_points(points, coords).unionByName(drawn), "points")
    counts = list(counts)
    fits = [Fit(d, k, k, seed) for d in range(references + 1) for k in counts]
    _, costs = settled_centres(every, fits)
    logs = {key: math.log(max(cost, 1e-300)) for key, cost in costs.items()}
    rows = []
    for k in counts:
        own = [logs[d, k] for d in range(1, references + 1)]
        mean = sum(own) / references
        rows.append([k, costs[0, k], mean - logs[0, k], math.sqrt(sum((v - mean) ** 2 for v in own) / references * (1 + 1 / references)), False])
    best = next((i for i in range(len(rows) - 1) if rows[i][2] >= rows[i + 1][2] - rows[i + 1][3]), len(rows) - 1)
    rows[best][4] = True
    return points.sparkSession.createDataFrame([tuple(r) for r in rows], "k int, cost double, gap double, error double, chosen boolean")
