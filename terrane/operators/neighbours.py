"""Exact nearest neighbours without comparing all pairs.

Points are cut into chunks of bounded size by a tree in two levels. The upper tree has a bounded
number of leaves, built from a bounded sample; each leaf is cut further in its own group, so
chunks stay small whatever the number of points. Each chunk is searched on its own, which
bounds every point's search radius. A point then walks down: it visits the leaves whose box lies
within its radius, and in those the chunks whose box does, and the partial results are merged.
The tree steers only where points go, never which are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.session import Workspace

CHUNK_POINTS = 2048  # aim for the points of one chunk, and the visitors of one task
MAX_LEAVES = 4096  # of the upper tree: bounds the sample and the broadcast boxes
SAMPLE_PER_LEAF = 64
BLOCK_CELLS = 2_000_000  # distances held in memory at a time


def _build_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits (dimension, value) of a balanced binary tree, in heap order."""
    splits: list[tuple[int, float]] = []
    level = [sample]
    while len(level) < leaves:
        halves = []
        for points in level:
            if len(points) < 2:
                splits.append((0, np.inf))
                halves += [points, points[:0]]
                continue
            dim = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            value = float(np.median(points[:, dim]))
            splits.append((dim, value))
            right = points[:, dim] > value
            halves += [points[~right], points[right]]
        level = halves
    return splits


def _leaf_of(points: np.ndarray, splits: Sequence[tuple[int, float]], depth: int) -> np.ndarray:
    dims = np.array([s[0] for s in splits] or [0])
    values = np.array([s[1] for s in splits] or [np.inf])
    node = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    for _ in range(depth):
        right = points[rows, dims[node]] > values[node]
        node = 2 * node + 1 + right
    return node - (2**depth - 1)


def _top(
    ids: np.ndarray, points: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (id, neighbour, squared distance) with up to k nearest others per point."""
    order = np.argsort(other_ids, kind="stable")
    other_ids, others = other_ids[order], others[order]
    step = max(1, BLOCK_CELLS // max(1, len(others)))
    for start in range(0, len(points), step):
        block_ids, block = ids[start : start + step], points[start : start + step]
        d2 = np.zeros((len(block), len(others)))
        for dim in range(points.shape[1]):
            d2 += (block[:, dim, None] - others[None, :, dim]) ** 2
        d2[block_ids[:, None] == other_ids[None, :]] = np.inf
        # A stable sort over id-ordered columns breaks ties by id.
        nearest = np.argsort(d2, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(d2, nearest, axis=1)
        kept = np.isfinite(found)
        repeated = np.repeat(block_ids, kept.sum(axis=1))
        yield repeated, other_ids[nearest[kept]], found[kept]


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    blocks = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *found]
    columns = [np.concatenate(column) for column in zip(*blocks, strict=True)]
    return pd.DataFrame(dict(zip(("id", "other", "d2"), columns, strict=True)))


def _merged(counts: np.ndarray, least: int) -> np.ndarray:
    """The leaf that stands for each leaf: subtrees are joined until every group has more than `least` points."""
    stands_for = np.arange(len(counts))

    def join(low: int, high: int) -> int:
        """Points of the smallest group between two leaves."""
        if high - low == 1:
            return int(counts[low])
        middle = (low + high) // 2
        smallest = min(join(low, middle), join(middle, high))
        if smallest > least:
            return smallest
        stands_for[low:high] = low
        return int(counts[low:high].sum())

    join(0, len(counts))
    return stands_for


def _cut(values: np.ndarray, chunk_points: int, least: int) -> np.ndarray:
    """Chunk number of each point of one leaf: halves along the widest side while both stay above `least`."""
    number = np.zeros(len(values), dtype=np.int64)
    todo, count = [np.arange(len(values))], 1
    while todo:
        rows = todo.pop()
        if len(rows) <= chunk_points or len(rows) // 2 <= least:
            continue
        dim = int(np.argmax(values[rows].max(axis=0) - values[rows].min(axis=0)))
        ordered = rows[np.argsort(values[rows, dim], kind="stable")]
        left, right = ordered[: len(rows) // 2], ordered[len(rows) // 2 :]
        number[right] = count
        count += 1
        todo += [left, right]
    return number


def _chunked(points: DataFrame, coords: list[str], count: int, chunk_points: int, least: int) -> DataFrame:
    """Add the upper leaf and, within it, the chunk."""
    leaves = 1
    while leaves < MAX_LEAVES and leaves * chunk_points < count:
        leaves *= 2
    depth = leaves.bit_length() - 1
    columns = ", ".join(f"{c} double" for c in coords)
    leafed = points.withColumn("leaf", F.lit(0).cast("long"))
    if depth:
        # A bounded sample of the coordinates, at most twice SAMPLE_PER_LEAF a leaf on average.
        fraction = min(1.0, SAMPLE_PER_LEAF * leaves / count)
        sample = points.sample(fraction=fraction, seed=7).select(*coords).toPandas().to_numpy(dtype=float)
        splits = _build_tree(sample, leaves)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(leaf=_leaf_of(batch[coords].to_numpy(dtype=float), splits, depth))

        leafed = points.mapInPandas(assign, f"id long, {columns}, leaf long")
        # At most MAX_LEAVES rows.
        sizes = {r["leaf"]: r["n"] for r in leafed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        stands_for = _merged(np.array([sizes.get(leaf, 0) for leaf in range(leaves)]), least)

        def regroup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(leaf=stands_for[batch["leaf"].to_numpy()])

        leafed = leafed.mapInPandas(regroup, f"id long, {columns}, leaf long")

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("id", ignore_index=True)
        return ordered.assign(chunk=_cut(ordered[coords].to_numpy(dtype=float), chunk_points, least))

    return leafed.groupBy("leaf").applyInPandas(cut, f"id long, {columns}, leaf long, chunk long")


def nearest_neighbours(
    points: DataFrame, coords: Sequence[str], k: int, ws: Workspace, chunk_points: int = CHUNK_POINTS
) -> DataFrame:
    """The k nearest other points of every point: id, other, rank from 1, distance.

    `points` has a long `id` and double columns `coords`, without equal points beyond
    `chunk_points` (see `distinct_points`). Equal distances rank by id.
    """
    coords, ws = list(coords), ws.child("neighbours")
    plain = points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in coords])
    plain = ws.save(plain, "points")
    count = plain.count()
    chunked = ws.save(_chunked(plain, coords, count, chunk_points, k), "chunked")

    def within(chunk: pd.DataFrame) -> pd.DataFrame:
        ids, values = chunk["id"].to_numpy(), chunk[coords].to_numpy(dtype=float)
        return _pairs(_top(ids, values, ids, values, k))

    schema = "id long, other long, d2 double"
    own = ws.save(chunked.groupBy("leaf", "chunk").applyInPandas(within, schema), "own")
    found = own.unionByName(_visited(chunked, own, coords, k, ws, chunk_points))
    ranked = Window.partitionBy("id").orderBy("d2", "other")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("id", "other", "rank", F.sqrt("d2").alias("distance"))
    )


def visits(chunked: DataFrame, own: DataFrame, coords: list[str], k: int, ws: Workspace) -> DataFrame:
    """The foreign chunks (leaf, chunk) that may hold a nearer point than a point's own chunk did."""
    sides = [F.min(c).alias(f"lo_{c}") for c in coords] + [F.max(c).alias(f"hi_{c}") for c in coords]
    boxes = ws.save(chunked.groupBy("leaf", "chunk").agg(*sides), "boxes")
    outer = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in coords] + [F.max(f"hi_{c}").alias(f"hi_{c}") for c in coords]
    leaves = boxes.groupBy("leaf").agg(*outer).toPandas().sort_values("leaf")  # at most MAX_LEAVES rows
    numbers = leaves["leaf"].to_numpy()
    low = leaves[[f"lo_{c}" for c in coords]].to_numpy(dtype=float)
    high = leaves[[f"hi_{c}" for c in coords]].to_numpy(dtype=float)
    # Only a table with too few points in all has a chunk of k points or fewer; it has one chunk.
    radius = own.groupBy("id").agg(F.max("d2").alias("radius"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    asking = chunked.join(radius, "id").withColumnsRenamed({"leaf": "own_leaf", "chunk": "own_chunk"})

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, BLOCK_CELLS // max(1, len(numbers)))
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                values = part[coords].to_numpy(dtype=float)
                gap = np.zeros((len(part), len(numbers)))
                for dim in range(len(coords)):
                    x = values[:, dim, None]
                    gap += np.maximum(0.0, np.maximum(low[None, :, dim] - x, x - high[None, :, dim])) ** 2
                rows, columns = np.nonzero(gap <= part["radius"].to_numpy()[:, None])
                yield part.iloc[rows].assign(leaf=numbers[columns])

    columns = ", ".join(f"{c} double" for c in coords)
    routed = asking.mapInPandas(down, f"id long, {columns}, own_leaf long, own_chunk long, radius double, leaf long")
    sides = [f"power(greatest(0D, greatest(lo_{c} - {c}, {c} - hi_{c})), 2)" for c in coords]
    near = F.expr(f"{' + '.join(sides)} <= radius AND (leaf <> own_leaf OR chunk <> own_chunk)")
    return routed.join(boxes, "leaf").where(near).select("id", *coords, "leaf", "chunk")


def _visited(chunked: DataFrame, own: DataFrame, coords: list[str], k: int, ws: Workspace, chunk_points: int) -> DataFrame:
    """Neighbours from the foreign chunks that a point visits."""
    guests = ws.save(visits(chunked, own, coords, k, ws), "visits")
    # Visitors of a busy chunk are spread over several tasks; its points are copied to each.
    at = ["leaf", "chunk"]
    parts = guests.groupBy(*at).agg(F.ceil(F.count("*") / (4 * chunk_points)).alias("parts"))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    hosts = chunked.join(parts, at).withColumn("part", F.explode(numbers))
    guests = guests.join(parts, at).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def search(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        return _pairs(
            _top(
                guest["id"].to_numpy(),
                guest[coords].to_numpy(dtype=float),
                host["id"].to_numpy(),
                host[coords].to_numpy(dtype=float),
                k,
            )
        )

    keys = [*at, "part"]
    return (
        guests.select(*keys, "id", *coords)
        .groupBy(*keys)
        .cogroup(hosts.select(*keys, "id", *coords).groupBy(*keys))
        .applyInPandas(search, "id long, other long, d2 double")
    )


def distinct_points(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """One point per distinct position, under the smallest id, so that copies are no hot group."""
    return points.groupBy(*coords).agg(F.min("id").alias("id")).select("id", *coords)
