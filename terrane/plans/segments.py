"""Model branch: themes, layout, segments, their quality, and the use of the mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.operators import clusters, kmeans, neighbours, nmf, tsne
from terrane.params import Params
from terrane.plans import features, orders, sessions
from terrane.session import Workspace
from terrane.sources.tables import Tables

LAYOUT = ("x", "y")


def model_cells(shares: DataFrame) -> DataFrame:
    """Shares as matrix cells: geo, label (family:feature), value."""
    return shares.select("geo", F.concat_ws(":", "family", "feature").alias("label"), "value")


def theme_factors(shares: DataFrame, p: Params, ws: Workspace, trace: bool = False) -> nmf.Factors:
    """Features to themes, the first rounds: weights per region (w) and per feature (h)."""
    return nmf.factorise(model_cells(shares), "geo", "label", p.nmf_rank, p.nmf_rounds, p.nmf_inner, ws, trace)


def settled_factors(shares: DataFrame, p: Params, ws: Workspace) -> nmf.Factors:
    """Features to themes, until the loss has settled."""
    return nmf.settled(model_cells(shares), "geo", "label", p.nmf_rank, p.nmf_limit, p.nmf_sweeps, ws, p.nmf_tolerance)


def themes_long(factor: DataFrame, key: str, rank: int) -> DataFrame:
    """Factor columns to rows: key, theme, weight."""
    names = nmf.components(rank)
    long = factor.unpivot(key, names, "theme", "weight")
    return long.withColumn("theme", F.substring("theme", 2, 9).cast("int"))


def theme_top_features(factors: nmf.Factors, p: Params) -> DataFrame:
    """The features with the largest weight of each theme, equal weights by name."""
    weights = themes_long(factors.h, "label", p.nmf_rank)
    order = Window.partitionBy("theme").orderBy(F.round("weight", 9).desc(), "label")
    ranked = weights.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= p.themes_top).select("theme", "position", "label", "weight")


def region_points(factors: nmf.Factors) -> DataFrame:
    """Theme weights as points: id and one column a theme."""
    return factors.w.withColumnRenamed("geo", "id").withColumn("id", F.col("id").cast("long"))


def layout(factors: nmf.Factors, p: Params, ws: Workspace) -> DataFrame:
    """Two-dimensional layout of all regions, once it has settled; equal points are laid out once and share the place."""
    coords = nmf.components(p.nmf_rank)
    points = region_points(factors)
    placed = tsne.embed(neighbours.distinct_points(points, coords), coords, p.perplexity, p.tsne_limit, ws, p.tsne_tolerance, p.tsne_early)
    positions = neighbours.distinct_points(points, coords).join(placed, "id").select(*coords, *LAYOUT)
    return ws.child("placed").save(points.join(positions, coords).select("id", *LAYOUT), "layout")


def labelled_points(points: DataFrame, coords: Sequence[str], runs: Sequence[tuple[int, int, int]], p: Params, ws: Workspace) -> DataFrame:
    """(run, id, segment) of several (run, k, seed) settings; all fits go side by side in the same jobs."""
    stored = ws.child("kmeans").save(kmeans.as_points(points, coords), "points")
    fits = [kmeans.Fit(0, *run) for run in runs]
    centres, _ = kmeans.settled_centres(stored, fits, p.kmeans_limit, p.kmeans_tolerance)
    return kmeans.labelled(stored, fits, centres).select("run", "id", "segment")


def segment_labels(points: DataFrame, p: Params, ws: Workspace, coords: Sequence[str] = LAYOUT) -> DataFrame:
    """geo, segment by k-means on the layout, or on other coordinates."""
    labels = labelled_points(points, coords, [(0, p.segments, p.seed)], p, ws)
    return labels.select(F.col("id").cast("int").alias("geo"), "segment")


def segment_count_sweep(placed: DataFrame, p: Params, ws: Workspace) -> DataFrame:
    """Metrics of every number of segments tried; `run` is k."""
    labels = ws.child("runs").save(labelled_points(placed, LAYOUT, [(k, k, p.seed) for k in p.segment_counts], p, ws), "labels")
    return clusters.cluster_metrics(clusters.long_form(placed, LAYOUT), labels)


def segment_stability(placed: DataFrame, p: Params, ws: Workspace) -> DataFrame:
    """Agreement of the labels of every seed with those of the first; `run` is the seed."""
    labels = ws.child("runs").save(labelled_points(placed, LAYOUT, [(seed, p.segments, seed) for seed in p.seeds], p, ws), "labels")
    base = labels.where(F.col("run") == p.seeds[0])
    return clusters.adjusted_rand(labels, base)


def theme_labels(factors: nmf.Factors, p: Params, ws: Workspace) -> DataFrame:
    """geo, segment by k-means on the theme weights themselves."""
    return segment_labels(region_points(factors), p, ws, nmf.components(p.nmf_rank))


def new_region_labels(shares: DataFrame, factors: nmf.Factors, labels: DataFrame, p: Params) -> DataFrame:
    """geo, segment of regions outside the fit: theme weights by non-negative least squares on the
    fixed features, then the nearest of the segments' mean theme weights.

    Features that the fit has not seen do not count. A region without any known feature has weights of zero.
    """
    coords = nmf.components(p.nmf_rank)
    folded = nmf.folded_in(model_cells(shares), factors.h, "geo", "label", p.nmf_rank)
    means = factors.w.select(F.col("geo").cast("int").alias("geo"), *coords).join(labels.where("segment IS NOT NULL"), "geo")
    rows = means.groupBy("segment").agg(*[F.avg(c).alias(c) for c in coords]).orderBy("segment").collect()  # one row a segment
    numbers = F.array(*[F.lit(r["segment"]) for r in rows])
    fit = kmeans.Fit(0, 0, len(rows), 0)
    points = kmeans.as_points(folded.withColumnRenamed("geo", "id"), coords)
    found = kmeans.labelled(points, [fit], {(0, 0): [[r[c] for c in coords] for r in rows]})
    return found.select(F.col("id").cast("int").alias("geo"), F.get(numbers, F.col("segment")).alias("segment"))


def segment_count_gap(placed: DataFrame, p: Params, ws: Workspace) -> DataFrame:
    """Gap statistic of one segment up to one more than the most tried."""
    return kmeans.gap_statistic(placed, LAYOUT, range(1, max(p.segment_counts) + 2), p.gap_references, p.seed, ws)


def chosen_count(metrics: DataFrame) -> int:
    """The number of segments with the highest silhouette, the smaller one if equal. One row per count tried."""
    return metrics.orderBy(F.round("silhouette", 9).desc(), "segments").first()["segments"]


REGION_NAMES = ("dma_name", "dma_short_desc", "district_name")


def segment_map(labels: DataFrame, src: Tables, p: Params, facts: DataFrame | None = None) -> DataFrame:
    """One row per labelled region: its segment and its names, for the search ranking.

    Of several names of a region the first is taken; its ZIP codes and CBSAs stay in the
    region table. Regions without orders keep NULL names.
    """
    regions = orders.geo_map(src, p, facts).where("dma_code IS NOT NULL").groupBy(F.col("dma_code").alias("geo"))
    return labels.join(regions.agg(*[F.min(c).alias(c) for c in REGION_NAMES]), ["geo"], "left")


def sessions_with_segment(labels: DataFrame, src: Tables, p: Params, stored: DataFrame | None = None) -> DataFrame:
    """Session rows with their region and segment; rows without a region keep NULL."""
    rows = stored if stored is not None else sessions.search_sessions(src, p)
    located = sessions.with_region(rows, src, p, sessions.DEFAULT_GRAIN, "left")
    return located.join(labels.withColumnRenamed("geo", "dma_code"), ["dma_code"], "left")


def segment_profile(shares: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean share of every feature per segment, and its lift against the mean over all regions.

    Absent cells are zeros: the sums are divided by the number of regions, not of cells.
    """
    sizes = labels.groupBy("segment").agg(F.count("*").alias("regions"))
    regions = labels.agg(F.count("*")).scalar()
    by_segment = (
        shares.join(labels, "geo").groupBy("segment", "family", "feature").agg(F.sum("value").alias("total"))
    )
    overall = by_segment.groupBy("family", "feature").agg((F.sum("total") / regions).alias("overall"))
    mean = F.col("total") / F.col("regions")
    return (
        by_segment.join(sizes, ["segment"])
        .join(overall.withColumnRenamed("feature", "f").withColumnRenamed("family", "g"),
              F.expr("family = g AND feature = f"))
        .select("segment", "family", "feature", mean.alias("mean_share"), (mean / F.col("overall")).alias("lift"))
    )
