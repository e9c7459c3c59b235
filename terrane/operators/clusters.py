"""The metrics that judge segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(points: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Columns to rows: id, feature, value."""
    return points.unpivot("id", list(coords), "feature", "value")


def cluster_metrics(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every labelling: one row per `run`.

    cells: id, feature, value (absent cells are 0). labels: run, id, segment.
    Within and between cost, Calinski-Harabasz, Davies-Bouldin, and the mean silhouette with
    squared Euclidean distance. A point's summed distance to a segment follows from the
    segment's size, sum vector and sum of squared norms, so no pairs of points are formed:
    the widest intermediate has one row per point and segment.
    """
    norms = cells.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
    labelled = labels.join(norms, "id", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    vectors = (
        labels.join(cells, "id")
        .groupBy("run", "segment", "feature")
        .agg(F.sum("value").alias("total"))
        .withColumnRenamed("segment", "to")
    )
    lengths = vectors.groupBy("run", "to").agg(F.sum(F.col("total") * F.col("total")).alias("length"))
    sizes = labelled.groupBy("run", F.col("segment").alias("to")).agg(
        F.count("*").alias("n"), F.sum("norm").alias("psi")
    )
    segments = (
        sizes.join(lengths, ["run", "to"], "left")
        .withColumn("length", F.coalesce("length", F.lit(0.0)))
        .withColumn("centre", F.col("length") / F.col("n") / F.col("n"))
    )
    dots = (
        labels.join(cells, "id").join(vectors, ["run", "feature"])
        .groupBy("run", "id", "to")
        .agg(F.sum(F.col("value") * F.col("total")).alias("dot"))
    )
    # One row per point and segment of its run.
    grid = (
        labelled.join(segments, ["run"])
        .join(dots, ["run", "id", "to"], "left")
        .withColumn("dot", F.coalesce("dot", F.lit(0.0)))
        .withColumn("own", F.col("segment") == F.col("to"))
    )
    summed = F.greatest(F.col("n") * F.col("norm") + F.col("psi") - 2 * F.col("dot"), F.lit(0.0))
    to_centre = F.sqrt(F.greatest(F.col("norm") - 2 * F.col("dot") / F.col("n") + F.col("centre"), F.lit(0.0)))
    per_point = grid.groupBy("run", "id").agg(
        F.max(F.when(F.col("own"), F.col("n"))).alias("own_n"),
        F.max(F.when(F.col("own") & (F.col("n") > 1), summed / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~F.col("own"), summed / F.col("n"))).alias("b"),
    )
    silhouette = F.when(
        (F.col("own_n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")
    ).otherwise(0.0)
    mean_silhouette = per_point.groupBy("run").agg(F.avg(silhouette).alias("silhouette"))

    between_segments = grid.groupBy("run", "segment", "to").agg(
        F.sum("dot").alias("dot"),
        F.sum(F.when(F.col("own"), to_centre)).alias("radius"),
        F.max("n").alias("n"),
        F.max("centre").alias("centre"),
        F.max("psi").alias("psi"),
    )
    own = between_segments.where(F.col("segment") == F.col("to")).select(
        "run", "segment", "n", "psi", "centre", (F.col("radius") / F.col("n")).alias("spread")
    )
    here = own.select("run", "segment", F.col("n").alias("n1"), F.col("centre").alias("c1"), F.col("spread").alias("s1"))
    there = own.select("run", F.col("segment").alias("to"), F.col("spread").alias("s2"))
    gap = F.sqrt(
        F.greatest(F.col("c1") + F.col("centre") - 2 * F.col("dot") / F.col("n1") / F.col("n"), F.lit(0.0))
    )
    worst = (
        between_segments.where(F.col("segment") != F.col("to"))
        .join(here, ["run", "segment"])
        .join(there, ["run", "to"])
        .groupBy("run", "segment")
        .agg(F.max((F.col("s1") + F.col("s2")) / gap).alias("worst"))
        .groupBy("run")
        .agg(F.avg("worst").alias("davies_bouldin"))
    )
    overall = vectors.groupBy("run", "feature").agg(F.sum("total").alias("total"))
    centre = overall.groupBy("run").agg(F.sum(F.col("total") * F.col("total")).alias("length"))
    costs = own.groupBy("run").agg(
        F.sum("n").alias("points"),
        F.count("*").alias("segments"),
        F.sum(F.col("psi") - F.col("n") * F.col("centre")).alias("within_cost"),
        F.sum(F.col("n") * F.col("centre")).alias("weighted"),
    )
    between = F.col("weighted") - F.col("length") / F.col("points")
    ratio = (F.col("between_cost") / (F.col("segments") - 1)) / (
        F.col("within_cost") / (F.col("points") - F.col("segments"))
    )
    return (
        costs.join(centre, "run")
        .withColumn("between_cost", between)
        .withColumn("calinski_harabasz", ratio)
        .join(worst, "run", "left")
        .join(mean_silhouette, "run")
        .select(
            "run",
            "points",
            "segments",
            "within_cost",
            "between_cost",
            "calinski_harabasz",
            "davies_bouldin",
            "silhouette",
        )
    )


def adjusted_rand(labels: DataFrame, base: DataFrame) -> DataFrame:
    """Adjusted Rand index of every labelling against a base labelling.

    labels: run, id, segment. base: id, segment. The contingency table is a group-by.
    """
    pairs = labels.join(base.select("id", F.col("segment").alias("base")), "id")
    cells = pairs.groupBy("run", "segment", "base").agg(F.count("*").cast("double").alias("n"))

    def choose(column: str):
        return F.col(column) * (F.col(column) - 1) / 2

    both = cells.groupBy("run").agg(F.sum(choose("n")).alias("both"), F.sum("n").alias("points"))
    one = cells.groupBy("run", "segment").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(choose("n")).alias("one"))
    two = cells.groupBy("run", "base").agg(F.sum("n").alias("n")).groupBy("run").agg(F.sum(choose("n")).alias("two"))
    expected = F.col("one") * F.col("two") / choose("points")
    largest = (F.col("one") + F.col("two")) / 2
    index = F.when(largest == expected, 1.0).otherwise((F.col("both") - expected) / (largest - expected))
    return both.join(one, "run").join(two, "run").select("run", F.col("points").cast("long").alias("points"), index.alias("adjusted_rand"))
