"""Exact distinct counts by any grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_count(df: DataFrame, keys: Sequence[str], measure: str, name: str) -> DataFrame:
    """Exact count of distinct `measure` per `keys`; NULL keys are groups, NULL measures are not counted.

    Spark shuffles this on (keys, measure) after a map-side combine, so a hot key is spread
    over all partitions and only one number per partition and key meets in the last step.
    """
    return df.groupBy(*keys).agg(F.count_distinct(F.col(measure)).alias(name))


def distinct_count_sets(
    df: DataFrame, grain: str, keys: Sequence[str], measure: str, name: str
) -> DataFrame:
    """The roll-ups (grain, key) for every key in one pass over `df`.

    `grouping_id` tells the sets apart: a real NULL key and a key left out of the set look alike.
    Result: grain, family (name of the key), feature (its value), count.
    """
    sets = [[F.col(grain), F.col(key)] for key in keys]
    grouped = df.groupingSets(sets, grain, *keys).agg(
        F.grouping_id().alias("_set"), F.count_distinct(F.col(measure)).alias(name)
    )
    full = (1 << len(keys)) - 1
    family, feature = F.lit(None).cast("string"), F.lit(None).cast("string")
    for position, key in enumerate(keys):
        in_set = F.col("_set") == full - (1 << (len(keys) - 1 - position))
        family = F.when(in_set, key).otherwise(family)
        feature = F.when(in_set, F.col(key)).otherwise(feature)
    return grouped.select(grain, family.alias("family"), feature.alias("feature"), name)
