"""Exact distinct counts that can be merged: one stored table, rolled up to any coarser keys.

Ids are non-negative integers. Those of a group are held as bitmaps of 32,768 ids each (4 KB, mostly zeros
that compress well), one row per group and bitmap in use. A union of groups is the OR of their
bitmaps, so months come from days and regions from finer cells without the rows behind them.
Ids should be dense, such as row numbers of a dictionary; scattered ones use a bitmap each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "id_bucket", "id_bits"


def distinct_bits(rows: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """(keys, id_bucket, id_bits): the distinct ids of every group. A group with null ids only keeps an empty bitmap."""
    marked = rows.select(*keys, F.bitmap_bucket_number(unit).alias(BUCKET), F.bitmap_bit_position(unit).alias("_bit"))
    return marked.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg("_bit").alias(BITS))


def rolled_up(bits: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Distinct ids per combination of `keys`, some of those the bitmaps are stored by."""
    merged = bits.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count(BITS)).alias(count))
