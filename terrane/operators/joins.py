"""Joins that stay safe when a key is often NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_SALTS = 997


def join_nullable(fact: DataFrame, dim: DataFrame, key: str, spread_by: Column) -> DataFrame:
    """Left join on a key that is often NULL.

    All NULL keys would hash to one partition. They match nothing, so each such row gets a
    salt from `spread_by`, while every row with a key and every row of `dim` has salt 0.
    The zero of `dim` is a remainder modulo 1 of its key: a literal would be folded out of
    the join key, and with it the spreading.
    """
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(NULL_SALTS))).otherwise(F.lit(0))
    salted = fact.withColumn("_salt", salt.cast("int"))
    zero = F.pmod(F.xxhash64(F.col(key)), F.lit(1)).cast("int")
    return salted.join(dim.withColumn("_salt", zero), [key, "_salt"], "left").drop("_salt")
