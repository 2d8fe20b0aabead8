"""Deterministic sampling: hash-ordered samples, stratified splits and strides."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.operators.ranking import value_ranks


def hash_order(key: str, seed: int) -> Column:
    """md5 of key and seed: the same order on every engine and every run."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stable_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def hash_number(key: str, seed: int) -> Column:
    """First 12 hex digits of the md5 as a whole number (exact in a double)."""
    return F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("double")


def stratified_split(df: DataFrame, key: str, stratum: str, frac: float, seed: int) -> DataFrame:
    """``is_train`` for the ``floor(frac*n)`` smallest hashes of each stratum; ranks are block-wise, never one task."""
    h = df.withColumn("_h", hash_number(key, seed))
    r = value_ranks(h, "_h", [stratum]).select(F.col(stratum).alias("_s"), F.col("value").alias("_v"), "below_n", "all_n")
    out = h.join(r, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_v")), "inner")
    return out.withColumn("is_train", F.col("below_n") < F.floor(F.col("all_n") * frac)).drop("_h", "_s", "_v", "below_n", "all_n")


def stride(df: DataFrame, index_columns: Sequence[str], step: int) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) % step == 0 for c in index_columns]))
