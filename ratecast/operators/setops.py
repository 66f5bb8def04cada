"""Set operations (survey U1, U2, U4, U5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.operators.windows import dedupe


def union_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[str] = ()) -> DataFrame:
    """Union by name (missing columns become null), then one row per
    key with the new side winning; within a side the last by ``arrival``."""
    u = (old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    return dedupe(u, keys, ["_src", *arrival], keep="last").drop("_src")


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """U2 (partial aggregation per partition, then one shuffle)."""
    return df.select(c).distinct()


def except_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: rows of ``a`` whose key is absent from ``b``."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def partition_by(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Complementary halves; a null condition goes to the second half."""
    c = F.coalesce(cond, F.lit(False))
    return df.where(c), df.where(~c)
