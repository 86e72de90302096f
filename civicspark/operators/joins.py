"""Join shapes shared by the plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_spread(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join on a text key that spreads rows without a key over all tasks instead of hashing them onto one.

    Such rows get a key of their own that nothing can match. (A constant salt column would not do: the optimizer
    folds a constant key away.)
    """
    own = left.withColumn("_k", F.expr(f"coalesce({key}, concat('\\0', CAST({spread_by} AS STRING)))"))
    other = right.where(f"{key} IS NOT NULL").withColumnRenamed(key, "_k")
    return own.join(other, "_k", "left").drop("_k")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys. Spark still hashes or sorts it."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(other, F.expr(" AND ".join(f"{k} <=> _r_{k}" for k in keys)), how).drop(*[f"_r_{k}" for k in keys])


def merge_measures(parts: list[DataFrame], keys: list[str], how: dict[str, str]) -> DataFrame:
    """Fold several frames with the same keys and different measures into one row per key, in a single shuffle.

    ``how`` names the aggregate of each measure: sum, min, max or bool_or. A key absent from a part keeps NULL there.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    calls = {"sum": F.sum, "min": F.min, "max": F.max, "bool_or": F.bool_or}
    return stacked.groupBy(*keys).agg(*[calls[f](c).alias(c) for c, f in how.items()])
