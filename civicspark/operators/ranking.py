"""First rows per key, keyed lookups and surrogate ids. Orders are SQL texts such as ``"ts DESC NULLS LAST"``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str], k: int = 1, rank: str = "rn") -> DataFrame:
    """First k rows per key. Each map task keeps k rows per key before the shuffle (WindowGroupLimit)."""
    window = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS {rank}"
    return df.selectExpr("*", window).where(f"{rank} <= {k}")


def latest_per_key(df: DataFrame, keys: list[str], when: str, *ties: str) -> DataFrame:
    """Newest row per key; rows without a time come last."""
    return first_per_key(df, keys, [f"{when} DESC NULLS LAST", *ties]).drop("rn")


def with_row_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Unique id without a global sort. Fixed once the rows are written; do not compare across runs."""
    return df.withColumn(name, F.monotonically_increasing_id())


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*[F.expr(o) for o in order]).offset(offset).limit(limit)
