"""Predicates and scored top-k search over coded incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points for an equal borough, an equal complaint type, and the two distance steps (squared degrees).
BOROUGH_POINTS, COMPLAINT_POINTS = 2.0, 3.0
NEAR, NEAR_POINTS = 0.001, 1.0
AROUND, AROUND_POINTS = 0.01, 0.5


def in_box(lat: str, lon: str, south: float, north: float, west: float, east: float) -> Column:
    return F.col(lat).between(south, north) & F.col(lon).between(west, east)


def count_matches(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows matching each predicate, all in one pass."""
    return df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def score(borough: int, complaint: int, lat: float, lon: float) -> Column:
    """Points per row. Codes of 0 or less and a coordinate of 0 mean "not given"."""
    terms = ["0F"]
    if borough > 0:
        terms.append(f"CASE WHEN borough = {borough} THEN {BOROUGH_POINTS}F ELSE 0F END")
    if complaint > 0:
        terms.append(f"CASE WHEN complaint_type = {complaint} THEN {COMPLAINT_POINTS}F ELSE 0F END")
    if lat != 0 and lon != 0:
        dlat, dlon = f"(lat - CAST({lat!r}D AS FLOAT))", f"(lon - CAST({lon!r}D AS FLOAT))"
        d = f"({dlat} * {dlat} + {dlon} * {dlon})"
        terms.append(
            f"CASE WHEN lat != 0 AND {d} < CAST({NEAR}D AS FLOAT) THEN {NEAR_POINTS}F "
            f"WHEN lat != 0 AND {d} < CAST({AROUND}D AS FLOAT) THEN {AROUND_POINTS}F ELSE 0F END"
        )
    return F.expr(" + ".join(terms))


def scored_top_k(df: DataFrame, k: int, tie: str, borough: int = 0, complaint: int = 0, lat: float = 0.0, lon: float = 0.0) -> DataFrame:
    """Best k rows with a positive score; ties by ``tie``."""
    scored = df.withColumn("score", score(borough, complaint, lat, lon)).where("score > 0")
    return scored.orderBy(F.col("score").desc(), F.col(tie)).limit(k)
