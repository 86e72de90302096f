"""BBL to BIN crosswalk: candidate pairs from several sources, best pair per lot, fill of missing numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_per_key


def _blank(c: Column) -> Column:
    return c.isNull() | c.isin("", "0")


def candidates(source: DataFrame, priority: int) -> DataFrame:
    pairs = source.select(F.col("bbl").cast("string").alias("bbl"), F.col("bin").cast("string").alias("bin"))
    known = pairs.where(~_blank(F.col("bbl")) & ~_blank(F.col("bin")))
    return known.groupBy("bbl", "bin").agg(F.count(F.lit(1)).alias("cnt")).withColumn("src_pri", F.lit(priority))


def crosswalk(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """(bbl, bin): lowest priority number first, then the most frequent pair, then the smaller bin."""
    pairs = reduce(lambda a, b: a.unionByName(b), [candidates(df, p) for df, p in sources])
    best = first_per_key(pairs, ["bbl"], ["src_pri", "cnt DESC", "bin"])
    return best.select("bbl", "bin")


def fill_bins(buildings: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Take the crosswalk's bin where the building has none; an unmatched lot keeps what it had."""
    found = xwalk.select("bbl", F.col("bin").alias("_found"))
    filled = F.when(_blank(F.col("bin")), F.coalesce("_found", "bin")).otherwise(F.col("bin"))
    return buildings.join(found, "bbl", "left").withColumn("bin", filled).drop("_found")
