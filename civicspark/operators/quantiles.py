"""Exact order statistics per group, for groups of any size.

The value at a 0-based rank is found by narrowing: values are counted per distinct value, spread over ``BINS`` equal
bins between the group's extremes, and only the bin that holds the wanted rank is looked into, again and again until
it holds at most ``SMALL`` distinct values. So no more than that are ever sorted as a whole, whatever their
distribution, and copies of a value cost one row. Infinities and NaN have bins of their own; spans are taken from
halves of the extremes, so values across the whole double range narrow as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_same
from .staging import written

BINS = 1024
SMALL = 100_000  # distinct values a group may have before it is narrowed


def weigh(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct values with their multiplicity (NULLs are left out)."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (v != F.lit(float("inf"))) & (v != F.lit(float("-inf")))


def _slot(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value in Spark's order: -inf is bin 0, finite values 1 to BINS (equal widths between the finite
    extremes, taken from halves so that no span overflows), +inf BINS + 1 and NaN BINS + 2. Each round moves the
    smallest and the largest finite value apart, so narrowing always ends."""
    span = hi / 2 - lo / 2
    inner = F.when(span > 0, F.least(F.floor((v / 2 - lo / 2) / span * F.lit(BINS)), F.lit(BINS - 1))).otherwise(F.lit(0))
    return (
        F.when(F.isnan(v), F.lit(BINS + 2))
        .when(v == F.lit(float("inf")), F.lit(BINS + 1))
        .when(v == F.lit(float("-inf")), F.lit(0))
        .otherwise(inner + 1)
    )


def _narrow(values: DataFrame, keys: list[str]) -> DataFrame:
    """Keep, per key, the bin in which the wanted rank falls, and make the rank relative to that bin."""
    finite = F.when(_finite(F.col("v")), F.col("v"))
    limits = values.groupBy(*keys).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    slot = _slot(F.col("v"), F.col("lo"), F.col("hi"))
    binned = join_same(values, limits, keys).withColumn("bin", slot.cast("int")).drop("lo", "hi")
    sums = binned.groupBy(*keys, "rank", "bin").agg(F.sum("m").alias("size"))
    upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("bin"))  # at most BINS + 3 rows per key
    wanted = (
        sums.withColumn("below", upto - F.col("size"))
        .where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("size")))
        .select(*keys, "bin", "below")
    )
    return join_same(binned, wanted, [*keys, "bin"]).withColumn("rank", F.col("rank") - F.col("below")).drop("bin", "below")


def values_at(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(groups..., pick, v): for each entry of ``ranks`` the value at that 0-based rank in ascending order.

    A rank is an expression over ``n``, the number of values in the group.
    """
    values = written(weigh(df, groups, value), "values")
    widest = values.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    sizes = values.groupBy(*groups).agg(F.sum("m").alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("pick"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    goals = sizes.select(*groups, F.explode(wanted).alias("_goal")).select(*groups, "_goal.pick", "_goal.rank")
    keys = [*groups, "pick"]
    picked = values.withColumn("pick", F.explode(F.array(*[F.lit(p) for p in ranks])))
    left = join_same(picked, goals, keys)
    while widest > SMALL:
        left = written(_narrow(left, keys), "narrowed")
        widest = left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("v"))
    found = left.withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
    return found.groupBy(*keys).agg(F.min("v").alias("v"))


def rank_at(p: float) -> Column:
    """Rank used by the latency summaries: int(n * p), at most n - 1."""
    return F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)



def median_ranks() -> dict[str, Column]:
    """The middle value twice for odd n, the two middle values for even n."""
    return {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}


def median(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    picks = values_at(df, groups, value, median_ranks())
    return picks.groupBy(*groups).agg(F.avg("v").alias("median"))
