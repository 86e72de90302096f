"""Places of rows within their group, in a given order, without putting a whole group into one task.

A window ``row_number() over (partition by g order by ...)`` sends every row of a group to one task; one group may
hold a third of all rows. Here rows are range-partitioned by (group, order), so a large group is cut over many
partitions; each partition numbers its rows locally, and only groups that cross a partition edge (at most two per
partition) need an offset from earlier partitions, which is a table of at most twice the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import written


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number rows within runs of equal ``_g`` in the order they come (rows arrive sorted within the partition)."""
    part = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        if batch.empty:
            continue
        groups = batch["_g"].to_numpy()
        new = pd.Series(groups).ne(pd.Series(groups).shift()).to_numpy()
        new[0] = groups[0] != last
        run = new.cumsum()
        within = pd.Series(1, index=batch.index).groupby(run).cumsum().to_numpy() - 1
        if not new[0]:
            within[run == run[0]] += count
        last = groups[-1]
        count = int(within[-1]) + 1
        batch["_part"] = part
        batch["_local"] = within
        yield batch


def positions(df: DataFrame, group: Column, order: list[Column], name: str = "positions") -> DataFrame:
    """``df`` with ``_g`` (the group, as a string that must not be null) and ``_pos`` (0-based place in the group).

    ``order`` should end ties (equal rows may take their places in any order). The numbered rows are written to the
    shared folder once, so a lost executor re-reads them instead of numbering them anew. Columns ``_g``, ``_part``,
    ``_local`` and ``_pos`` of ``df`` are replaced.
    """
    keyed = df.drop("_g", "_part", "_local", "_pos").withColumn("_g", group)
    ranged = keyed.repartitionByRange(_partitions(df), "_g", *order).sortWithinPartitions("_g", *order)
    schema = StructType(list(keyed.schema.fields) + [StructField("_part", IntegerType()), StructField("_local", LongType())])
    local = written(ranged.mapInPandas(_numbered, schema), name)
    spans = local.groupBy("_part", "_g").agg(F.count(F.lit(1)).alias("_c"))
    crossing = spans.groupBy("_g").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_g")
    # Only groups over more than one partition get an offset: at most two rows a partition, a bounded broadcast.
    before = F.sum("_c").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.join(crossing, "_g").select("_part", "_g", F.coalesce(before, F.lit(0)).alias("_off"))
    placed = local.join(F.broadcast(offsets), ["_part", "_g"], "left")
    return placed.withColumn("_pos", F.col("_local") + F.coalesce("_off", F.lit(0))).drop("_off", "_part", "_local")
