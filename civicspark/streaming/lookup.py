"""Static side of stream enrichment: built once into the shared folder, refreshed on demand, read by each micro-batch.

A micro-batch of reports is small; the tables it is enriched from are not. Rebuilding their search structures for
every batch (per-key tables, nearest sites per building spot) costs the whole static side each time. Here they are
built once into a version folder, and a pointer names the current version. Each batch reads the pointer, so a
:meth:`Lookup.refresh` between batches takes effect at the next one without stopping the stream; a batch run again
after a failure reads whatever version is current then.

Facts of the lookup: one row per (kind, key) for kind ``bbl``, ``bin`` and ``addr`` (upper-cased address), with the
building's bbl, borough and its nearest named hospital (name and miles, rounded to 6 places). Per key the building
is chosen as by the batch resolution: smallest bin for a bbl, smallest bbl for a bin or an address.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.ranking import first_per_key
from ..session import ensure_checkpoint_dir

KINDS = {"bbl": ("bbl", ["bin"]), "bin": ("bin", ["bbl"]), "addr": ("upper(address)", ["bbl"])}
STAGE = {"bbl": 1, "bin": 2, "addr": 3}


class Lookup:
    """Versions of the static side under ``root`` (a shared folder), and the pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{ensure_checkpoint_dir(spark)}/lookup-{uuid.uuid4().hex}"

    @property
    def pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def refresh(self, buildings: DataFrame, nearest: DataFrame) -> str:
        """Write a new version from ``buildings`` (bbl, bin, address, borough) and ``nearest`` (bbl,
        nearest_hospital, nearest_hospital_mi), then point to it. Returns the version's folder."""
        facts = []
        for kind, (key, order) in KINDS.items():
            rows = buildings.selectExpr(f"{key} AS key", "bbl", "bin", "borough")
            rows = rows.where("key IS NOT NULL AND key != ''")
            facts.append(first_per_key(rows, ["key"], order).selectExpr(f"'{kind}' AS kind", "key", "bbl", "borough"))
        table = facts[0].unionByName(facts[1]).unionByName(facts[2]).join(nearest, "bbl", "left")
        version = f"{self.root}/v-{uuid.uuid4().hex}"
        table.write.partitionBy("kind").parquet(version)
        self.spark.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").text(self.pointer)
        return version

    def current(self) -> DataFrame:
        version = self.spark.read.text(self.pointer).first()[0]
        return self.spark.read.parquet(version)


def enrich(lookup: Lookup, text: str = "text") -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Enrichment for :func:`reports.start`: rule answers, and the building by bbl, bin or exact address with the
    lookup's facts. Reports need request_id, bbl, bin, address and ``text``; a report no key finds keeps nulls."""

    def run(batch: DataFrame) -> dict[str, DataFrame]:
        # No hint: the facts grow with the buildings, and a broadcast would pass them through the driver in each batch.
        facts = lookup.current()
        asked = batch.selectExpr(
            "request_id", "explode(array("
            "named_struct('kind', 'bbl', 'key', bbl), named_struct('kind', 'bin', 'key', bin), "
            "named_struct('kind', 'addr', 'key', upper(trim(address))))) AS k",
        ).selectExpr("request_id", "k.kind AS kind", "k.key AS key").where("key IS NOT NULL AND key != ''")
        stage = F.when(F.col("kind") == "bbl", 1).when(F.col("kind") == "bin", 2).otherwise(3)
        hits = asked.join(facts, ["kind", "key"]).withColumn("stage", stage)
        won = hits.groupBy("request_id").agg(
            F.min("stage").alias("stage"),
            F.min_by(F.struct("bbl", "borough", "nearest_hospital", "nearest_hospital_mi"), "stage").alias("b"),
        )
        answered = batch.select("request_id", rules.triage(text).alias("r")).select("request_id", "r.category", "r.severity")
        out = answered.join(won, "request_id", "left").select("request_id", "category", "severity", "stage", "b.*")
        return {"result": out}

    return run
