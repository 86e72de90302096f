"""Stream of incident reports: rules inline, enrichment per micro-batch."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules
from ..plans import history as h
from ..plans import triage as tr
from ..session import ensure_checkpoint_dir


def read_reports(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def classify(reports: DataFrame, text: str = "text") -> DataFrame:
    """Stateless step: rule answer columns next to the report."""
    return reports.withColumn("r", rules.triage(text)).select("*", "r.*").drop("r")


def without_resends(reports: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Drop reports sent again within the watermark; state is bounded by ``delay``."""
    return reports.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def start(
    reports: DataFrame, enrich: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str, once: bool = False,
    trigger: str = "30 seconds",
):
    """Run ``enrich`` on each micro-batch and write every frame it returns under ``out/<name>/batch_id=<n>``.

    A batch that is run again after a failure overwrites its own folder, so the sink is idempotent. The batch is
    persisted while it is enriched, since the ranking steps read it several times.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, df in enrich(held).items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        finally:
            held.unpersist()

    writer = reports.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)
    return writer.start()


def triage_enrichment(
    buildings: DataFrame, tables: h.Tables, hospitals: DataFrame | None = None, hydrants: DataFrame | None = None,
    facilities: DataFrame | None = None,
) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Enrichment for :func:`start`: resolution, history, context and nearest resources of each micro-batch.

    Reports need request_id, text, address, latitude and longitude. Ranking is not possible on a stream itself, so it
    runs on the micro-batch as an ordinary frame.
    """
    return lambda batch: tr.batch_triage(batch, buildings, tables, hospitals, hydrants, facilities)


def triage_once(spark: SparkSession, path: str, schema: str, key: str | None = None, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Everything now in ``path`` through the stream, read back as one frame.

    Reports sent again within ``delay`` are dropped if a key and a time column are given; else no state is kept.
    """
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    reports = read_reports(spark, path, schema)
    stream = classify(reports if key is None or time is None else without_resends(reports, key, time, delay))
    run = start(stream, lambda batch: {"result": batch}, f"{root}/out", f"{root}/state", once=True)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return spark.read.parquet(f"{root}/out/result").drop("batch_id")
