"""Intermediate results that several later steps read: written once to the shared folder, then scanned."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

T = TypeVar("T")


def _home(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> bool:
    """Delete what this session has written so far; False if there was nothing. Frames built on it end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_home(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back.

    This ends the lineage (a lost executor costs a re-read, not a re-run), keeps the plans that use it small, and
    gives the planner true sizes. Some frames are as large as the table they come from (best spots with payload, word
    postings), so call :func:`forget` when a query's result has been used.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*steps: Callable[[], T]) -> list[T]:
    """Run independent steps at the same time, so that their jobs share the cluster instead of queueing."""
    if len(steps) < 2:
        return [step() for step in steps]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inherit(step)) for step in steps]]
