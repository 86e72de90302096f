"""Sinks, inventory and JSON in and out."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Replace-all sink, safe to run again. ``sort_by`` clusters the files so that key lookups skip most of them."""
    if sort_by:
        df = df.repartitionByRange(F.col(sort_by)).sortWithinPartitions(sort_by)
    df.write.mode("overwrite").parquet(path)


def append_to(spark: SparkSession, old_path: str, rows: DataFrame, new_path: str) -> DataFrame:
    """Old table plus rows, written to a new folder (a folder being read cannot be overwritten)."""
    spark.read.parquet(old_path).unionByName(rows, allowMissingColumns=True).write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table. Parquet counts come from file footers."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def describe_tables(spark: SparkSession) -> dict[str, list[tuple[str, str]]]:
    """Registered tables and views with their columns and types."""
    return {t.name: spark.table(t.name).dtypes for t in spark.catalog.listTables()}


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def encode_documents(docs: DataFrame, encoder: Callable[[pd.Series], list], text: str = "document") -> DataFrame:
    """Add an embedding column with a pluggable batch encoder; one call per Arrow batch."""
    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["embedding"] = list(encoder(pdf[text]))
            yield pdf

    return docs.mapInPandas(run, schema)


def write_vectors(docs: DataFrame, encoder: Callable[[pd.Series], list], path: str) -> None:
    encode_documents(docs, encoder).write.mode("overwrite").parquet(path)


SCENARIO_SCHEMA = (
    "scenarios array<struct<id:string,text:string,borough:string,image_b64:string,"
    "expected:struct<category:string,severity:int,agency:string>>>"
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(SCENARIO_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.explode("scenarios").alias("s")).select("s.*")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
