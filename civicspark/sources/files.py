"""Scans and file discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Parquet, or CSV with a header where every column is text and rows of the wrong length are dropped.

    Files are split among tasks. ``multi_line`` lets quoted fields hold line breaks, but makes each CSV file one task.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)  # the row length check must not depend on the columns selected
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def find_file(spark: SparkSession, dirs: list[str], names: list[str]) -> str | None:
    """First existing candidate: directories in order, and within one the names in order."""
    for folder in dirs:
        for name in names:
            path = f"{folder.rstrip('/')}/{name}"
            if path_exists(spark, path):
                return path
    return None


def headers(df: DataFrame) -> dict[str, str]:
    """Lower-case header -> header as found."""
    return {c.lower(): c for c in df.columns}


def pick(available: dict[str, str], *candidates: str) -> Column:
    """First candidate present, whatever its case; a NULL text column when none is."""
    for name in candidates:
        if name.lower() in available:
            return F.col("`" + available[name.lower()].replace("`", "``") + "`")
    return F.lit(None).cast("string")


def is_present(available: dict[str, str], *candidates: str) -> bool:
    return any(c.lower() in available for c in candidates)


def filtered(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Source-side row filter; on Parquet it is pushed into the scan."""
    return df.where(F.col(column).isin(values))
