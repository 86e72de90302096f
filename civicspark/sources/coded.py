"""Coded incidents: one CSV to six typed columns, with 0, 20 and -1 as the marks of unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import scalars as s
from .files import read_table


def _number(c: Column) -> Column:
    """Leading number of a text as float, 0 when there is none."""
    lead = F.regexp_extract(codes.trim_quoted(c), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.nullif(lead, F.lit("")).try_cast("float"), F.lit(0.0).cast("float"))


def code_incidents(df: DataFrame) -> DataFrame:
    """Columns are found by name, upper-cased and trimmed, with a blank or an underscore between words."""
    have = {c.strip().strip('"').upper().replace("_", " "): c for c in df.columns}

    def text(name: str) -> Column:
        return F.col(f"`{have[name]}`") if name in have else F.lit(None).cast("string")

    created = s.epoch_seconds(text("CREATED DATE"))
    return df.select(
        codes.complaint_code(text("COMPLAINT TYPE")).alias("complaint_type"),
        codes.borough_code(text("BOROUGH")).alias("borough"),
        created.alias("created_date"),
        s.resolution_days(created, s.epoch_seconds(text("CLOSED DATE"))).alias("resolution_days"),
        _number(text("LATITUDE")).alias("lat"),
        _number(text("LONGITUDE")).alias("lon"),
    )


def load_coded(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return code_incidents(read_table(spark, path, multi_line))


def decode_incidents(coded: DataFrame) -> DataFrame:
    return coded.withColumns({
        "complaint_type": codes.complaint_label(F.col("complaint_type")),
        "borough": codes.borough_label(F.col("borough")),
    })
