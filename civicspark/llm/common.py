"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import written

__all__ = ["read", "written", "slices", "tokenizer_file", "buckets_for", "utf8", "fresh", "held_out"]

SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file on this machine (each node has the same installed package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch that hold at most about ``size`` bytes of a text column (one row at least)."""
    total = batch.column(column).nbytes
    if total <= size or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), column, size)
    yield from slices(batch.slice(half), column, size)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def buckets_for(rows: int, per_bucket: int) -> int:
    """How many buckets keep each at about ``per_bucket`` rows, whatever the number of rows."""
    return max(1, -(-rows // per_bucket))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with marks added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Rows on which labels are never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
