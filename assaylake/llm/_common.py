"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from assaylake.sources.tables import bucketed, shared_dir, shared_path, stash, table

__all__ = ["SLICE_ROWS", "bucketed", "crc_mod", "partitions", "shared_dir", "shared_path", "slices", "stash", "table", "unused", "with_columns"]

#: Texts are handed to Python code in slices of this many rows, whatever the size of an Arrow batch.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, stem: str) -> str:
    """A prefix from ``stem`` that no column of ``df`` starts with, whatever the case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(stem.lower()) for c in taken):
        stem = f"_{stem}"
    return stem


def with_columns(df: DataFrame, added: dict[str, DataType]) -> StructType:
    """The schema of ``df`` with more columns."""
    return StructType([*df.schema.fields, *(StructField(n, t) for n, t in added.items())])
