"""Size-checked joins and small helpers of the subpackage."""

from __future__ import annotations

import contextlib
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir, written

__all__ = ["BROADCAST_BYTES", "arrow_rows", "crc32_of", "fits", "free_name", "new_path", "released", "shared_dir", "sized", "table", "written"]

#: A side is broadcast only when its counted rows, at this many bytes each, stay under the bound.
BROADCAST_BYTES = 64 << 20


def fits(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few, else as it is (a shuffled join)."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Python tasks of the jobs that run inside get batches of so many rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(task):
    """task (batches -> batches), after which its worker gives the memory that Arrow holds in reserve back."""

    @functools.wraps(task)
    def rows(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return rows


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))
