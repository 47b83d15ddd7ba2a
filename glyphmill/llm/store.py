"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage: a lost executor costs the tasks that read the
table, never the tasks that made it.
"""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Folder, app_dir


#: Bytes that a broadcast side may take in memory, and of a row besides its values.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def is_small(df: DataFrame, value_bytes: int) -> bool:
    """Whether a written table, whose rows have ``value_bytes`` at most, may be
    broadcast: its rows are counted first."""
    return df.count() * (value_bytes + ROW_BYTES) <= BROADCAST_BYTES


def small_side(df: DataFrame, value_bytes: int) -> DataFrame:
    """``df`` to be broadcast if it is small, else as it is, for a shuffle."""
    return F.broadcast(df) if is_small(df, value_bytes) else df


#: Bytes of texts that go to a Python worker at once. A column vector doubles when it
#: grows, so a batch takes some three times that outside the heap, in every task.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to BATCH_BYTES, unless it is lower."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


class Scratch:
    """Tables of one query under a folder of its own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{app_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # lz4_raw is plain Java: native compressors leave memory outside the heap in pieces
        df.write.option("compression", "lz4_raw").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        Folder(self.spark, self.root).delete(name)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators wrote; results that have
    not been written yet can't be read after that."""
    Folder(spark, f"{app_dir(spark)}/llm").delete()


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers
    outlive their tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
