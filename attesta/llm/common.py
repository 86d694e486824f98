"""Helpers that the operators share: tables, lineage cuts and Arrow plumbing."""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..operators.scratch import cut, shared_dir

__all__ = ["ascii_lower", "beside", "cut", "parallelism", "shared_dir", "table", "utf8", "worker_store"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, to be broadcast into a join where it is counted at ``most`` rows or fewer, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def worker_store() -> dict:
    """What this Python process keeps from task to task.  Functions travel by value, so their own globals last one task."""
    return sys.modules.setdefault("_attesta_kept", ModuleType("_attesta_kept")).__dict__.setdefault("kept", {})


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column: pa.ChunkedArray | pa.Array):
    """The values of an Arrow string column as bytes, one at a time; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from utf8(chunk)
        return
    buffers = column.buffers()
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return
    ends = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield b"" if valid is not None and not valid[i] else bytes(data[ends[i] : ends[i + 1]])
