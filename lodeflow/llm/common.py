"""What several operators share: written tables, Arrow columns and word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodeflow.functions.shared import free_name, removed, shared_dir, stored, workspace  # noqa: F401  (for the operators here)

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_held: list = []


def sole[T](held: T) -> T:
    """``held``, what an operator keeps in a worker from batch to batch, after all that other operators keep is released.

    A worker serves one operator after another; what is freed goes back to the system.
    """
    if not any(h is held for h in _held):
        for h in _held:
            h.release()
        _held[:] = [held]
        given_back()
    return held


def given_back() -> None:
    """Let the C library return free memory, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of few rows and about ``most`` bytes; a single longer row is a slice of its own.

    Arrow's pool would keep the memory of all batches so far; after each batch it is given back.
    """
    for b in batches:
        at, step = 0, max(1, min(rows, b.num_rows * most // max(1, b.nbytes)))
        while at < b.num_rows:
            yield b.slice(at, step)
            at += step
        pa.default_memory_pool().release_unused()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let a session send few rows at once to Python: texts are long.

    For an application to call (the queries and the pipeline do); operators leave the session's settings alone. A setting other
    than Spark's default stays.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with ``f`` on small slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield f(b)

    return df.mapInArrow(run, schema)
