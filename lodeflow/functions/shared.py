"""Tables written in the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, or below the warehouse where that is unset; inside a workspace, below that."""
    root = _workspace.get() or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/lodeflow-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a path and all below it through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """One folder for all that is stored inside the block; it is removed at the block's end.

    A lazy result that still reads such tables must be used before that.
    """
    path = shared_dir(spark)
    token = _workspace.set(path)
    try:
        yield path
    finally:
        _workspace.reset(token)
        removed(spark, path)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as no column of that name needs; Spark's names ignore case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
