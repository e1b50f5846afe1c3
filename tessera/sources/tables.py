"""Reading input tables, and intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a temporary folder on a single machine, an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(found)
    return found


#: What the enclosing temporary_tables() of this thread or task has written and not deleted yet, if there is one.
_written: ContextVar[set[str] | None] = ContextVar("written", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _written.get()) is not None:
        mine.add(path)
    return path


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(frame: DataFrame) -> None:
    """Delete a table that store() wrote, once nothing reads it any more."""
    mine = _written.get() or set()
    for path in {p.rpartition("/")[0] for p in frame.inputFiles()}:
        _delete(frame.sparkSession, path)
        mine.difference_update({p for p in mine if p.rpartition("/")[2] == path.rpartition("/")[2]})


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete all that this thread writes to the shared folder within, once the results are stored elsewhere.

    What other threads write meanwhile is theirs; within one another, each deletes its own.
    """
    mine: set[str] = set()
    outer = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(outer)
        for path in mine:
            _delete(spark, path)
