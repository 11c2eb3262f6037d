"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import wraps
from inspect import isgeneratorfunction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session in one process that names none gets a local one, a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/passbook/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has stored; only once no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> str:
    """Writes df to a new folder in the shared one, parted by columns; the folder's path."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return path


def stored(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts the lineage and gives true sizes."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, by))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made and nothing reads any more."""
    if not path.startswith(run_dir(spark)):
        raise ValueError(f"{path} is not one of this application's folders")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all taken ones, whatever their case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def _give_back() -> None:
    """Returns what this process has freed to the system; its allocators would keep it for the next task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run, a function for mapInArrow or applyInArrow, so that a worker that goes on to other tasks holds no memory of this one."""
    if isgeneratorfunction(run):

        @wraps(run)
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                _give_back()

    else:

        @wraps(run)
        def over(table: pa.Table) -> pa.Table:
            try:
                return run(table)
            finally:
                _give_back()

    return over


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(df: DataFrame) -> DataFrame:
    """df dealt out anew, so that a join above gets a shuffle of its own on this side and Spark can split its hot keys."""
    return df.repartition(shuffle_partitions(df.sparkSession))
