"""Intermediate results as Parquet folders, so that a long chain of joins is computed once and lost executors cost single tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table, and characters in it, that may be broadcast; larger ones take joins that shuffle, or are refused where only a scan can answer.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32_000_000


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; a session in one process that names none gets a local one, a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/passbook/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df, written (in a folder for each value of some columns) and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all taken ones, whatever their case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written; only once no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame) -> bool:
    """Whether df is small enough for a broadcast."""
    texts = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind == "string" or kind.startswith("array")]
    rows, chars = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(sum(texts, F.lit(0)))).first()
    return rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size is within the bounds, else with one for a join that shuffles."""
    return F.broadcast(df) if fits(df) else df.hint("merge")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, for rows that are few bytes but much work: adaptive execution would put them in one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
