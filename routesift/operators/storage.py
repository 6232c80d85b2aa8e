"""The folder that all executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is missing a local session takes a temporary folder; a cluster, whose
    executors don't share one, is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Hadoop keeps it; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; empty if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file of a checked size, wherever Hadoop keeps it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(data)
    finally:
        out.close()


def drop_partitions(spark: SparkSession, path: str, column: str, keep_from: str) -> list[str]:
    """Remove the folders ``column=value`` whose value, as text, sorts before ``keep_from``; their names. No file is read.

    A query that is running over a removed folder fails and has to be run again; later ones don't see it.
    """
    gone = [name for name in names_in(spark, path) if name.startswith(f"{column}=") and name.partition("=")[2] < keep_from]
    for name in gone:
        remove(spark, f"{path}/{name}")
    return gone


def drop_older(spark: SparkSession, path: str, column: str, keep_from: str, older: Column) -> list[str]:
    """Remove partitions before ``keep_from``, and of the one that is it the rows for which ``older`` holds.

    Kept partitions but that one aren't read. It is written again only if it holds such a row: from a
    stored copy, and put in place of the old one when all of it is written.
    """
    gone = drop_partitions(spark, path, column, keep_from)
    if f"{column}={keep_from}" not in names_in(spark, path):
        return gone
    edge = spark.read.option("basePath", path).parquet(f"{path}/{column}={keep_from}")
    if not edge.where(older).isEmpty():
        kept = checkpointed(edge.where(~older))
        if kept.isEmpty():
            remove(spark, f"{path}/{column}={keep_from}")
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Within it checkpoints are tables in a folder that is removed at the end, so a job that repeats for months leaves nothing behind.

    What is computed from them has to be written before.
    """
    folder = work_folder(spark)
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        remove(spark, folder)


def stored(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder: as a checkpoint, but compressed, and only the columns that are asked for are read."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage at a reliable checkpoint in the shared folder, or at a table in the scratch folder."""
    if (folder := _SCRATCH.get()) is not None:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
