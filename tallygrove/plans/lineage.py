"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: the context's, else the session's spark.checkpoint.dir.

    Where neither is set, a local master gets a new temporary folder; on a cluster that is an error, as its machines
    do not share such a folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read from there.

    Unlike checkpoint(), which computes its rows once to count and once to write them, this computes them
    once, and later reads take only the columns they need. The folder can be cleared after the job; discard()
    clears one table.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of checkpointed() that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table._written_at)


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, marked for a broadcast if it has at most so many rows, which a job counts; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
