"""Structured Streaming over heartbeat and usage folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import service
from ..plans.lineage import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def session_stream(heartbeats: DataFrame, key: str, time: str, ttl: str = "300 seconds", late: str = "300 seconds") -> DataFrame:
    """Sessions from a stream; a session is put out when the watermark has passed its end."""
    return service.sessions(heartbeats, key, time, ttl, late)


def usage_stream(log: DataFrame, time: str = "created_at", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return service.usage_rollup(log, time, window, late)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream puts out for all input that is there, written to and read from the shared folder."""
    folder = f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def append_batches(stream: DataFrame, path: str, time: str = "created_at") -> None:
    """Each batch appended to a table partitioned by day; a batch that is repeated replaces its own files."""
    folder = f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date(time)).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
