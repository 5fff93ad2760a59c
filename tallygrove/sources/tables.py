"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV (with header), JSON-lines or Parquet table, by the path's ending."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return spark.read.options(header=True, inferSchema=True, **options).csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.options(**options).json(path)
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    raise ValueError(f"no reader for .{kind}")


def blank_filled(df: DataFrame) -> DataFrame:
    """All columns as text, null as empty."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def from_json_rows(df: DataFrame, column: str, schema: str, keep: list[str] = ()) -> DataFrame:
    """The rows of a column that holds JSON arrays of objects, with the columns to keep."""
    return df.select(*keep, F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, fit for JSON."""
    real = (T.DoubleType, T.FloatType)
    return df.select(*(finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name) for f in df.schema))


def write_json_lines(df: DataFrame, path: str) -> None:
    without_nan(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest key."""
    return df.orderBy(key).limit(n)


def append_usage(df: DataFrame, path: str, time_col: str = "created_at") -> None:
    """Usage rows added to a table partitioned by day."""
    df.withColumn("day", F.to_date(time_col)).write.mode("append").partitionBy("day").parquet(path)
