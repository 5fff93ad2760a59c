"""Descriptive statistics; one scan for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import to_number
from ..plans.lineage import checkpointed
from .quantiles import per_value

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def per_column(df: DataFrame, columns: list[str], measures: dict[str, callable], key: str = "column") -> DataFrame:
    """A row for each column with measures(column), all from one aggregation."""
    if not columns:
        raise ValueError("no column to measure")
    sums = df.agg(*(F.struct(F.lit(c).alias(key), *(m(c).alias(n) for n, m in measures.items())).alias(f"c{k}") for k, c in enumerate(columns)))
    return sums.select(F.inline(F.array(*(f"c{k}" for k in range(len(columns))))))


def skew(c: Column) -> Column:
    """Bias-corrected skewness; null under three values, 0 without spread."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.when(F.stddev_pop(c) > 0, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0))


def excess_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null under four values, 0 without spread."""
    n = F.count(c).cast("double")
    corrected = ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n >= 4, F.when(F.stddev_pop(c) > 0, corrected).otherwise(0.0))


def numeric_core_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, median, mode, spread, quartiles and shape of each numeric column."""
    columns = columns or numeric_columns(df)
    x = lambda c: to_number(F.col(c))
    plain = per_column(
        df,
        columns,
        {
            "n": lambda c: F.count(x(c)),
            "mean": lambda c: F.avg(x(c)),
            "min": lambda c: F.min(x(c)),
            "max": lambda c: F.max(x(c)),
            "variance": lambda c: F.coalesce(F.var_samp(x(c)), F.lit(0.0)),
            "std": lambda c: F.coalesce(F.stddev_samp(x(c)), F.lit(0.0)),
            "skew": lambda c: skew(x(c)),
            "kurtosis": lambda c: excess_kurtosis(x(c)),
        },
    )
    values = {c: x(c) for c in columns}
    places = per_value(df, values, {"q1": 0.25, "median": 0.5, "q3": 0.75}, mode=True)
    whole = plain.join(F.broadcast(places), "column")
    return whole.select("column", "n", "mean", "median", "mode", "min", "max", (F.col("max") - F.col("min")).alias("range"), "variance", "std", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "skew", "kurtosis")


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max of each numeric column."""
    kept = ("column", "n", "mean", "std", "min", "q1", "median", "q3", "max")
    return numeric_core_stats(df, columns).select(*kept)


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text) for each row and column."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n commonest values with counts and shares; null counts as NaN."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("NaN")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.desc("count"), "value").limit(n).crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total")).alias("ratio"))


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: non-null count, distinct values, the commonest and its count."""
    counts = long_form(df, columns).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    best = F.max(F.struct("c", F.lit(0))).alias("m")
    sums = counts.groupBy("column").agg(F.sum("c").alias("count"), F.count(F.lit(1)).alias("unique"), best)
    top = counts.join(F.broadcast(sums.select("column", F.col("m.c").alias("freq"))), "column").where("c = freq").groupBy("column").agg(F.min("value").alias("top"))
    return sums.join(top, "column").select("column", "count", "unique", "top", F.col("m.c").alias("freq"))


def null_rates(df: DataFrame, top: int | None = 10) -> DataFrame:
    """Missing values by column, most first."""
    found = per_column(df, df.columns, {"missing": lambda c: F.count_if(F.col(c).isNull()), "rate": lambda c: F.avg(F.col(c).isNull().cast("int"))})
    ordered = found.orderBy(F.desc("missing"), "column")
    return ordered.limit(top) if top else ordered


def missing_pattern(df: DataFrame) -> DataFrame:
    """Rows by how many of their columns are missing."""
    return df.groupBy(sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)).alias("missing_columns")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_rows(df: DataFrame, few: int = 1_000_000) -> DataFrame:
    """rows, columns and duplicates (rows beyond the first of their kind).

    Two hashes of each row are counted, so 16 bytes a row are shuffled; rows are compared whole only where a pair of hashes repeats.
    """
    absent = F.array(*(F.col(f"`{c}`").isNull() for c in df.columns))  # hashes pass over nulls
    columns = [F.col(f"`{c}`") for c in df.columns]
    marks = [F.xxhash64(absent, *columns).alias("_h1"), F.xxhash64(F.lit(1), *columns, absent).alias("_h2")]
    kinds = df.select(*marks).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    again = checkpointed(kinds.where("n > 1").select("_h1", "_h2"))
    count = again.limit(few + 1).count()
    if count:
        held = F.broadcast(again) if count <= few else again
        same = df.select("*", *marks).join(held, ["_h1", "_h2"], "left_semi").groupBy(F.struct(*columns).alias("row")).agg(F.count(F.lit(1)).alias("n"))
        more = same.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    else:
        more = df.sparkSession.createDataFrame([(0,)], "duplicates long")
    return total.crossJoin(F.broadcast(more)).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "duplicates")


def dtype_summary(df: DataFrame) -> DataFrame:
    """How many columns there are of each kind of type."""
    kind = lambda t: "numeric" if isinstance(t, NUMERIC) else "boolean" if isinstance(t, T.BooleanType) else "datetime" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "text"
    names = [kind(f.dataType) for f in df.schema]
    return df.sparkSession.createDataFrame([(k, names.count(k)) for k in sorted(set(names))], "kind string, columns long")


def describe_warnings(df: DataFrame) -> list[str]:
    """What makes a description doubtful."""
    n, numeric = df.count(), numeric_columns(df)
    checks = [(n < 20, "Fewer than 20 rows."), (not numeric, "No numeric column."), (len(numeric) == len(df.columns), "No categorical column.")]
    return [text for wrong, text in checks if wrong]


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
