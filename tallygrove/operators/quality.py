"""Missing values, outliers and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamped, to_number
from .describe import null_rates, numeric_columns, per_column
from .quantiles import per_value


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns or df.columns)


def known_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that exist, in the order named."""
    return df.select(*(c for c in columns if c in df.columns))


def any_missing(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Whether a row lacks one of the columns."""
    return sum((F.col(c).isNull().cast("int") for c in columns or df.columns), F.lit(0)) > 0


def large_groups(df: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Rows of groups with at least so many rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(sizes.select(group), group, "left_semi")


def missing_by_column(df: DataFrame) -> DataFrame:
    return null_rates(df, None)


def bounds(df: DataFrame, columns: list[str] | None = None, iqr_k: float = 1.5, z: float = 3.0, least: int = 5) -> DataFrame:
    """Per column: n, mean, sd and the limits by quartiles and by standard deviations; null under least values."""
    x = lambda c: to_number(F.col(c))
    columns = columns or numeric_columns(df)
    found = per_column(df, columns, {"n": lambda c: F.count(x(c)), "mean": lambda c: F.avg(x(c)), "sd": lambda c: F.stddev_samp(x(c))})
    found = found.join(F.broadcast(per_value(df, {c: x(c) for c in columns}, {"q1": 0.25, "q3": 0.75})), "column")
    enough = lambda e: F.when(F.col("n") >= least, e)
    spread = F.coalesce(F.col("sd"), F.lit(0.0))
    return found.select(
        "column", "n",
        enough(F.col("q1") - iqr_k * (F.col("q3") - F.col("q1"))).alias("iqr_low"), enough(F.col("q3") + iqr_k * (F.col("q3") - F.col("q1"))).alias("iqr_high"),
        enough(F.col("mean") - z * spread).alias("z_low"), enough(F.col("mean") + z * spread).alias("z_high"),
    )


def outlier_summary(df: DataFrame, columns: list[str] | None = None, iqr_k: float = 1.5, z: float = 3.0) -> DataFrame:
    """bounds, with how many values lie outside them: the bounds' rows are broadcast to a second scan."""
    columns = columns or numeric_columns(df)
    limits = bounds(df, columns, iqr_k, z)
    values = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), to_number(F.col(c)).alias("x")) for c in columns))))
    outside = lambda kind: F.count_if((F.col("x") < F.col(f"{kind}_low")) | (F.col("x") > F.col(f"{kind}_high")))
    counts = values.join(F.broadcast(limits), "column").groupBy("column").agg(outside("iqr").alias("iqr"), outside("z").alias("z"))
    count = lambda kind: F.when(F.col(f"{kind}_low").isNotNull(), F.coalesce(F.col(kind), F.lit(0))).alias(f"{kind}_outliers")
    return limits.join(counts, "column", "left").select(*limits.columns, count("iqr"), count("z"))


def quality_process(df: DataFrame, strategy: str = "exclude", method: str = "iqr", columns: list[str] | None = None, iqr_k: float = 1.5, z: float = 3.0, drop_missing: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, one-row summary): rows outside the bounds are left out, or values clipped to them.

    Missing rows are dropped, by default with exclude only. The bounds are those of the rows as given,
    also for the outliers counted afterwards.
    """
    if strategy not in ("exclude", "winsorize") or method not in ("iqr", "zscore"):
        raise ValueError("strategy is exclude or winsorize, method iqr or zscore")
    drop_missing = strategy == "exclude" if drop_missing is None else drop_missing
    iqr_k, z = clamped(iqr_k, 0.1, 10.0, 1.5), clamped(z, 0.5, 10.0, 3.0)
    columns = columns or numeric_columns(df)
    kind = "iqr" if method == "iqr" else "z"
    limits = {r["column"]: r for r in bounds(df, columns, iqr_k, z).collect()}  # one row a column
    low, high = ({c: limits[c][f"{kind}_{side}"] for c in columns} for side in ("low", "high"))
    known = [c for c in columns if low[c] is not None]
    outlier = lambda c: F.coalesce((to_number(F.col(c)) < low[c]) | (to_number(F.col(c)) > high[c]), F.lit(False))
    any_out = lambda: sum((outlier(c).cast("int") for c in known), F.lit(0))
    missing = lambda: any_missing(df)
    cleaned = df.where(~missing()) if drop_missing else df
    if strategy == "exclude":
        cleaned = cleaned.where(any_out() == 0)
    else:
        cleaned = cleaned.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(low[c]), F.least(F.lit(high[c]), to_number(F.col(c))))) for c in known})
    measure = lambda frame, when: frame.agg(F.count(F.lit(1)).alias(f"rows_{when}"), F.count_if(missing()).alias(f"missing_{when}"), F.coalesce(F.sum(any_out()), F.lit(0)).cast("long").alias(f"outliers_{when}"))
    both = measure(df, "before").crossJoin(F.broadcast(measure(cleaned, "after")))
    deltas = [(F.col(f"{n}_after") - F.col(f"{n}_before")).alias(f"{n}_delta") for n in ("rows", "missing", "outliers")]
    return cleaned, both.select("*", *deltas)
