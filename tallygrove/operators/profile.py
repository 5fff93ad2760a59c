"""Column kinds, dataset profile and flags; blank text counts as missing here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_time, to_number
from .describe import duplicate_rows, long_form, numeric_columns, per_column
from .quantiles import per_value


def _filled(c: str) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit(""))


def column_kinds(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """numeric, dateLike or categorical: what at least threshold of a column's non-blank values parse as."""
    number = lambda c: F.when(_filled(c).isNotNull(), to_number(_filled(c)).isNotNull())
    date = lambda c: F.when(_filled(c).isNotNull(), F.coalesce(parse_time(_filled(c)).isNotNull(), F.lit(False)))
    hits = {
        "non_blank": lambda c: F.count(_filled(c)),
        "numeric_share": lambda c: F.coalesce(F.avg(number(c).cast("int")), F.lit(0.0)),
        "date_share": lambda c: F.coalesce(F.avg(date(c).cast("int")), F.lit(0.0)),
    }
    kind = F.when((F.col("non_blank") > 0) & (F.col("numeric_share") >= threshold), "numeric").when((F.col("non_blank") > 0) & (F.col("date_share") >= threshold), "dateLike").otherwise("categorical")
    return per_column(df, df.columns, hits).withColumn("kind", kind)


def numeric_by_rule(df: DataFrame, rule: str = "dtype") -> list[str]:
    """Numeric columns by type, or by the share of values that parse: rows60, nonnull60 or nonnull70."""
    if rule == "dtype":
        return numeric_columns(df)
    found = per_column(df, df.columns, {"parsed": lambda c: F.count(to_number(_filled(c))), "known": lambda c: F.count(_filled(c)), "rows": lambda c: F.count(F.lit(1))}).collect()
    least = {"rows60": lambda r: max(3, int(0.6 * r.rows)), "nonnull60": lambda r: max(1, 0.6 * r.known), "nonnull70": lambda r: max(1, 0.7 * r.known)}[rule]
    return [r.column for r in found if r.parsed >= least(r)]


def top_missing(df: DataFrame, k: int = 5) -> DataFrame:
    """Columns with blanks, by share in per cent."""
    found = per_column(df, df.columns, {"missing": lambda c: F.count_if(_filled(c).isNull()), "rate": lambda c: F.round(100 * F.avg(_filled(c).isNull().cast("int")), 1)})
    return found.where("missing > 0").orderBy(F.desc("rate"), "column").limit(k)


def top_outliers(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Columns with values beyond 1.5 interquartile ranges (8 values at least, and some spread), by share in per cent."""
    x = lambda c: to_number(_filled(c))
    limits = per_column(df, columns, {"n": lambda c: F.count(x(c))}).join(F.broadcast(per_value(df, {c: x(c) for c in columns}, {"q1": 0.25, "q3": 0.75})), "column").where("n >= 8 and q3 > q1")
    values = long_form(df, columns).select("column", to_number(F.nullif("value", F.lit(""))).alias("x"))
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col("x") < F.col("q1") - 1.5 * iqr) | (F.col("x") > F.col("q3") + 1.5 * iqr)
    found = values.join(F.broadcast(limits), "column").groupBy("column").agg(F.count_if(outside).alias("outliers"), F.round(100.0 * F.count_if(outside) / F.max("n"), 1).alias("rate"))
    return found.where("outliers > 0").orderBy(F.desc("rate"), "column").limit(k)


def imbalanced(df: DataFrame, columns: list[str], k: int = 5, least: float = 75.0) -> DataFrame:
    """Columns with 5 values and 2 levels at least whose commonest level has at least the share (per cent)."""
    counts = long_form(df, columns).where("value is not null and value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy("column").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("levels"), F.max("c").alias("most"))
    top = counts.join(F.broadcast(sums), "column").where("c = most").groupBy("column").agg(F.min("value").alias("top_value"), F.first("n").alias("n"), F.first("levels").alias("levels"), F.first("most").alias("most"))
    return top.withColumn("rate", F.round(100.0 * F.col("most") / F.col("n"), 1)).where((F.col("n") >= 5) & (F.col("levels") >= 2) & (F.col("rate") >= least)).orderBy(F.desc("rate"), "column").limit(k).select("column", "top_value", "rate")


def profile(df: DataFrame) -> DataFrame:
    """One row: sizes, counts by kind, and the top findings as arrays."""
    kinds = {r.column: r.kind for r in column_kinds(df).select("column", "kind").collect()}
    of = lambda kind: [c for c, k in kinds.items() if k == kind]
    row = duplicate_rows(df).select("rows", "columns", "duplicates", *(F.lit(len(of(k))).cast("long").alias(n) for k, n in (("numeric", "numeric"), ("categorical", "categorical"), ("dateLike", "date_like"))))
    listed = lambda frame: frame.agg(F.array_sort(F.collect_list(F.struct(*frame.columns))).alias("x"))
    parts = {"missing": top_missing(df).select("column", "rate")}
    if of("numeric"):
        parts["outliers"] = top_outliers(df, of("numeric")).select("column", "rate")
    if of("categorical"):
        parts["imbalanced"] = imbalanced(df, of("categorical"))
    for name, part in parts.items():
        row = row.crossJoin(F.broadcast(listed(part).withColumnRenamed("x", name)))
    return row


def flags(df: DataFrame, correlations: int = 0, warnings: list[str] = ()) -> DataFrame:
    """kind and severity of what a profile finds; clean if nothing.

    correlations is how many strong pairs of columns are known (rows of corr(), say), warnings what reports have said.
    """
    facts = profile(df)
    rate = lambda c: F.array_max(F.transform(c, lambda x: x["rate"]))
    rules = [F.when(F.col("duplicates") > 0, F.struct(F.lit("duplicate").alias("kind"), F.lit("medium").alias("severity")))]
    for name, kind, high in (("missing", "missing", 20), ("outliers", "outlier", 10), ("imbalanced", "imbalance", 90)):
        if name in facts.columns:
            rules.append(F.when(F.size(name) > 0, F.struct(F.lit(kind).alias("kind"), F.when(rate(F.col(name)) >= high, "high").otherwise("medium").alias("severity"))))
    rules += [F.struct(F.lit(kind).alias("kind"), F.lit("medium").alias("severity")) for kind, known in (("correlation", correlations), ("warning", len(warnings))) if known]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    clean = F.array(F.struct(F.lit("clean").alias("kind"), F.lit("low").alias("severity")))
    return facts.select(F.inline(F.when(F.size(found) > 0, found).otherwise(clean)))
