"""Places, ranks and order statistics at scale: values are counted first, and counts are summed over ranges of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed, if_few


def cumulated(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """counts (keys, value, n and more; no nulls) with upto and total: the rows of its keys up to and with the value, and all of them.

    Rows are dealt to ranges by keys and value, so neither a large group nor the whole table is in one task. What comes before
    a range is a sum over the few rows that describe ranges. A value can have several rows.
    """
    ranged = checkpointed(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    parts = ranged.groupBy("_p", *keys).agg(F.sum(n).alias("_n"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # as many rows as ranges
    before = F.coalesce(F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = checkpointed(parts.select("_p", *keys, before.alias("_b"), F.sum("_n").over(own).alias("total")))
    running = F.sum(n).over(Window.partitionBy("_p", *keys).orderBy(value))
    rows = ranged.join(if_few(parts), ["_p", *keys])
    return rows.withColumn("upto", F.col("_b") + running).drop("_p", "_b")


def quantiles_by(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], **more: Column) -> DataFrame:
    """keys, n and the interpolated quantiles of each group's values under the names in shares, as percentile() gives them.

    more: aggregates over value and n, the counted values of a group. Null and NaN values don't count.
    """
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    placed_counts = cumulated(counts, keys, value)
    at = {name: (F.col("total") - 1) * F.lit(float(p)) for name, p in shares.items()}
    holds = lambda place: (place < F.col("upto")) & (place >= F.col("upto") - F.col("n"))
    ends = [F.max(F.when(holds(f(at[name])), F.col(value))).alias(f"_{side}{k}") for k, name in enumerate(shares) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = placed_counts.groupBy(*keys).agg(F.max("total").alias("_total"), *ends, *(c.alias(name) for name, c in more.items())).withColumnRenamed("_total", "total")
    mixed = {}
    for k, name in enumerate(shares):
        low, high, part = F.col(f"_lo{k}"), F.col(f"_hi{k}"), at[name] - F.floor(at[name])
        mixed[name] = F.when(low == high, low).otherwise((1 - part) * low + part * high)
    return found.select(*keys, F.col("total").alias("n"), *(c.alias(name) for name, c in mixed.items()), *more)


def tied_ranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """counts with ties (rows with the value) and rank (average) of the value among all rows; a value can have several rows."""
    rows = cumulated(counts, [], value, n).withColumn("ties", F.sum(n).over(Window.partitionBy(value)))
    return rows.withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2).drop("upto", "total")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, ties and rank (average) of each distinct value."""
    return tied_ranks(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value).select(value, "ties", "rank")


def ranked(df: DataFrame, value: str) -> DataFrame:
    """df with rank and ties of each row's value."""
    return df.join(average_ranks(df, value), value)


def placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with place, from 0, in the order; number of rows). Rows are dealt to ranges, and each range begins where those before it end."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())  # one row a partition
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    begin = ranged.sparkSession.createDataFrame(begins, "_p int, _b long")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.join(F.broadcast(begin), "_p").withColumn("place", F.col("_b") + within).drop("_p", "_b"), total


def evenly(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n rows with places, at most so many (2 at least), evenly spaced from the first to the last."""
    if n <= most:
        return rows
    step = F.expr(f"(place * {most - 1}L + {n - 2}L) div {n - 1}L")  # the first step whose place isn't before this one
    return rows.where((step * F.lit(n - 1)) - F.pmod(step * F.lit(n - 1), F.lit(most - 1)) == F.col("place") * (most - 1))


def thinned(df: DataFrame, order: list[str], most: int = 1200) -> DataFrame:
    """At most so many rows (2 at least), evenly spaced in the order from the first to the last."""
    return evenly(*placed(df, order), most).drop("place")


def permuted(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudo-random bijection of 0 to n - 1: a Feistel network over a power of 4, walked on until it is back in the range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            mixed = right + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        return left << np.uint64(half) | right

    x = once(place.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)
