"""Bounded samples that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import unused


def hashed_sample(df: DataFrame, order: Column, n: int, total: int) -> DataFrame:
    """n of total rows (all, if there are fewer), those with the smallest hashes.

    Where hashes are spread, a narrow band of about 4 n rows is cut before the sort, so tasks don't each send n rows to
    be merged. Where few keys make up the rows, so that the band holds fewer than n, all rows are sorted.
    """
    place = unused("_order", df.columns)
    rows = df.withColumn(place, order)
    if total > 4 * n:
        band = rows.where(F.pmod(place, F.lit(1 << 40)) < int(4 * n / total * (1 << 40)))
        rows = band if band.count() >= n else rows
    return rows.orderBy(place, *df.columns).limit(n).drop(place)
