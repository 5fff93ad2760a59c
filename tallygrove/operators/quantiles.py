"""Exact order statistics of whole columns without gathering a column's values in one task.

A sketch narrows each wanted place to an interval of values, a scan counts what lies below and inside it, and so on
until an interval holds few rows. Only rows inside the last intervals are shuffled, as counts of distinct values, and
their running sums give the values. The driver sees a few numbers for each column and place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles_by

FEW, ACCURACY = 200_000, 2000  # rows of an interval that is not narrowed further; 1 / rank error of the sketch


class _Interval:
    def __init__(self, k: int, place: int, low: float, high: float, below: int, within: int):
        self.k, self.place, self.low, self.high, self.below, self.within = k, place, low, high, below, within

    def holds(self, v: Column) -> Column:
        return (v >= self.low) & (v <= self.high)


def values_at(df: DataFrame, values: dict[str, Column], places: Callable[[int], list[int]]) -> dict[str, tuple[int, list[float]]]:
    """For each value its count n and the values at places(n), from 0, in ascending order; nulls and NaN don't count.

    Repeated values fill as many places; without values the list is empty.
    """
    names = list(values)
    x = [F.col(f"v{k}") for k in range(len(names))]
    rows = df.select(*(F.nanvl(values[n].cast("double"), F.lit(None).cast("double")).alias(f"v{k}") for k, n in enumerate(names)))
    facts = rows.agg(*(f(c) for c in x for f in (F.count, F.min, F.max))).first()
    sizes = [facts[3 * k] for k in range(len(names))]
    wanted = [_Interval(k, p, facts[3 * k + 1], facts[3 * k + 2], 0, sizes[k]) for k in range(len(names)) if sizes[k] for p in sorted(set(places(sizes[k])))]
    while wide := [t for t in wanted if t.within > FEW and t.low < t.high]:
        _narrowed(rows, x, wide)
    found = _picked(rows, x, wanted)
    return {n: (sizes[k], [found[k, p] for p in places(sizes[k])] if sizes[k] else []) for k, n in enumerate(names)}


def _narrowed(rows: DataFrame, x: list[Column], wide: list[_Interval]) -> None:
    spans: dict[tuple, list[_Interval]] = {}
    for t in wide:
        spans.setdefault((t.k, t.low, t.high), []).append(t)
    shares = lambda t: [min(1.0, max(0.0, (t.place - t.below + 0.5) / t.within + side * 2 / ACCURACY)) for side in (-1, 1)]
    sketches = rows.agg(*(F.percentile_approx(F.when(own[0].holds(x[k]), x[k]), F.array(*(F.lit(p) for t in own for p in shares(t))), F.lit(ACCURACY)) for (k, _, _), own in spans.items())).first()
    cuts = {id(t): (sketch[2 * i], sketch[2 * i + 1]) for sketch, own in zip(sketches, spans.values(), strict=True) for i, t in enumerate(own)}
    counts = rows.agg(*(F.count_if(c) for t in wide for low, high in [cuts[id(t)]] for c in (x[t.k] < low, x[t.k] <= high))).first()
    for i, t in enumerate(wide):
        (low, high), under, upto = cuts[id(t)], counts[2 * i], counts[2 * i + 1]
        if under <= t.place < upto and upto - under < t.within:
            t.low, t.high, t.below, t.within = low, high, under, upto - under
        else:  # equal values fill the interval, which the last step counts as one
            t.within = 0


def _picked(rows: DataFrame, x: list[Column], wanted: list[_Interval]) -> dict[tuple[int, int], float]:
    if not wanted:
        return {}
    spans: dict[tuple, list[_Interval]] = {}
    for t in wanted:
        spans.setdefault((t.k, t.low, t.high), []).append(t)
    cells = F.filter(F.array(*(F.when(own[0].holds(x[k]), F.struct(F.lit(i).alias("i"), x[k].alias("v"))) for i, ((k, _, _), own) in enumerate(spans.items()))), lambda c: c.isNotNull())
    counted = rows.select(F.inline(cells)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
    running = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("i").orderBy("v")))
    asked = rows.sparkSession.createDataFrame([(i, t.k, t.place, t.place - t.below) for i, own in enumerate(spans.values()) for t in own], "i int, k int, place long, at long")
    hit = running.join(F.broadcast(asked), "i").where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return {(r.k, r.place): r.v for r in hit.select("k", "place", "v").collect()}


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """The interpolated quantiles of each value, as percentile() gives them; null without values."""
    around = lambda n: [f(p * (n - 1)) for p in shares for f in (math.floor, math.ceil)]
    out = {}
    for name, (n, found) in values_at(df, values, around).items():
        mixed = []
        for i, p in enumerate(shares if n else ()):
            at, (low, high) = p * (n - 1), found[2 * i : 2 * i + 2]
            mixed.append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
        out[name] = mixed or [None] * len(shares)
    return out


def melted(df: DataFrame, values: dict[str, Column], key: str = "column") -> DataFrame:
    """key and v: a row for each row and value."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(n).alias(key), c.cast("double").alias("v")) for n, c in values.items()))))


def per_value(df: DataFrame, values: dict[str, Column], shares: dict[str, float], key: str = "column", mode: bool = False) -> DataFrame:
    """A row for each value with its quantiles under the names of shares, and its mode (of ties the smallest), from one table of counts."""
    more = {"mode": -F.max(F.struct("n", (-F.col("v")).alias("m")))["m"]} if mode else {}
    found = quantiles_by(melted(df, values, key), [key], "v", shares, **more).drop("n")
    names = df.sparkSession.createDataFrame([(n,) for n in values], f"`{key}` string")
    return names.join(found, key, "left")


def rounded_place(n: int, share: float) -> int:
    """The place at share of the way, rounded half to even."""
    return max(0, min(n - 1, round((n - 1) * share)))
