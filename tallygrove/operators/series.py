"""Forecasts of many series at once; a series is what shares the keys.

Fits of long series are scans in parallel. A series is cut in ranges of places. Smoothing with fixed weights and without a multiplicative trend moves its state
by an affine map at each value, and maps compose: a task makes its range's map for all weights of the grid and the sum of squared errors as
a quadratic form of the state that the range begins with; these are then chained. An autoregression is the triangular factor of its lagged values, and
factors of ranges are factored together again. So no task holds a series, but for a multiplicative trend, whose steps aren't affine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import parse_time, to_number
from .ranks import placed


def prepared(df: DataFrame, time: str, target: str, keys: list[str] = (), horizon: int = 12, least: int = 12) -> DataFrame:
    """keys, t, y, k (place from 0), n, h: times that parse, in order, of series with enough rows; h is the tail held out."""
    at = F.col(time) if dict(df.dtypes)[time].startswith(("timestamp", "date")) else parse_time(F.col(time))
    rows = df.select(*keys, at.alias("t"), to_number(F.col(target)).alias("y")).where("t is not null and y is not null")
    if keys:
        w = Window.partitionBy(*keys)
        rows = rows.withColumns({"k": F.row_number().over(w.orderBy("t", "y")) - 1, "n": F.count(F.lit(1)).over(w)})
    else:  # one series: places by ranges of time, not by a window over all rows
        rows, n = placed(rows, ["t", "y"])
        rows = rows.withColumnRenamed("place", "k").withColumns({"k": F.col("k").cast("int"), "n": F.lit(n).cast("long")})
    h = F.when(F.lit(horizon) < F.col("n"), F.lit(horizon)).otherwise(F.floor(F.col("n") / 3).cast("int"))
    return rows.where(F.col("n") >= least).withColumn("h", h)


def forecast(df: DataFrame, time: str, target: str, keys: list[str] = (), model: str = "naive", horizon: int = 12, window: int = 7, trend: str | None = "add", season: int = 0, lags: int = 3, difference: int = 0) -> DataFrame:
    """keys, step (from 1), actual, forecast of each series' held-out tail.

    naive and seasonal_naive repeat the last value; moving_avg averages the last window of values and its own
    forecasts; exp_smoothing and ar are fitted on each series' history.
    """
    rows = prepared(df, time, target, list(keys), horizon)
    if model in ("naive", "seasonal_naive", "moving_avg"):
        width = 1 if model != "moving_avg" else max(2, int(window))
        split = rows.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.when((F.col("k") < F.col("n") - F.col("h")) & (F.col("k") >= F.col("n") - F.col("h") - width), F.struct("k", "y")))).alias("_past"),
            F.array_sort(F.collect_list(F.when(F.col("k") >= F.col("n") - F.col("h"), F.struct("k", "y")))).alias("_tail"),
        )
        step = lambda acc, _: F.concat(acc, F.array(F.aggregate(F.slice(acc, -F.least(F.lit(width), F.size("_past")), F.least(F.lit(width), F.size("_past"))), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(width), F.size("_past"))))
        past = F.transform("_past", lambda r: r["y"])
        made = F.aggregate(F.sequence(F.lit(1), F.size("_tail")), past, step)
        future = F.slice(made, F.size("_past") + 1, F.size("_tail"))
        pairs = F.arrays_zip(F.transform("_tail", lambda r: r["y"]).alias("actual"), future.alias("forecast"))
        return split.select(*keys, F.posexplode(pairs).alias("_i", "_p")).select(*keys, (F.col("_i") + 1).cast("int").alias("step"), F.col("_p")["actual"].alias("actual"), F.col("_p")["forecast"].alias("forecast"))
    if model == "ar":
        return _autoregressed(rows, list(keys), lags, difference)
    if trend != "mul":
        return _smoothed(rows, list(keys), trend, season)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        y, h = frame["y"].to_numpy(), int(frame["h"].iloc[0])
        out = pd.DataFrame({"step": np.arange(1, h + 1, dtype=np.int32), "actual": y[-h:], "forecast": smoothed(y[:-h], h, trend, season)})
        for c in keys:
            out[c] = frame[c].iloc[0]
        return out

    return _by_series(rows, keys).applyInPandas(run, _schema(rows, keys))


RANGE = 50_000  # values of a series in a task


def _schema(rows: DataFrame, keys: list[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(["step int", "actual double", "forecast double", *(f"`{c}` {types[c]}" for c in keys)])


def _by_series(rows: DataFrame, keys: list[str], *more: str):
    return rows.withColumn("_all", F.lit(0)).groupBy("_all", *keys, *more)


def _ranged(rows: DataFrame, overlap: int, size: int) -> DataFrame:
    """rows of the history with range; each range also has the last values before it, so many."""
    own = F.floor(F.col("k") / size).cast("long")
    past = rows.where(F.col("k") < F.col("n") - F.col("h"))
    if not overlap:
        return past.withColumn("range", own)
    reach = F.floor((F.col("k") + overlap) / size).cast("long")
    last = F.floor((F.col("n") - F.col("h") - 1) / size).cast("long")
    return past.withColumn("range", F.explode(F.sequence(own, F.least(reach, last))))


def _tails(rows: DataFrame, keys: list[str], past: int) -> DataFrame:
    """For each series its held-out values and the last of its history, in order, as arrays tail and past."""
    edge = F.col("n") - F.col("h")
    pairs = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("k", "y")))), lambda r: r["y"])
    near = rows.where(F.col("k") >= edge - past)
    return near.groupBy(*keys).agg(pairs(F.col("k") >= edge).alias("tail"), pairs(F.col("k") < edge).alias("past"), F.max("n").alias("n"), F.max("h").alias("h")).where("n is not null")


GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def _weights(trend: str | None, season: int) -> np.ndarray:
    """(level, trend, season) weights of the grid, in the order in which ties are resolved."""
    return np.array([(a, b, g) for a in GRID for b in (GRID if trend else (0.0,)) for g in (GRID if season > 1 else (0.0,))])


def smoothing_map(y: np.ndarray, first: int, weights: np.ndarray, trend: bool, season: int) -> tuple[np.ndarray, np.ndarray]:
    """What a range of values, from place first on, does to a state (level, slope, cycle) for all weights.

    The state has a last entry 1. Returned are the maps (weights, d, d) and forms (weights, d, d), of which s.F.s is the sum of squared errors
    of a range that begins with state s.
    """
    m, d = len(weights), 3 + max(1, season)
    a, b, g = weights.T
    state, form = np.tile(np.eye(d), (m, 1, 1)), np.zeros((m, d, d))
    for k, v in enumerate(y.tolist(), first):
        cycle = state[:, 2 + k % max(1, season)].copy()
        ahead = state[:, 0] + state[:, 1]
        off = -(ahead + cycle)
        off[:, -1] += v
        if k:
            form += off[:, :, None] * off[:, None, :]
        new = (1 - a)[:, None] * ahead - a[:, None] * cycle
        new[:, -1] += a * v
        if trend:
            state[:, 1] = b[:, None] * (new - state[:, 0]) + (1 - b)[:, None] * state[:, 1]
        if season > 1:
            mixed = (1 - g)[:, None] * cycle - g[:, None] * new
            mixed[:, -1] += g * v
            state[:, 2 + k % season] = mixed
        state[:, 0] = new
    return state, form


def _smoothed(rows: DataFrame, keys: list[str], trend: str | None, season: int, size: int | None = None) -> DataFrame:
    size = size or RANGE
    weights, width = _weights(trend, season), max(1, season)

    def mapped(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        state, form = smoothing_map(frame["y"].to_numpy(), int(frame["k"].iloc[0]), weights, bool(trend), season)
        out = pd.DataFrame({"range": [frame["range"].iloc[0]], "map": [state.ravel()], "form": [form.ravel()]})
        return out.assign(**{c: frame[c].iloc[0] for c in keys})

    types = dict(rows.dtypes)
    named = "".join(f", `{c}` {types[c]}" for c in keys)
    maps = _by_series(_ranged(rows, 0, size), keys, "range").applyInPandas(mapped, "range long, map array<double>, form array<double>" + named)
    chained = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("range", "map", "form"))).alias("ranges"))  # a row a range
    begin = rows.where(F.col("k") < width).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda r: r["y"]).alias("begin"))
    ends = _tails(rows, keys, 1)

    def forecasts(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                d, y, h, n = 3 + width, np.asarray(row["begin"]), int(row["h"]), int(row["n"])
                start = np.zeros(d)
                start[0], start[-1] = y[0], 1.0
                if season > 1 and n - h > season:
                    start[2 : 2 + season] = y[:season] - y[:season].mean()
                state, error = np.tile(start, (len(weights), 1)), np.zeros(len(weights))
                for part in row["ranges"]:
                    maps_, forms = (np.asarray(part[c]).reshape(-1, d, d) for c in ("map", "form"))
                    error += np.einsum("mi,mij,mj->m", state, forms, state)
                    state = np.einsum("mij,mj->mi", maps_, state)
                best = state[int(np.argmin(np.round(error, 9)))]
                steps = np.arange(1, h + 1)
                made = best[0] + best[1] * steps + np.array([best[2 + (n - h + s) % width] for s in range(h)])
                out.append(pd.DataFrame({"step": steps.astype(np.int32), "actual": np.asarray(row["tail"]), "forecast": made} | {c: row[c] for c in keys}))
            if out:
                yield pd.concat(out)

    joined = ends.join(chained, keys).join(begin, keys) if keys else ends.crossJoin(F.broadcast(chained)).crossJoin(F.broadcast(begin))  # one row each
    return joined.mapInPandas(forecasts, _schema(rows, keys))


def _autoregressed(rows: DataFrame, keys: list[str], lags: int, difference: int, size: int | None = None) -> DataFrame:
    size = size or RANGE

    def factor(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        at = int(frame["range"].iloc[0]) * size
        n, h = (int(frame[c].iloc[0]) for c in "nh")
        x = np.diff(frame["y"].to_numpy(float), difference) if difference else frame["y"].to_numpy(float)
        p = max(1, min(lags, (n - h - difference) // 3))
        wanted = np.arange(max(0, at - int(frame["k"].iloc[0]) - difference, p), len(x))  # values that aren't earlier ranges'
        table = np.column_stack([np.ones(len(wanted)), *(x[wanted - j - 1] for j in range(p)), x[wanted]])
        r = np.linalg.qr(table, mode="r") if len(table) else np.zeros((0, p + 2))
        return pd.DataFrame({"range": [frame["range"].iloc[0]], "r": [r.ravel()]}).assign(**{c: frame[c].iloc[0] for c in keys})

    types = dict(rows.dtypes)
    named = "".join(f", `{c}` {types[c]}" for c in keys)
    factors = _by_series(_ranged(rows, lags + difference, size), keys, "range").applyInPandas(factor, "range long, r array<double>" + named)
    stacked = factors.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("range", "r"))), lambda f: f["r"])).alias("r"))
    ends = _tails(rows, keys, lags + difference)

    def forecasts(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                h, n = int(row["h"]), int(row["n"])
                p = max(1, min(lags, (n - h - difference) // 3))
                r = np.linalg.qr(np.asarray(row["r"]).reshape(-1, p + 2), mode="r")
                coef = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
                last, x = [], np.asarray(row["past"], float)
                for _ in range(difference):
                    last.append(x[-1])
                    x = np.diff(x)
                past = list(x)
                for _ in range(h):
                    past.append(float(coef[0] + sum(c * past[-j - 1] for j, c in enumerate(coef[1:]))))
                made = np.array(past[len(x) :])
                for end in reversed(last):
                    made = end + np.cumsum(made)
                out.append(pd.DataFrame({"step": np.arange(1, h + 1, dtype=np.int32), "actual": np.asarray(row["tail"]), "forecast": made} | {c: row[c] for c in keys}))
            if out:
                yield pd.concat(out)

    joined = ends.join(stacked, keys) if keys else ends.crossJoin(F.broadcast(stacked))  # one row each
    return joined.mapInPandas(forecasts, _schema(rows, keys))


def history_tail(df: DataFrame, time: str, target: str, keys: list[str] = (), horizon: int = 12, most: int = 20) -> DataFrame:
    """keys, t, y: the last values of each series that a forecast's plot begins with, held-out ones among them."""
    return prepared(df, time, target, list(keys), horizon).where(F.col("k") >= F.col("n") - most).select(*keys, "t", "y")


def held_out_times(df: DataFrame, time: str, target: str, keys: list[str] = (), horizon: int = 12) -> DataFrame:
    """keys, step (from 1), t: the times of a forecast's steps."""
    rows = prepared(df, time, target, list(keys), horizon)
    return rows.where(F.col("k") >= F.col("n") - F.col("h")).select(*keys, (F.col("k") - F.col("n") + F.col("h") + 1).cast("int").alias("step"), "t")


def smoothed(y: np.ndarray, h: int, trend: str | None, season: int) -> np.ndarray:
    """Exponential smoothing with an optional additive or multiplicative trend and additive season; the weights by grid search."""
    best, grid = (np.inf, None), (0.1, 0.3, 0.5, 0.7, 0.9)
    for a in grid:
        for b in grid if trend else (0.0,):
            for g in grid if season > 1 else (0.0,):
                level, slope = y[0], (1.0 if trend == "mul" else 0.0)
                cycle = list(y[:season] - y[:season].mean()) if season > 1 and len(y) > season else [0.0] * max(1, season)
                error = 0.0
                for k, v in enumerate(y):
                    c = cycle[k % len(cycle)]
                    ahead = level * slope if trend == "mul" else level + slope
                    error += (v - ahead - c) ** 2 if k else 0.0
                    new = a * (v - c) + (1 - a) * ahead
                    if trend == "mul":
                        slope = b * (new / level if level else 1.0) + (1 - b) * slope
                    elif trend:
                        slope = b * (new - level) + (1 - b) * slope
                    if season > 1:
                        cycle[k % len(cycle)] = g * (v - new) + (1 - g) * c
                    level = new
                if error < best[0]:
                    steps = np.arange(1, h + 1)
                    base = level * slope**steps if trend == "mul" else level + slope * steps
                    best = (error, base + np.array([cycle[(len(y) + s) % len(cycle)] for s in range(h)]))
    return best[1] if best[1] is not None else np.repeat(y[-1], h)


def autoregressed(y: np.ndarray, h: int, lags: int, difference: int) -> np.ndarray:
    """An autoregression of the (differenced) values by least squares, continued on its own forecasts."""
    ends, x = [], y.astype(float)
    for _ in range(difference):
        ends.append(x[-1])
        x = np.diff(x)
    p = max(1, min(lags, len(x) // 3))
    design = np.column_stack([np.ones(len(x) - p), *(x[p - j - 1 : len(x) - j - 1] for j in range(p))])
    coef = np.linalg.lstsq(design, x[p:], rcond=None)[0]
    past = list(x)
    for _ in range(h):
        past.append(float(coef[0] + sum(c * past[-j - 1] for j, c in enumerate(coef[1:]))))
    out = np.array(past[len(x) :])
    for end in reversed(ends):
        out = end + np.cumsum(out)
    return out


def forecast_metrics(forecasts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """n, mae, rmse, mape (a ratio, over actuals that aren't 0), q05 and q95 of the residuals, by series.

    q05 and q95 are residuals at the place 5 and 95 % of the way, rounded; a series' forecasts are its held-out tail.
    """
    e = F.col("actual") - F.col("forecast")
    share = F.when(F.abs("actual") > 1e-9, F.abs(e / F.col("actual")))
    return forecasts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(share).alias("mape"), *(F.array_sort(F.collect_list(e))[F.bround((F.count(e) - 1) * p).cast("int")].alias(n) for p, n in ((0.05, "q05"), (0.95, "q95"))))
