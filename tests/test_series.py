"""Fits of long series in ranges against folds over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import series


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    rows = [(key, f"{2000 + k // 336}-{1 + k // 28 % 12:02d}-{1 + k % 28:02d}", float(20 + 0.1 * k + 3 * (k % 4) + rng.normal())) for key, n in (("a", 200), ("b", 61), ("c", 13)) for k in range(n)]
    return spark.createDataFrame(rows, "key string, day string, y double").repartition(4)


def histories(df):
    out = {}
    for r in series.prepared(df, "day", "y", ["key"], 6).orderBy("k").collect():
        out.setdefault(r.key, ([], r.h))[0].append(r.y)
    return out


@pytest.mark.parametrize(("trend", "season", "size"), [("add", 4, 7), ("add", 0, 50), (None, 4, 1000), (None, 0, 3)])
def test_smoothing_in_ranges_equals_the_fold(made, monkeypatch, trend, season, size):
    monkeypatch.setattr(series, "RANGE", size)
    got = {}
    for r in series.forecast(made, "day", "y", ["key"], "exp_smoothing", 6, trend=trend, season=season).orderBy("step").collect():
        got.setdefault(r.key, []).append((r.actual, r.forecast))
    for key, (y, h) in histories(made).items():
        y = np.array(y)
        assert [a for a, _ in got[key]] == y[-h:].tolist()
        assert [f for _, f in got[key]] == pytest.approx(series.smoothed(y[:-h], h, trend, season).tolist(), rel=1e-9)


@pytest.mark.parametrize(("lags", "difference", "size"), [(3, 0, 10), (3, 1, 9), (5, 2, 1000), (2, 0, 4)])
def test_autoregression_in_ranges_equals_the_whole(made, monkeypatch, lags, difference, size):
    monkeypatch.setattr(series, "RANGE", size)
    got = {}
    for r in series.forecast(made, "day", "y", ["key"], "ar", 6, lags=lags, difference=difference).orderBy("step").collect():
        got.setdefault(r.key, []).append(r.forecast)
    for key, (y, h) in histories(made).items():
        assert got[key] == pytest.approx(series.autoregressed(np.array(y)[:-h], h, lags, difference).tolist(), rel=1e-9)


def test_series_without_keys_in_ranges(made, monkeypatch):
    monkeypatch.setattr(series, "RANGE", 11)
    one = made.where("key = 'a'").drop("key")
    y = np.array(histories(made)["a"][0])
    for model, want in (("exp_smoothing", series.smoothed(y[:-6], 6, "add", 0)), ("ar", series.autoregressed(y[:-6], 6, 3, 0))):
        assert [r.forecast for r in series.forecast(one, "day", "y", [], model, 6).orderBy("step").collect()] == pytest.approx(want.tolist(), rel=1e-9)
        assert series.forecast(one.where("false"), "day", "y", [], model, 6).count() == 0


def test_a_multiplicative_trend_is_a_fold(made):
    y, h = histories(made)["b"]
    found = series.forecast(made.where("key = 'b'"), "day", "y", ["key"], "exp_smoothing", 6, trend="mul").orderBy("step")
    assert [r.forecast for r in found.collect()] == pytest.approx(series.smoothed(np.array(y)[:-h], h, "mul", 0).tolist())


def test_ranges_of_a_long_series(spark):
    rows = spark.range(120_000).select(F.timestamp_seconds(F.col("id") * 3600).alias("at"), (F.sin(F.col("id") / 50) + F.col("id") / 1000).alias("y"))
    parts = series._ranged(series.prepared(rows, "at", "y"), 0, series.RANGE).groupBy("range").count().collect()
    assert sorted(r.range for r in parts) == [0, 1, 2] and max(r["count"] for r in parts) == series.RANGE
    found = [abs(r.actual - r.forecast) for r in series.forecast(rows, "at", "y", [], "ar", 6).collect()]
    assert len(found) == 6 and max(found) < 1e-3
