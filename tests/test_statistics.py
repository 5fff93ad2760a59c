"""Operators on small fixtures: values, guards, invariants and partition invariance."""

import json
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import scalar
from tallygrove.operators import chart, compare, describe, learning, manifest, ols, profile, quality, quantiles, ranks, recommend, series, service, tests_param, tests_rank
from tallygrove.plans import report
from tallygrove.sources import tables
from tallygrove.streaming import locks, usage


@pytest.fixture(scope="module")
def two_groups(spark):
    return spark.createDataFrame([(v, g) for i in range(30) for v, g in ((i + 1, "A"), (i + 8, "B"))], "v long, g string")


@pytest.fixture(scope="module")
def three_groups(spark):
    return spark.createDataFrame([(b + i % 5, g) for b, g in ((10, "G1"), (20, "G2"), (30, "G3")) for i in range(24)], "v long, g string")


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame([(1, 5, "A"), (2, 6, "A"), (3, 7, "B"), (200, 8, "B"), (None, 9, "B"), (4, None, "A")], "x long, y long, g string")


def test_ttest(two_groups):
    r = tests_param.ttest(two_groups, "v", "g").first()
    assert r.t == pytest.approx(-3.0802, abs=1e-3)
    assert r.d_low < r.cohen_d < r.d_high and 0 < r.p < 0.01


def test_ttest_warns(three_groups):
    assert tests_param.ttest(three_groups, "v", "g").first().warning


def test_mannwhitney_sums(two_groups):
    r = tests_rank.mannwhitney(two_groups, "v", "g").first()
    assert r.u + r.u_other == r.n_a * r.n_b == 900
    assert r.u == sum((a > b) + 0.5 * (a == b) for a in range(1, 31) for b in range(8, 38))


def test_anova_partitions_of_sums(three_groups):
    for n in (1, 4, 17):
        r = tests_param.anova(three_groups.repartition(n), "v", "g").first()
        total = three_groups.agg(F.var_pop("v") * F.count("v")).first()[0]
        assert r.ss_between + r.ss_within == pytest.approx(total)
        assert r.p < 1e-10


def test_anova_of_few_rows_warns(dirty):
    r = tests_param.anova(dirty, "x", "g").first()
    assert r.f is None and r.warning


def test_wilcoxon_rank_sums(spark):
    d = spark.createDataFrame([(float(i), float(i + (i % 4) - 1)) for i in range(40)], "a double, b double")
    r = tests_rank.wilcoxon(d, "a", "b").first()
    assert r.rank_plus + r.rank_minus == r.n * (r.n + 1) / 2


def test_kruskal_and_tukey(three_groups):
    assert tests_rank.kruskal(three_groups, "v", "g").first().p < 1e-10
    pairs = tests_param.tukey(three_groups, "v", "g").collect()
    assert len(pairs) == 3 and all(r.reject and r.low <= r["diff"] <= r.high for r in pairs)
    adjusted = tests_param.pairwise_adjusted(three_groups, "v", "g", "fdr_bh").collect()
    assert all(r.p_adj >= r.p for r in adjusted)


def test_chisq(spark):
    rows = [("A", "X") if i % 3 == 0 else ("B", "Y") if i % 3 == 1 else ("C", "X") for i in range(70)]
    r = tests_param.chisq(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert r.chi2 == pytest.approx(70) and r.v_low <= r.cramers_v + 1e-9 and r.cramers_v <= r.v_high + 1e-9


def test_constant_column_has_no_correlation(spark):
    d = spark.createDataFrame([(float(i), 1.0, None if i % 2 else float(2 * i)) for i in range(20)], "a double, c double, b double")
    r = {(x.a, x.b): x.r for x in tests_param.corr(d).collect()}
    assert r["a", "c"] == 0 and r["a", "b"] == pytest.approx(1)


def test_ols_recovers(spark):
    d = spark.createDataFrame([(2 * i + 1.2 * (i % 7) + 0.3 * (i % 5), float(i), float(i % 7), 1.0) for i in range(1, 80)], "y double, x1 double, x2 double, one double")
    fit = ols.ols(d, "y", ["x1", "x2", "one"])
    c = {r.term: r for r in fit.coefficients().collect()}
    assert set(c) == {"const", "x1", "x2"}
    assert c["x1"].coef == pytest.approx(2, abs=0.05) and c["x2"].coef == pytest.approx(1.2, abs=0.05)
    assert fit.diagnostics().agg(F.sum("leverage")).first()[0] == pytest.approx(3)
    assert ols.ols(d, "y", ["x1"], robust="HC3").coefficients().count() == 2


def test_quality_process(dirty):
    wide = dirty.unionByName(dirty.selectExpr("case when x < 100 then x end as x", "y", "g"))
    cleaned, summary = quality.quality_process(wide, "exclude", "iqr", ["x"])
    r = summary.first()
    assert cleaned.where("x > 100 or x is null or y is null").count() == 0
    assert r.rows_after - r.rows_before == r.rows_delta and r.outliers_after == 0
    clipped, s = quality.quality_process(wide, "winsorize", "iqr", ["x"])
    assert clipped.count() == wide.count() and s.first().outliers_after == 0


def test_profile_of_blank_and_dates(spark):
    d = spark.createDataFrame([(str(i), f"2026-01-{i % 28 + 1:02d}", "" if i % 2 else "a") for i in range(40)], "n string, t string, c string")
    kinds = {r.column: r.kind for r in profile.column_kinds(d).collect()}
    assert kinds == {"n": "numeric", "t": "dateLike", "c": "categorical"}
    assert [r.kind for r in profile.flags(d).collect()] == ["missing"]


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.extension(F.lit("https://x.org/a/b.PNG?q=1")).alias("e"), scalar.extension(F.lit("https://x.org")).alias("none"),
        scalar.reference_words(F.lit("/pics/myFirst_photo-2.jpeg")).alias("w"), scalar.hash_fraction(F.lit("abc"), 0).alias("h"),
        scalar.data_url_bytes(F.lit("data:image/gif;base64,R0lGODlhAwAFAA==")).alias("g"), scalar.to_number(F.lit("NaN")).alias("nan"),
    )
    x = r.withColumns({"width": scalar.image_size(F.col("g"), "width"), "height": scalar.image_size(F.col("g"), "height")}).first()
    assert (x.e, x.none, x.w, x.width, x.height, x.nan) == ("png", "", "my First photo 2", 3, 5, None)
    assert x.h == pytest.approx(0xA9993E36 / 0xFFFFFFFF, abs=1e-6)


def test_recommend_and_report(three_groups, spark):
    ops = [r.op for r in recommend.recommend(three_groups, "compare_groups").orderBy("rank").collect()]
    assert ops == ["anova", "kruskal", "tukey", "pairwise_adjusted", "describe"]
    assert report.run(three_groups, "anova", {"value": "v", "group": "g"}).tables["test"].first().f > 1
    assert report.run(three_groups.where("false"), "describe").warnings
    for op, args, code in (("nothing", {}, "UNSUPPORTED_OP"), ("corr", [], "INVALID_PAYLOAD"), ("anova", {"value": "z", "group": "g"}, "MISSING_COLUMN")):
        with pytest.raises(report.OperationError) as e:
            report.run(three_groups, op, args)
        assert e.value.code == code


def test_every_report_runs(two_groups):
    d = two_groups.withColumn("w", F.col("v") * 2 + F.col("v") % 3).withColumn("k", F.when(F.col("v") % 2 == 0, "e").otherwise("o"))
    args = {"corr": {}, "ttest": {"value": "v", "group": "g"}, "chisq": {"a": "g", "b": "k"}, "normality": {"column": "v"}, "ci_mean": {"column": "v"}, "mannwhitney": {"value": "v", "group": "g"}, "wilcoxon": {"a": "v", "b": "w"}, "kruskal": {"value": "v", "group": "g"}, "ols": {"y": "w", "x": ["v", "g"]}, "quality": {}, "quality_process": {}, "describe": {}, "recommend": {}}
    for op, a in args.items():
        for table in report.run(d, op, a).tables.values():
            assert table.columns and table.limit(5).collect() is not None


def test_comparison(spark):
    jan = spark.createDataFrame([(10, 2.0, "east"), (12, 3.0, "west"), (11, 2.5, "west")], "sales long, margin double, region string")
    feb = spark.createDataFrame([(8, 1.5, "east"), (9, 2.0, "west"), (10, 2.2, "west")], "sales long, margin double, region string")
    both = {"jan": jan, "feb": feb}
    assert compare.shared_columns(both) == ["sales", "margin", "region"]
    assert compare.chart_plan(both).first().type == "bar"
    assert compare.stat_diff_numeric(both).first().column == "sales"
    assert {r.kind for r in compare.compare_plan(both).collect()} == {"group", "correlation"}


def test_knn_dbscan_and_forest(spark):
    d = spark.createDataFrame([(k, float(i), float(i + 1)) for k, i in enumerate([*range(25), *range(100, 125)])], "id long, x1 double, x2 double")
    clusters = {r.id: r.cluster for r in learning.dbscan(d, "id", ["x1", "x2"], 2.0, 2).collect()}
    assert set(clusters.values()) == {0, 25}
    odd = d.union(spark.createDataFrame([(99, 1000.0, -900.0)], d.schema))
    scored = learning.isolation_forest(odd, ["x1", "x2"], trees=30).orderBy(F.desc("score")).first()
    assert scored.id == 99
    labelled = d.withColumn("c", F.when(F.col("x1") < 50, "a").otherwise("b"))
    assert labelled.join(learning.knn_classify(labelled, labelled.select("id", "x1", "x2"), ["x1", "x2"], "c", "id"), "id").where("c <> prediction").count() == 0


def test_learning_errors(spark, two_groups):
    for args, code in ((("sorting", "x", "v"), "ML_TASK_INVALID"), (("regression", "linear", "absent"), "ML_TARGET_REQUIRED"), (("regression", "nothing", "v"), "ML_MODEL_INVALID")):
        with pytest.raises(learning.LearningError) as e:
            learning.train(two_groups, *args, columns=["g"])
        assert e.value.code == code


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1.0, "a")], "x double, g string")
    r = describe.numeric_core_stats(one).first()
    assert (r.n, r.std, r["skew"]) == (1, 0.0, None)
    assert describe.numeric_core_stats(one.where("false")).first().n == 0
    assert tests_param.ci_mean(one, "x").first().warning
    assert tests_rank.mannwhitney(one.where("false"), "x", "g").first().warning


def test_session_gap_of_exactly_the_ttl_joins(spark):
    d = spark.sql("select 1 as k, timestamp_seconds(t) as ts from values (0), (300), (601) as v(t)")
    assert sorted(r.beats for r in service.sessions(d, "k", "ts").collect()) == [1, 2]


def test_quantiles_narrow_to_the_exact_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=4000) ** 3, 3)
    tied = np.repeat([1.0, 2.0, 3.0], [100, 3800, 100])
    rows = [(float(a), float(b), None if k % 3 else float(k)) for k, (a, b) in enumerate(zip(x, tied, strict=True))]
    df = spark.createDataFrame([*rows, (None, float("nan"), None)], "a double, b double, c double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.731, 1.0]
    found = quantiles.quantiles(df, {c: F.col(c) for c in "abc"}, shares)
    for c, v in (("a", x), ("b", tied), ("c", np.arange(0, 4000, 3))):
        assert found[c] == pytest.approx(np.quantile(v, shares).tolist())
    assert quantiles.quantiles(df.where("false"), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    assert {r.column: r.mode for r in quantiles.per_value(df, {"b": F.col("b"), "c": F.col("c")}, {"q": 0.5}, mode=True).collect()} == {"b": 2.0, "c": 0.0}


def test_wilcoxon_counts_all_pairs(spark):
    d = [0] * 50 + [1, -2, 3, 4, -5, 6]
    found = tests_rank.wilcoxon(spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double"), "a", "b").first()
    n, w = 56, 7
    assert (found.n_pairs, found.n, found.w) == (56, 6, w)
    assert found.r_approx == pytest.approx(abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24) / math.sqrt(n))
    zero = spark.createDataFrame([(1.0, 1.0)] * 6, "a double, b double")
    assert tests_rank.wilcoxon(zero, "a", "b").first().warning == "All differences are 0."
    assert tests_rank.wilcoxon(zero.limit(4), "a", "b").first().warning == "The test needs five pairs."
    one = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (3.0, "B")], "v double, g string")
    assert tests_rank.mannwhitney(one, "v", "g").first().warning


def test_effect_without_spread_is_zero(spark):
    flat = spark.createDataFrame([(1.0, g) for g in "AABB"], "v double, g string")
    assert tests_param.ttest(flat, "v", "g").first().cohen_d == 0


def test_wide_correlations_are_pairwise(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 53)) + 1000
    x[:, 1] = 5.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{k}" for k in range(53)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(3)
    found = {(r.a, r.b): r.r for r in tests_param.corr(df).collect()}
    assert len(found) == 53 * 52 // 2 and found["c0", "c1"] == 0
    for i, j in ((0, 2), (7, 40), (51, 52)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert found[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])


def test_eta_limits_do_not_depend_on_partitions(spark):
    rows = [(float(k % 7 + 3 * (k % 3)), "abc"[k % 3], k) for k in range(90)]
    df = spark.createDataFrame(rows, "v double, g string, k long")
    made = [tuple(tests_param.eta_squared_limits(df.repartition(n), "v", "g", 60).first()) for n in (1, 5)]
    assert made[0] == pytest.approx(made[1]) and made[0][0] < made[0][1]
    assert tests_param.eta_squared_limits(df.limit(19), "v", "g").first().eta_low is None


def test_residual_places_and_reconstruction(spark):
    e = [5.0, -1.0, 2.0, 9.0, 4.0, 0.0]
    df = spark.createDataFrame([(k, v, 0.0) for k, v in enumerate(e)], "key long, actual double, prediction double")
    s = sorted(e)
    assert tuple(learning.residual_summary(df).first()) == (s[0], s[round(5 * 0.05)], s[3], s[round(5 * 0.95)], s[-1])
    assert [r.key for r in learning.largest_residuals(df, "key", 2).collect()] == [3, 0]
    xy = spark.createDataFrame([(float(k), 2.0 * k + (7.0 if k in (3, 30) else 0.0)) for k in range(40)], "x double, y double")
    found = learning.reconstruction_anomalies(xy, ["x", "y"], 1, 0.05).toPandas()
    limit = np.sort(found["error"])[int(0.95 * 39)]
    assert found["outlier"].tolist() == (found["error"] >= limit).tolist()


def test_stratified_splits(spark):
    df = spark.createDataFrame([(k, "rare" if k % 10 == 0 else "common") for k in range(400)], "k long, label string")
    train, test = learning.holdout(df, "k", 0.25, stratify="label")
    assert {r.label: r["count"] for r in test.groupBy("label").count().collect()} == {"rare": 10, "common": 90}
    assert train.count() == 300
    counts = learning.folds(df, "k", 4, stratify="label").groupBy("fold", "label").count().collect()
    assert all(abs(r["count"] - {"rare": 10, "common": 90}[r.label]) <= 1 for r in counts) and len(counts) == 8


def test_train_takes_all_tasks_and_names(spark):
    rows = [(k, float(k), float((3 * k) % 11), "A" if k + (3 * k) % 11 < 70 else "B", "2026-01-01") for k in range(1, 101)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, label string, ds string").withColumn("day", F.date_add("ds", F.col("id").cast("int")).cast("timestamp"))
    xs = ["x1", "x2"]
    for name in ("forest", "nb", "knn", "svm", "calibrated"):
        result = learning.train(df, "classification", name, "label", xs, "id", trees=10)
        assert result.metrics.first().accuracy > 0.6, name
    contract = learning.train(df, "regression", "linear", "x1", ["x2"], "id", scoring="mae").metrics.collect()
    assert [r.metric for r in contract if r.is_primary] == ["mae"]
    assert learning.train(df, "clustering", "kmeans", None, xs, "id", k=2, starts=1).importance.count() == 2
    assert learning.train(df, "clustering", "dbscan", None, xs, "id", eps=4.0, min_samples=3).metrics.first().noise >= 0
    assert learning.train(df, "dimension_reduction", "pca", None, xs, "id").importance.count() == 4
    assert learning.train(df, "anomaly", "iforest", None, xs, "id", contamination=0.1).metrics.first().outlier_ratio == pytest.approx(0.1, abs=0.03)
    assert learning.train(df, "anomaly", "autoencoder", None, xs, "id").metrics.first().n == 100
    assert learning.train(df, "timeseries", "moving_average", "x1", time="day", horizon=6).metrics.first().mape < 1
    for code, args, more in (("ML_SCORING_INVALID", ("regression", "linear", "x1"), {"scoring": "no"}), ("ML_MODEL_INVALID", ("anomaly", "no", None), {}), ("ML_TASK_INVALID", ("no", "no", None), {})):
        with pytest.raises(learning.LearningError) as error:
            learning.train(df, *args, columns=xs, **more)
        assert error.value.code == code
    with pytest.raises(learning.LearningError) as error:
        learning.train(df.limit(5), "regression", "linear", "x1", ["x2"])
    assert error.value.code == "ML_TOO_FEW_ROWS"


def test_recommendations_by_rule(spark):
    df = spark.createDataFrame([(1.0 * k, 2.0 * k, "ab"[k % 2], "xyz"[k % 3]) for k in range(12)], "p double, q double, g string, h string")
    found = [(r.rank, r.op, json.loads(r.args_json)) for r in recommend.recommend(df, "auto").orderBy("rank").collect()]
    assert found[:2] == [(1, "ttest", {"group": "g", "value": "p"}), (2, "mannwhitney", {"group": "g", "value": "p"})]
    assert {op for _, op, _ in found} == {"ttest", "mannwhitney", "chisq", "wilcoxon", "ols", "normality", "ci_mean", "corr", "describe"}
    three = recommend.recommend(df, "group_compare", group="h", value="q").orderBy("rank").collect()
    assert [r.op for r in three] == ["anova", "kruskal", "tukey", "pairwise_adjusted", "corr", "describe"] and json.loads(three[2].args_json) == {"alpha": 0.05, "group": "h", "value": "q"}
    assert [r.op for r in recommend.recommend(df.select("g"), "auto").collect()] == ["describe"]
    paired = recommend.recommend(df, "paired", a="q", b="q").where("op = 'wilcoxon'").first()
    assert json.loads(paired.args_json) == {"a": "q", "b": "p"}


def test_usage_is_appended_by_day(spark, tmp_path):
    from tallygrove.sources import tables

    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        tables.append_usage(spark.createDataFrame([(1, f"{day} 10:00:00")], "id long, created_at string"), str(tmp_path / "usage"))
    assert {str(r.day): r["count"] for r in spark.read.parquet(str(tmp_path / "usage")).groupBy("day").count().collect()} == {"2026-01-01": 1, "2026-01-02": 2}


def test_data_urls(spark):
    refs = [("data:image/PNG;base64,aGk=", "image/png", b"hi"), ("DATA:text/plain;charset=utf-8;base64,aGk=", "text/plain", b"hi"), ("data:,a%20b", "", b"a b"), ("http://x.org/a,b", "", None), (None, None, None)]
    df = spark.createDataFrame([(r[0],) for r in refs], "r string").select(scalar.data_url_mime(F.col("r")).alias("m"), scalar.data_url_bytes(F.col("r")).alias("b"))
    got = [(r.m, bytes(r.b) if r.b is not None else None) for r in df.collect()]
    assert got == [r[1:] for r in refs]


def test_radar_from_the_dispatcher(spark):
    from tallygrove.operators import chart

    df = spark.createDataFrame([("speed", 1.0, "a", 1), ("speed", 5.0, "a", 2), ("speed", 3.0, "a", 3), ("reach", 4.0, "b", 1)], "axis string, v double, who string, k long")
    found = {(r.series, r.axis): r.y for r in chart.aggregate(df, "radar", "axis", "v", "who", order="k").collect()}
    assert found == {("a", "speed"): 3.0, ("a", "reach"): 0.0, ("b", "speed"): 0.0, ("b", "reach"): 4.0}
    assert {r.y for r in chart.aggregate(df, "radar", "axis", "v", "who").where("series = 'a' and axis = 'speed'").collect()} == {5.0}


def test_rows_of_json_arrays(spark):
    df = spark.createDataFrame([(1, '[{"a": 1, "b": "x"}, {"a": 2}]'), (2, "[]"), (3, "no json"), (4, None)], "k int, j string")
    assert sorted(map(tuple, tables.from_json_rows(df, "j", "a int, b string", ["k"]).collect()), key=str) == [(1, 1, "x"), (1, 2, None)]


def test_model_export(spark, two_groups, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegressionModel

    rows = spark.range(30).selectExpr("id as k", "double(id) as x", "2.0 * id + 1 as y")
    fitted = learning.train(rows, "regression", "linear", "y", ["x"], "k").fitted
    learning.export_model(fitted, str(tmp_path / "m"))
    again = (PipelineModel if isinstance(fitted, PipelineModel) else LinearRegressionModel).load(str(tmp_path / "m"))
    assert again.uid == fitted.uid


def test_flags_of_correlations_and_warnings(spark):
    clean = spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, v double")
    assert [tuple(r) for r in profile.flags(clean).collect()] == [("clean", "low")]
    assert sorted(r.kind for r in profile.flags(clean, 2, ["few rows"]).collect()) == ["correlation", "warning"]


@pytest.mark.parametrize("n", [0, 1, 5, 7, 100, 1201, 2500])
def test_thinned_rows_are_evenly_spaced(spark, n):
    most = 7 if n < 200 else 1200
    got = sorted(r.id for r in ranks.thinned(spark.range(n), ["id"], most).collect())
    assert got == (list(range(n)) if n <= most else [k * (n - 1) // (most - 1) for k in range(most)])


def test_points_are_thinned_by_order(spark):
    df = spark.range(3000).selectExpr("id", "double(id) as x", "double(-id) as y")
    assert chart.points(df, "x", "y", order=["id"]).count() == 1200
    assert chart.aggregate(df, "scatter", "x", "y").count() == 3000
    assert [r.x for r in chart.aggregate(df.where("id < 4"), "line", "x", "y").collect()] == ["0.0", "1.0", "2.0", "3.0"]


def test_one_series_without_keys(spark):
    df = spark.range(40).selectExpr("timestamp_seconds(id * 86400) as t", "double(id) as y")
    rows = series.prepared(df, "t", "y", horizon=5).orderBy("k").collect()
    assert [(r.k, r.y, r.n, r.h) for r in rows] == [(k, float(k), 40, 5) for k in range(40)]
    assert sorted(r.y for r in series.history_tail(df, "t", "y", horizon=5).collect()) == [float(k) for k in range(20, 40)]
    assert [r.t.day for r in series.held_out_times(df, "t", "y", horizon=5).orderBy("step").collect()] == [5, 6, 7, 8, 9]
    assert {r.forecast for r in series.forecast(df, "t", "y", horizon=5).collect()} == {34.0}


def test_locks_of_other_clients(spark):
    beats = [("k", c, s, i) for i, (s, c) in enumerate([(0, "a"), (100, "b"), (299, "a"), (598, "b"), (599, "b"), (700, "a"), (899, "a")])]
    beats += [("m", "b", 50, 20), (None, "a", 0, 30), (None, "b", 10, 31), ("n", "a", None, 40)]
    df = spark.createDataFrame(beats, "k string, c string, s int, i int").selectExpr("k", "c", "timestamp_seconds(s) as t", "i")
    got = {r.i: r.locked for r in service.session_locks(df, "k", "c", "t", "i").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 20: False, 30: False, 31: True}
    assert service.session_locks(df.where("false"), "k", "c", "t", "i").count() == 0


def test_manifest_labels_and_texts(spark):
    df = spark.createDataFrame([(" cat ", "two words"), ("dog", ""), ("cat", None), ("", "one"), (None, "one")], "label string, text string")
    assert [tuple(r) for r in manifest.label_counts(df, "label").collect()] == [("cat", 2), ("dog", 1)]
    assert tuple(manifest.text_summary(df, "text").first()) == (5, 3, 5.0, 1.333)
    assert tuple(manifest.text_summary(df.where("false"), "text").first()) == (0, 0, 0.0, 0.0)


def test_regression_figures_and_normality_histogram(spark):
    df = spark.range(50).selectExpr("double(id) as x", "2 * id + sin(id) as y")
    figures = ols.ols(df, "y", ["x"]).figures(20)
    assert {n: f.count() for n, f in figures.items()} == {"residual_fitted": 20, "scale_location": 20, "cooks_distance": 20, "residual_qq": 20}
    qq = ols.ols(df, "y", ["x"]).figures()["residual_qq"].orderBy("place").collect()
    assert all(a.sample <= b.sample and a.theoretical < b.theoretical for a, b in zip(qq, qq[1:], strict=False))
    assert [r.theoretical for r in qq] == pytest.approx([NormalDist().inv_cdf((k + 1) / 51) for k in range(50)])
    ordered = ols.ols(df.repartition(4), "y", ["x"], order=["x"])
    cook = {r.row: r.cooks_distance for r in ordered.figures()["cooks_distance"].collect()}
    want = {int(r.x): r.cooks_distance for r in ordered.diagnostics().collect()}
    assert cook == pytest.approx(want)
    assert report.run(df, "normality", {"column": "y"}).tables["histogram"].agg(F.count(F.lit(1)), F.sum("count")).first() == (8, 50)


def test_normality_by_unbiased_shape(spark):
    x = [float(i * i) for i in range(40)]
    r = tests_param.normality(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    assert (r["mean"], r.sd) == pytest.approx((np.mean(x), np.std(x, ddof=1)))
    assert (round(r.skewness, 3), round(r.kurtosis, 3)) == (0.677, -0.795)
    qq = tests_param.qq_points(spark.createDataFrame([(v,) for v in x], "x double"), "x").collect()
    assert [q.theoretical for q in qq] == pytest.approx([NormalDist(np.mean(x), np.std(x, ddof=1)).inv_cdf(q.p) for q in qq])


def test_v_limits_of_large_tables_and_any_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{i}", f"b{j}") for i, j in zip(rng.integers(0, 400, 6000), rng.integers(0, 300, 6000), strict=True)]
    r = tests_param.chisq(spark.createDataFrame(rows, "a string, b string"), "a", "b", bootstrap=25).first()
    assert r.warning is None and r.v_low < r.v_high  # 120,000 cells
    few = spark.createDataFrame([("x", "p")] * 40 + [("x", "q")] * 12 + [("y", "p")] * 15 + [("y", "q")] * 33, "a string, b string")
    made = [tests_param.chisq(few.repartition(n), "a", "b").first() for n in (1, 7)]
    assert made[0] == made[1] and made[0].v_low < made[0].cramers_v < made[0].v_high


def test_duplicates_by_fingerprints(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), (None, "a", -0.0), ("b", "b", float("nan")), ("b", "b", float("nan")), ("b", "b", float("nan")), ("c", "d", 1.0)]
    df = spark.createDataFrame(rows, "x string, `y.z` string, n double")
    for few in (1_000_000, 0):
        assert tuple(describe.duplicate_rows(df, few).first()) == (7, 3, 3)
    assert tuple(describe.duplicate_rows(df.where("false")).first()) == (0, 3, 0)


def test_concrete_tests_by_kinds():
    kinds = {"numeric": ["v", "w"], "categorical": ["g", "h"], "dateLike": ["d"]}
    assert compare.concrete_test(kinds, {"g": 2})["op"] == "ttest" and compare.concrete_test(kinds, {"g": 3})["op"] == "anova"
    assert compare.concrete_test(kinds, {"g": 1})["op"] == "chisq" and compare.concrete_test(kinds, {"g": 1}, "group") is None
    assert compare.concrete_test({"numeric": ["v", "w"]}, {})["op"] == "corr" and compare.concrete_test(kinds, {}, "trend")["op"] == "describe"
    assert compare.concrete_test({}, {}) is None


def test_plans_and_follow_ups(spark):
    made = lambda s: spark.range(40).selectExpr("id as v", f"id % {s} + 0.5 as w", "if(id % 2 = 0, 'a', 'b') as g", f"if(id % {s} = 0, 'p', if(id % 3 = 0, 'q', 'r')) as h")
    sets = {"one": made(4), "two": made(9)}
    assert [(r.kind, r.priority, r.op) for r in compare.compare_plan(sets).collect()] == [("group", "high", "ttest"), ("correlation", "high", "corr"), ("association", "medium", "chisq")]
    steps = {(r.column, r.dataset): (r.kind, r.op) for r in compare.follow_ups(sets).collect()}
    assert steps["v", "one"] == ("numeric", "ttest") and steps["g", "two"] == ("categorical", "ttest") and steps["h", "one"] == ("categorical", "anova")


def test_previews(spark):
    df = spark.range(30).selectExpr("id as k", "double(id) as x", "double(id * id) as y")
    _, _, centres = learning.kmeans(df, ["x", "y"], 4, 1)
    assert learning.centroid_preview(df, centres, ["x", "y"]).count() == 6
    rows, _, _ = learning.pca(df, ["x", "y"], 1)
    assert [r.k for r in learning.projection_preview(rows, "k").collect()] == list(range(20))


def test_knn_in_blocks_and_with_nulls(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(x), "a" if x < 0.5 else "b") for i, x in enumerate(rng.random(200))]
    train, test = (spark.createDataFrame(d, "k long, x double, l string") for d in (data[:150] + [(999, None, "a")], data[150:]))
    want = {}
    for k, x, _ in data[150:]:
        near = sorted((abs(x - v), i, n) for i, v, n in data[:150])[:5]
        votes = [n for _, _, n in near]
        want[k] = min(set(votes), key=lambda n: (-votes.count(n), n))
    assert {r.k: r.prediction for r in learning.knn_classify(train, test, ["x"], "l", "k", cell=16).collect()} == want
    assert learning.knn_classify(train.where("false"), test, ["x"], "l", "k").count() == 0


def test_streams_drop_what_comes_after_the_watermark(spark, tmp_path):
    import time

    schema = "api_key_id int, ts timestamp"
    files = [[(1, 0), (1, 100)], [(1, 10_000)], [(1, 20_000)], [(1, 50)], [(1, 90_000)]]  # 50 comes late
    for rows in files:
        spark.createDataFrame(rows, "api_key_id int, s long").selectExpr("api_key_id", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the source takes files by their times
    stream = usage.session_stream(usage.read_stream(spark, str(tmp_path / "in"), schema, 1), "api_key_id", "ts")
    assert sorted((r.start.timestamp(), r.beats) for r in usage.drained(stream).collect())[:1] == [(0.0, 2)]


def test_stream_of_locks_equals_the_batch(spark, tmp_path):
    import time

    base = 1_700_000_000
    files = [[(1, "a", 0, 1), (1, "b", 100, 2), (2, "z", 0, 3)], [(1, "a", 250, 4), (1, "b", 560, 5)], [(1, "b", 500, 6), (1, "a", 700, 7)], [(1, "c", 2000, 8)], [(3, "q", 9000, 9)], [(3, "q", 20_000, 10)]]  # 500 comes late
    for rows in files:
        spark.createDataFrame(rows, "k int, c string, s long, i long").selectExpr("k", "c", f"timestamp_seconds(s + {base}) as t", "i").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    found = usage.drained(locks.lock_stream(usage.read_stream(spark, str(tmp_path / "in"), "k int, c string, t timestamp, i long"), "k", "c", "t", "i")).collect()
    batch = service.session_locks(spark.read.parquet(str(tmp_path / "in")), "k", "c", "t", "i").where("i < 10").collect()  # the last is still waiting
    assert sorted((r.i, r.k, r.c, r.t, r.locked) for r in found if r.event == "heartbeat") == sorted((r.i, r.k, r.c, r.t, r.locked) for r in batch)
    assert sorted((r.k, r.c, int(r.t.timestamp()) - base) for r in found if r.event == "expired") == [(1, "a", 550), (1, "b", 860), (1, "c", 2300), (2, "z", 300), (3, "q", 9300)]


def test_locks_wait_for_one_timer_of_a_key():
    class State:
        value = ()

        def exists(self):
            return bool(self.value)

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        update, clear = put, lambda self: self.put(())

        def appendList(self, rows):
            self.value = [*self.value, *rows]

    class Handle:
        timers: set = set()

        def getValueState(self, *_):
            return State()

        getListState = getValueState

        def registerTimer(self, at):
            self.timers.add(at)

    class Clock:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    held, handle = locks.SessionLocks("k", "int", 10), Handle()
    held.init(handle)
    for batch in ([5, 1, 3, 40, 41, 42], [2, 60]):
        list(held.handleInputRows((1,), iter([pd.DataFrame([("c", at * 1_000_000, str(at)) for at in batch], columns=locks.FIELDS)]), Clock(0)))
    assert handle.timers == {1000, 2000}
    found = pd.concat(held.handleExpiredTimer((1,), Clock(30_000), Clock(30_000)))
    assert [(r.at // 1_000_000, r.event) for r in found.itertuples()] == [*((at, "heartbeat") for at in (1, 2, 3, 5)), (15, "expired")]
    assert handle.timers == {1000, 2000, 40_000}
    found = pd.concat(held.handleExpiredTimer((1,), Clock(50_000), Clock(50_000)))
    assert [r.at // 1_000_000 for r in found.itertuples()] == [40, 41, 42] and handle.timers == {1000, 2000, 40_000, 52_000, 60_000}


def test_batches_are_appended_once(spark, tmp_path):
    frame = spark.range(10).selectExpr("id", "timestamp_seconds(id * 43200) as created_at")
    frame.repartition(2).write.parquet(str(tmp_path / "in"))
    usage.append_batches(usage.read_stream(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == list(range(10)) and got.select("day").distinct().count() == 5


def test_figures_in_chunks(spark):
    df = spark.range(25).selectExpr("id as x", "id * 2 as y").repartition(3)
    made = chart.figure(df, "scatter", "t", 10).orderBy("chunk").collect()
    assert [len(json.loads(r.data)["x"]) for r in made] == [10, 10, 5] and json.loads(made[1].data)["y"][0] == 20
    assert json.loads(chart.figure(df.where("false"), "scatter").first().data)["x"] == []


def test_local_references(spark):
    refs = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, None)], "id int, ref string")
    files = spark.createDataFrame([("a.png", bytearray(b"abc"))], "path string, content binary")
    found = {r.id: r for r in manifest.manifest_features(manifest.with_local(refs, "ref", files), "ref", "content").collect()}
    assert [(found[k].kind, found[k].byte_size, found[k].is_local) for k in (1, 2, 3)] == [("local", 3, True), ("missing", 0, False), ("empty", 0, False)]


def test_too_many_levels(spark):
    with pytest.raises(ValueError):
        scalar.one_hot(spark.range(20).select(F.col("id").cast("string").alias("x")), "x", most=10)
    with pytest.raises(learning.LearningError):
        learning.holdout(spark.range(20_000).withColumn("y", F.col("id")), "id", stratify="y")


def test_options_are_clamped():
    clamped = scalar.clamped
    assert [clamped(v, 0.05, 0.5, 0.2) for v in (0.3, "0.4", 0, 9, None, "x", float("nan"), -1)] == [0.3, 0.4, 0.05, 0.5, 0.2, 0.2, 0.2, 0.05]
