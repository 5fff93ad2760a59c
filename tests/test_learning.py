"""Learning: folds, scorings and errors by code, permutations, starts, samples, calibration and silhouettes."""

import numpy as np
import pytest
from pyspark.ml import clustering as mk
from pyspark.sql import functions as F

from tallygrove.operators import clusters, learning
from tallygrove.operators.ranks import permuted


@pytest.fixture(scope="module")
def flowers(spark):
    """Three groups of 60 points, and a number that depends on the first coordinate only."""
    rng = np.random.default_rng(2)
    rows = [(100 * c + k, float(x), float(y), "abc"[c], float(3 * x + rng.normal())) for c in range(3) for k, (x, y) in enumerate(rng.normal([3 * c, c % 2], 0.8, (60, 2)))]
    return spark.createDataFrame(rows, "id long, x double, y double, kind string, target double").repartition(3).cache()


def code(call):
    with pytest.raises(learning.LearningError) as error:
        call()
    return error.value.code


def test_errors_by_code(spark, flowers):
    fit = lambda df=flowers, task="regression", model="linear", target="target", columns=("x", "y"), **o: learning.train(df, task, model, target, list(columns), "id", **o)
    assert code(lambda: fit(columns=["x", "nowhere"])) == "ML_FEATURES_NOT_FOUND"
    assert code(lambda: fit(df=flowers.where("false"))) == "ML_EMPTY_AFTER_CLEAN"
    assert code(lambda: fit(df=flowers.orderBy("id").limit(7))) == "ML_TOO_FEW_ROWS"
    assert fit(df=flowers.orderBy("id").limit(8)).metrics.first().n == 8
    assert code(lambda: fit(task="classification", model="logistic", target="kind", df=flowers.where("kind = 'a'"))) == "ML_CLASS_LABELS_REQUIRED"
    assert code(lambda: fit(task="sorting")) == "ML_TASK_INVALID"
    assert code(lambda: fit(model="oracle")) == "ML_MODEL_INVALID"
    assert code(lambda: fit(task="clustering", model="oracle", target=None)) == "ML_MODEL_INVALID"
    assert code(lambda: fit(task="clustering", model="kmeans", target=None, df=flowers.limit(2))) == "ML_TOO_FEW_ROWS"
    assert code(lambda: fit(scoring="accuracy")) == "ML_SCORING_INVALID"
    assert code(lambda: fit(target="nowhere")) == "ML_TARGET_REQUIRED"
    assert code(lambda: learning.train(flowers.select("kind"), "clustering", "kmeans", None)) == "ML_FEATURES_REQUIRED"


@pytest.mark.parametrize(("task", "name", "scoring"), [("regression", "mse", "neg_mean_squared_error"), ("regression", "neg_mae", "neg_mean_absolute_error"), ("regression", "RMSE", "neg_root_mean_squared_error"), ("classification", "f1", "f1_weighted"), ("classification", None, "accuracy"), ("regression", None, "r2")])
def test_scorings_by_name(task, name, scoring):
    assert learning.scoring_of(task, name) == scoring


def test_primary_metric_without_a_scoring(flowers):
    first = lambda contract: {r.metric: r.goal for r in contract.collect() if r.is_primary}
    assert first(learning.train(flowers, "regression", "linear", "target", ["x"], "id").contract) == {"r2": "higher"}
    assert first(learning.train(flowers, "outlier", "iforest", None, ["x", "y"], "id", contamination=0.1, preset="fast").contract) == {"outlier_ratio": "lower"}


def test_cross_validation_of_a_regression(flowers):
    found = learning.cross_validate(flowers, "regression", "linear", "target", ["x"], "id", 20, "neg_mse")
    scores = {r.fold: r for r in found.scores.collect()}
    assert sorted(scores) == list(range(20)) and sum(r.n for r in scores.values()) == 180
    values = [scores[k].score for k in range(20)]
    assert all(scores[k].score == pytest.approx(-scores[k].mse) for k in range(20))
    s = found.summary.first()
    assert (s.folds, s.scoring, s["min"], s["max"]) == (20, "neg_mean_squared_error", min(values), max(values))
    assert s["mean"] == pytest.approx(np.mean(values)) and s["std"] == pytest.approx(np.std(values)) and not found.warnings


def test_folds_of_small_classes(flowers):
    few = flowers.where("kind <> 'c'").unionByName(flowers.where("kind = 'c'").orderBy("id").limit(3))
    found = learning.cross_validate(few, "classification", "decision_tree", "kind", ["x", "y"], "id", 10)
    assert found.summary.first().folds == 3 and found.warnings
    one = flowers.where("kind <> 'c'").unionByName(flowers.where("kind = 'c'").orderBy("id").limit(1))
    assert code(lambda: learning.cross_validate(one, "classification", "decision_tree", "kind", ["x"], "id")) == "ML_TOO_FEW_ROWS"


def test_permuted_is_a_bijection():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        made = permuted(np.arange(n), n, 7)
        assert sorted(made.tolist()) == list(range(n))
        assert n < 16 or (made == permuted(np.arange(n), n, 8)).mean() < 0.2


def test_permutation_importance(flowers):
    result = learning.train(flowers, "regression", "linear", "target", ["x", "y"], "id")
    score = lambda p: learning.regression_metrics(p, "label").first().r2
    both = [learning.permutation_importance(result.fitted, result.predictions.select("label", "x", "y").repartition(n), ["x", "y"], ["x", "y"], score).collect() for n in (1, 7)]
    assert both[0] == both[1]
    found = {r.feature: r for r in both[0]}
    assert found["x"]["mean"] > 0.5 > 0.1 > abs(found["y"]["mean"]) and found["x"]["std"] > 0


def test_kmeans_starts_are_no_worse_than_one_by_one(flowers):
    rows, inertia, centres = learning.kmeans(flowers, ["x", "y"], 3, 5)
    made, _, _ = learning.features(flowers, ["x", "y"])
    assert inertia <= min(mk.KMeans(k=3, seed=42 + s).fit(made).summary.trainingCost for s in range(5)) * 1.0001
    again = learning.kmeans(flowers.repartition(9), ["x", "y"], 3, 5)
    assert again[1] == pytest.approx(inertia)
    x = np.array([(r.x, r.y, r.cluster) for r in rows.collect()])
    assert ((x[:, None, :2] - np.array(centres)[None]) ** 2).sum(2).argmin(1).tolist() == x[:, 2].astype(int).tolist()
    assert len(learning.kmeans(flowers.limit(2), ["x"], 3, 2)[2]) == 3


def test_kmeans_jobs_do_not_grow_with_starts(spark, flowers):
    counted = []
    for starts in (1, 6):
        spark.sparkContext.setJobGroup(f"starts{starts}", "")
        clusters._seeded(flowers.select(F.array("x", "y").alias("x"), F.lit(1.0).alias("w"), F.xxhash64("id").alias("h")), 3, starts, 1)
        counted.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts{starts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counted[0] == counted[1]


def test_isolation_samples_do_not_depend_on_partitions(flowers):
    found = []
    for parts in (1, 16):
        rows = flowers.repartition(parts)
        found.append(sorted((r.id, r.score, r.outlier) for r in clusters.isolation_forest(rows, ["x", "y"], 0.1, 20, 32, key=["id"]).collect()))
        drawn = clusters.bottom_samples(rows.select("id"), ["id"], 20, 32, 1).groupBy("tree").agg(F.count_distinct("id").alias("n")).collect()
        assert [r.n for r in drawn] == [32] * 20
    assert found[0] == found[1]
    scores = [s for _, s, _ in found[0]]
    assert [o for _, _, o in found[0]] == [s > np.quantile(scores, 0.9) for s in scores]


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_of_three_classes(flowers, method):
    result = learning.train(flowers, "classification", "calibrated", "kind", ["x", "y"], "id", method=method, test_share=0.4)
    rows = result.predictions.collect()
    p = np.array([r.probabilities for r in rows])
    assert p.shape[1] == 3 and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    right = np.array([r.actual == r.prediction for r in rows])
    assert right.mean() > 0.85
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.15  # says how often it is right
    assert code(lambda: learning.train(flowers.where("kind <> 'c' or id = 200"), "classification", "calibrated", "kind", ["x"], "id")) == "ML_TOO_FEW_ROWS"


@pytest.mark.parametrize("model", ["decision_tree", "gradient_boosting"])
def test_trees_of_equal_features_are_fitted_on_cells(spark, monkeypatch, model):
    rows = spark.range(600).selectExpr("id as key", "double(id % 6) as x", "double(id % 5) as y", "double(id % 6 * 3 + id % 5 * (id % 6) + id % 7) as z")
    seen, plain = [], learning._cells
    fit = lambda: learning.train(rows, "regression", model, "z", ["x", "y"], "key", iterations=4).metrics.first()
    monkeypatch.setattr(learning, "_cells", lambda df: seen.append(plain(df)) or seen[-1])
    found = fit()
    assert seen[0] is not None and seen[0].columns == ["features", "label", "_weight"]
    monkeypatch.setattr(learning, "_cells", lambda df: None)
    assert list(found) == pytest.approx(list(fit()))
    assert plain(spark.range(100).selectExpr("double(id) as features", "double(id) as label")) is None

def test_forests_of_many_rows_in_few_cells_are_grown_on_cells(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as key", "double(id % 6) as x", "double(id % 5) as y", "double(id % 6 * 3 + id % 5 * (id % 6) + id % 7) as z").repartition(3)
    fit = lambda model: learning.train(rows, "regression", model, "z", ["x", "y"], "key", trees=6, preset="fast")
    plain = {m: fit(m) for m in ("random_forest", "voting")}
    assert not isinstance(plain["random_forest"].fitted, learning.Forest)
    monkeypatch.setattr(learning, "FOREST_ROWS", 1000)
    monkeypatch.setattr(learning, "BLOCK", 500)
    found = {m: fit(m) for m in ("random_forest", "voting")}
    forest = found["random_forest"].fitted
    assert isinstance(forest, learning.Forest) and isinstance(found["voting"].fitted[2], learning.Forest)
    assert forest.stages[0].getNumTrees == 1 and len(forest.stages) == 7
    assert found["random_forest"].predictions.columns == plain["random_forest"].predictions.columns
    for model, result in found.items():
        a, b = result.metrics.first(), plain[model].metrics.first()
        assert a.n == b.n and a.r2 == pytest.approx(b.r2, abs=0.05) and a.r2 > 0.8
    shares = [{r.feature: r.importance for r in f["random_forest"].importance.collect()} for f in (found, plain)]
    assert sum(shares[0].values()) == pytest.approx(1) and shares[0]["x"] == pytest.approx(shares[1]["x"], abs=0.1)
    cv = learning.cross_validate(rows, "regression", "random_forest", "z", ["x", "y"], "key", 2, trees=3).summary.first()
    assert cv["mean"] > 0.7


def test_draws_of_cells_add_up_as_draws_of_rows_do(spark, monkeypatch):
    rows, _, _ = learning.features(spark.range(20_000).selectExpr("double(id % 4) as x", "double(id % 10) as label", "id").repartition(3), ["x"])
    monkeypatch.setattr(learning, "BLOCK", 3000)
    found = learning._drawn(rows, 50, 7).collect()
    assert sorted(r.features[0] for r in found) == [0, 1, 2, 3]
    w, s = (np.array([[r[f"{c}{t}"] for t in range(50)] for r in found]) for c in "ws")
    labels = np.array([[4.0, 24.0] if r.features[0] % 2 == 0 else [5.0, 33.0] for r in found])  # means of labels and of their squares
    assert abs(w.mean() / 5000 - 1) < 0.01 and abs(w.std(axis=1) / 5000**0.5 - 1).max() < 0.4
    assert np.allclose(s.mean(axis=1) / 5000, labels[:, 0], atol=0.05)
    spread = (s - labels[:, :1] * w).std(axis=1)  # a cell's draws of its own different labels
    assert np.allclose(spread, np.sqrt(5000 * (labels[:, 1] - labels[:, 0] ** 2)), rtol=0.35)


def test_forests_on_rows_keep_partitions_small(spark, monkeypatch):
    rows, _, _ = learning.features(spark.range(400).selectExpr("double(id) as x", "double(id % 9) as label").coalesce(1), ["x"])
    seen = []
    forest = learning._estimator("regression", "random_forest", {"trees": 3}, 1, 0)
    monkeypatch.setattr(type(forest), "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    learning._forest(rows, forest, "regression")
    monkeypatch.setattr(learning, "KEPT_BYTES", 10_000)
    learning._forest(rows, forest, "regression")
    assert seen == [1, 7]


def test_silhouette_equals_brute_force(spark, flowers):
    rows = flowers.select("kind", "x", "y").unionByName(spark.createDataFrame([("z", 0.0, 9.0), ("a", 0.0, 0.0), ("a", 0.0, 0.0), ("a", None, 1.0)], "kind string, x double, y double"))
    x = [(r.kind, r.x, r.y) for r in rows.where("x is not null").collect()]
    label, point = np.array([r[0] for r in x]), np.array([r[1:] for r in x])
    gap = np.sqrt(((point[:, None] - point[None]) ** 2).sum(2))
    scores = []
    for k in range(len(x)):
        own = label == label[k]
        a = gap[k][own].sum() / max(own.sum() - 1, 1)
        b = min(gap[k][label == o].mean() for o in set(label) - {label[k]})
        scores.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    for block in (2048, 16):
        assert clusters.silhouette(rows, ["x", "y"], "kind", block).first().silhouette == pytest.approx(np.mean(scores))
    assert clusters.silhouette(rows.where("kind = 'a'"), ["x", "y"], "kind").first().silhouette is None
