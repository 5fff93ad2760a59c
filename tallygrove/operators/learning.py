"""Training, evaluation and importance with MLlib pipelines; metrics are plain aggregations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.feature import PCA, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamped, to_number
from ..functions.special import poisson_of_one
from ..plans.lineage import checkpointed, discard, if_few
from .clusters import isolation_forest, lloyd, nearest_centre, silhouette, silhouette_squared
from .describe import NUMERIC
from .neighbours import dbscan, knn_classify
from .quantiles import rounded_place, values_at
from .ranks import permuted, placed

#: What each preset stands for; fixed values.
PRESETS = {
    "fast": {"trees": 120, "extra": 160, "rounds": 80, "histogram": 100, "hidden": (32,), "iterations": 280, "elastic": 1200, "starts": 5},
    "balanced": {"trees": 200, "extra": 300, "rounds": 140, "histogram": 200, "hidden": (64, 32), "iterations": 600, "elastic": 2000, "starts": 10},
    "accurate": {"trees": 400, "extra": 500, "rounds": 220, "histogram": 350, "hidden": (128, 64, 32), "iterations": 1000, "elastic": 4000, "starts": 20},
}
#: Names that models go by; fixed values.
ALIASES = {
    "rf": "random_forest", "forest": "random_forest", "randomforest": "random_forest", "extratrees": "extra_trees",
    "hgb": "hist_gradient_boosting", "histgb": "hist_gradient_boosting", "gbt": "gradient_boosting",
    "xgb": "xgboost", "lgbm": "lightgbm", "lgb": "lightgbm", "cat": "catboost", "dt": "decision_tree",
    "nb": "naive_bayes", "gaussiannb": "naive_bayes", "k_neighbor": "knn", "k_neighbors": "knn",
    "svm": "linear_svm", "svc": "linear_svm", "svr": "linear_svm", "ada": "adaboost", "ada_boost": "adaboost",
    "elasticnet": "elastic_net", "logreg": "logistic", "logistic_regression": "logistic", "linear_regression": "linear",
    "nn": "mlp", "neural": "mlp", "ensemble": "voting", "calibration": "calibrated",
    "isolationforest": "isolation_forest", "iforest": "isolation_forest", "auto_encoder": "autoencoder",
    "moving_average": "moving_avg", "exp": "exp_smoothing", "holtwinters": "exp_smoothing",
}
#: What MLlib trains in place of a model that it lacks.
INSTEAD = {"extra_trees": "random_forest", "hist_gradient_boosting": "gradient_boosting", "xgboost": "gradient_boosting", "lightgbm": "gradient_boosting", "catboost": "gradient_boosting"}
#: Names that tasks and scorings go by, and the scoring where none is named; fixed values.
TASKS = {
    "outlier": "anomaly", "outlier_detection": "anomaly", "dim_reduction": "dimension_reduction", "dimensionality_reduction": "dimension_reduction",
    "time_series": "timeseries", "forecast": "timeseries",
}
SCORING = {
    "regression": {
        "r2": "r2", "mae": "neg_mean_absolute_error", "neg_mae": "neg_mean_absolute_error", "neg_mean_absolute_error": "neg_mean_absolute_error",
        "mse": "neg_mean_squared_error", "neg_mse": "neg_mean_squared_error", "neg_mean_squared_error": "neg_mean_squared_error",
        "rmse": "neg_root_mean_squared_error", "neg_rmse": "neg_root_mean_squared_error", "neg_root_mean_squared_error": "neg_root_mean_squared_error",
    },
    "classification": {
        "accuracy": "accuracy", "f1": "f1_weighted", "f1_weighted": "f1_weighted", "precision": "precision_weighted", "precision_weighted": "precision_weighted",
        "recall": "recall_weighted", "recall_weighted": "recall_weighted",
    },
}
DEFAULT_SCORING = {"regression": "r2", "classification": "accuracy"}
#: The metric that each scoring is made of, and its sign.
METRIC_OF = {
    "r2": ("r2", 1), "neg_mean_absolute_error": ("mae", -1), "neg_mean_squared_error": ("mse", -1), "neg_root_mean_squared_error": ("rmse", -1),
    "accuracy": ("accuracy", 1), "f1_weighted": ("f1", 1), "precision_weighted": ("precision", 1), "recall_weighted": ("recall", 1),
}
#: Metrics by which a task's result is judged, the first that there is.
PRIMARY = {"regression": ("r2",), "classification": ("accuracy",), "clustering": ("silhouette",), "anomaly": ("outlier_ratio",), "timeseries": ("mae",), "dimension_reduction": ("ratio",)}
LEAST_REGRESSION, LEAST_CLUSTERING, MANY_CLASSES, MOST_CLASSES = 8, 3, 50, 10_000
#: Forests of a regression are fitted on cells from so many rows on, and up to so many pairs of a cell and a tree, of which each task keeps 16 bytes.
FOREST_ROWS, MOST_DRAWN = 1_000_000, 4_000_000
#: Bytes of a partition that MLlib keeps to fit a forest on rows, trees that are fitted at a time, and rows that are drawn at a time.
KEPT_BYTES, AT_ONCE, BLOCK = 128 << 20, 8, 1 << 17


class LearningError(ValueError):
    """A training request that cannot be met; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class MLResult:
    """What training returns; tables are lazy."""

    task: str
    model: str
    metrics: DataFrame
    predictions: DataFrame
    importance: DataFrame | None = None
    fitted: object = None
    warnings: list[str] = field(default_factory=list)
    contract: DataFrame | None = None  # metric, value, goal, is_primary


@dataclass
class CVResult:
    """Scores of the folds, their one-row summary, and what was adjusted."""

    scores: DataFrame
    summary: DataFrame
    warnings: list[str] = field(default_factory=list)


# features and splits


def features(df: DataFrame, columns: list[str], target: str | None = None, key: str | None = None) -> tuple[DataFrame, PipelineModel, list[str]]:
    """Complete cases with features (text columns one-hot without their first level), the fitted pipeline and the terms."""
    rows = df.na.drop(subset=columns + ([target] if target else []))
    stages, inputs, names = [], [], []
    for c in columns:
        if isinstance(df.schema[c].dataType, NUMERIC):
            inputs.append(c)
            names.append(c)
        else:
            indexer = StringIndexer(inputCol=c, outputCol=f"_{c}_i", stringOrderType="alphabetDesc").fit(rows)
            encoder = OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v").fit(indexer.transform(rows))
            stages += [indexer, encoder]
            inputs.append(f"_{c}_v")
            names += [f"{c}_{x}" for x in indexer.labels[:-1]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    pipeline = PipelineModel(stages)
    return pipeline.transform(rows), pipeline, names


def _place(keys: list[str], *salt: Column) -> Column:
    """A number from 0 to 1 by a hash of the keys, the same on every run."""
    return F.pmod(F.xxhash64(*keys, *salt), F.lit(1 << 52)) / float(1 << 52)


def _thresholds(df: DataFrame, place: Column, label: str, shares: list[float]) -> Column:
    """For each class the places below which these shares of its rows lie, exactly; classes are few, or it is an error."""
    found = [r.c for r in df.select(F.col(label).cast("string").alias("c")).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(found) > MOST_CLASSES:
        raise LearningError("ML_CLASS_LABELS_REQUIRED", f"{label} has more than {MOST_CLASSES} values and is no class")
    classes = sorted(found, key=lambda c: (c is not None, c))
    values = {str(k): F.when(F.col(label).cast("string").eqNullSafe(F.lit(c)), place) for k, c in enumerate(classes)}
    found = values_at(df, values, lambda n: [min(n - 1, round(n * s)) for s in shares])
    return F.coalesce(*(F.when(F.col(label).cast("string").eqNullSafe(F.lit(c)), F.array(*map(F.lit, found[str(k)][1]))) for k, c in enumerate(classes)))


def holdout(df: DataFrame, key: list[str] | str, share: float = 0.2, seed: int = 42, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key, the same on every run; under 20 rows both are all rows.

    stratify names a class column; each class then gives the share of its rows, to within one row.
    """
    share = clamped(share, 0.05, 0.5, 0.2)
    keys = [key] if isinstance(key, str) else key
    if df.limit(20).count() < 20:
        return df, df
    place = _place(keys, F.lit(seed))
    test = place < (_thresholds(df, place, stratify, [share])[0] if stratify else F.lit(share))
    return df.where(~test), df.where(test)


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """df with fold 0..k-1 by a hash of the key; with stratify each fold has its share of each class, to within one row."""
    k = max(2, int(k))
    place = _place([key], F.lit(seed), F.lit("fold"))
    if not stratify:
        return df.withColumn("fold", F.floor(place * k).cast("int"))
    edges = _thresholds(df, place, stratify, [f / k for f in range(1, k)])
    return df.withColumn("fold", F.size(F.filter(edges, lambda e: e <= place)).cast("int"))


# metrics


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    e, y = F.col(actual) - F.col(predicted), F.col(actual).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.coalesce(1 - F.try_divide(F.avg(e * e), F.var_pop(y)), F.lit(0.0)).alias("r2"))


def residual_summary(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """min, q05, median, q95, max of the residuals: values at places in order, 5 and 95 % of the way rounded, and half of n."""
    places = lambda n: [0, rounded_place(n, 0.05), n // 2, rounded_place(n, 0.95), n - 1]
    _, found = values_at(df, {"e": F.col(actual) - F.col(predicted)}, places)["e"]
    return df.sparkSession.createDataFrame([tuple(found or [None] * 5)], "min double, q05 double, median double, q95 double, max double")


def largest_residuals(df: DataFrame, key: str, n: int = 10, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """key, actual, prediction and residual of the n rows that are furthest off."""
    found = df.select(key, F.col(actual).alias("actual"), F.col(predicted).alias("prediction"), (F.col(actual) - F.col(predicted)).alias("residual"))
    return found.orderBy(F.desc(F.abs("residual")), key).limit(n)


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """actual, predicted, n for every pair of labels."""
    counts = df.groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("x")).distinct()
    spine = labels.select(F.col("x").alias("actual")).crossJoin(F.broadcast(labels.select(F.col("x").alias("predicted"))))  # labels only
    return spine.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """accuracy and precision, recall, f1 weighted by the classes' sizes."""
    c = confusion(df, actual, predicted)
    own = c.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    called = c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("called"))
    p, r = F.coalesce(F.try_divide("hit", "called"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    rows = own.join(called, "k").select("support", "hit", p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))
    weighted = lambda x: (F.sum(F.col(x) * F.col("support")) / F.sum("support"))
    return rows.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"))


GOALS = {"r2": "higher", "mae": "lower", "mse": "lower", "rmse": "lower", "outlier_ratio": "lower", "noise": "lower", "ratio": "higher", "mape": "lower", "accuracy": "higher", "precision": "higher", "recall": "higher", "f1": "higher", "silhouette": "higher", "inertia": "lower"}


def metric_contract(metrics: DataFrame, primary: str) -> DataFrame:
    """metric, value, goal (higher or lower is better), is_primary."""
    known = [c for c in metrics.columns if c in GOALS]
    return metrics.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(GOALS[c]).alias("goal"), F.lit(c == primary).alias("is_primary")) for c in known))))


# supervised models


def _estimator(task: str, model: str, o: dict, size: int, classes: int):
    p = PRESETS.get(o.get("preset", "balanced"), PRESETS["balanced"])
    seed, common = o.get("seed", 42), {"featuresCol": "features", "labelCol": "label"}
    rounds = o.get("iterations", p["histogram"] if o.get("asked") == "hist_gradient_boosting" else p["rounds"])
    trees = o.get("trees", p["extra"] if o.get("asked") == "extra_trees" else p["trees"])
    hidden = o.get("hidden", p["hidden"])
    regression = {
        "linear": lambda: mr.LinearRegression(solver="normal", **common),
        "elastic_net": lambda: mr.LinearRegression(regParam=o.get("alpha", 0.1), elasticNetParam=o.get("l1_ratio", 0.5), standardization=False, maxIter=p["elastic"], **common),
        "decision_tree": lambda: mr.DecisionTreeRegressor(seed=seed, **common),
        "random_forest": lambda: mr.RandomForestRegressor(numTrees=trees, seed=seed, **common),
        "gradient_boosting": lambda: mr.GBTRegressor(maxIter=rounds, seed=seed, **common),
    }
    boosted = lambda: mc.GBTClassifier(maxIter=rounds, seed=seed, **common)
    classification = {
        "logistic": lambda: mc.LogisticRegression(maxIter=min(1000, p["iterations"]), **common),
        "linear": lambda: mc.LogisticRegression(maxIter=min(1000, p["iterations"]), **common),
        "decision_tree": lambda: mc.DecisionTreeClassifier(seed=seed, **common),
        "random_forest": lambda: mc.RandomForestClassifier(numTrees=trees, seed=seed, **common),
        "gradient_boosting": lambda: boosted() if classes == 2 else mc.OneVsRest(classifier=boosted(), **common),
        "naive_bayes": lambda: mc.NaiveBayes(modelType="gaussian", **common),
        "linear_svm": lambda: mc.LinearSVC(**common) if classes == 2 else mc.OneVsRest(classifier=mc.LinearSVC(**common), **common),
        "mlp": lambda: mc.MultilayerPerceptronClassifier(layers=[size, *(hidden if isinstance(hidden, (tuple, list)) else [hidden]), classes], maxIter=p["iterations"], seed=seed, **common),
    }
    known = regression if task == "regression" else classification
    if model not in known:
        raise LearningError("ML_MODEL_INVALID", f"no {task} model {model!r}")
    return known[model]()


def _counted(rows: DataFrame):
    """One row: how many rows there are, and about how many cells of equal features."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("features")).alias("cells")).first()


def _cells(rows: DataFrame, times: int = 4) -> DataFrame | None:
    """features, label and _weight: a row for all with equal features, their mean label and number; None where that makes not so many times fewer.

    Trees by variance see only counts and sums of labels, so those of the cells are those of the rows, at thresholds of all rows and not of a sample.
    """
    n = _counted(rows)
    if n.cells * times > n.rows:
        return None
    return checkpointed(rows.groupBy("features").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("_weight")))


def _drawn(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """features, w0, w1 .., s0, s1 ..: for each cell of equal features and each tree, how often its rows are drawn, and the sum of the labels drawn.

    Each tree draws each row a Poisson number of times with mean 1, as MLlib's bootstrap does. Tasks add up their own rows, so only cells are shuffled.
    """
    names = [f"{c}{t}" for c in "ws" for t in range(trees)]

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        places, sums = {}, np.zeros((2 * trees, 0))
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append((batch.column("x").flatten().to_numpy(), batch.column("label").to_numpy()))
                n += len(batch)
            if not n or batch is not None and n < BLOCK:
                continue
            x, y = np.concatenate([x for x, _ in held]).reshape(n, -1), np.concatenate([y for _, y in held])
            held, n = [], 0
            order = np.lexsort(x.T)
            x, y = x[order], y[order]
            first = np.r_[True, (x[1:] != x[:-1]).any(1)]
            at = np.array([places.setdefault(cell, len(places)) for cell in map(tuple, x[first].tolist())])[np.cumsum(first) - 1]
            sums = np.pad(sums, ((0, 0), (0, len(places) - sums.shape[1])))
            for t in range(trees):
                w = poisson_of_one(rng, len(y))
                sums[t] += np.bincount(at, w, len(places))
                sums[trees + t] += np.bincount(at, w * y, len(places))
        cells = list(places)
        for k in range(0, len(cells), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(map(list, cells[k : k + 1000]), pa.list_(pa.float64())), *map(pa.array, sums[:, k : k + 1000])], ["x", *names])

    parts = rows.select(vector_to_array("features").alias("x"), "label").mapInArrow(draw, "x array<double>, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("x").agg(*(F.sum(n).alias(n) for n in names)).withColumn("features", array_to_vector("x")).drop("x")


class Forest(PipelineModel):
    """A forest of a regression as one-tree forests and their mean."""

    def __init__(self, trees: list):
        names = [f"_tree{k}" for k in range(len(trees))]
        for name, tree in zip(names, trees, strict=True):
            tree.setPredictionCol(name)
        mean = f"select * except ({', '.join(names)}), ({' + '.join(names)}) / {len(names)} as prediction from __THIS__"
        super().__init__([*trees, SQLTransformer(statement=mean)])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Trees see each cell of equal features once; what they say of it is joined to its rows."""
        rows = dataset.withColumn("_x", vector_to_array("features"))
        cells = rows.select("_x").distinct().withColumn("features", array_to_vector("_x"))
        return rows.join(if_few(checkpointed(super()._transform(cells).select("_x", "prediction"))), "_x", "left").drop("_x")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, as MLlib's forests have it
        total = sum(tree.featureImportances.toArray() for tree in self.stages[:-1])
        return DenseVector(total / (total.sum() or 1.0))


def _forest(rows: DataFrame, estimator, task: str):
    """The estimator's forest: of a regression with many rows in few cells grown on what each tree draws of each cell, else fitted on rows."""
    n, trees, seed = _counted(rows), estimator.getNumTrees(), estimator.getSeed()
    if task == "regression" and n.rows >= FOREST_ROWS and n.cells * 4 <= n.rows and n.cells * trees <= MOST_DRAWN:
        cells = checkpointed(_drawn(rows, trees, seed))
        subset = "onethird" if trees > 1 and estimator.getFeatureSubsetStrategy() == "auto" else estimator.getFeatureSubsetStrategy()
        one = estimator.copy().setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy(subset).setWeightCol("_weight")

        def grow(t: int):
            own = cells.where(F.col(f"w{t}") > 0).select("features", (F.col(f"s{t}") / F.col(f"w{t}")).alias("label"), F.col(f"w{t}").alias("_weight"))
            return one.copy().setSeed(seed + t).fit(own)

        with ThreadPool(AT_ONCE) as pool:
            grown = pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(trees))
        discard(cells)
        return Forest(grown)
    parts = -(-n.rows * (4 * trees + 16 * len(rows.select("features").first()[0]) + 128) // KEPT_BYTES)  # a count for each tree, and the features
    return estimator.fit(rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows)


def _fitted(rows: DataFrame, task: str, model: str, options: dict, size: int, classes: int):
    """The model fitted on rows with features and label; trees of a regression on cells, where they are few."""
    estimator = _estimator(task, model, options, size, classes)
    if model == "random_forest":
        return _forest(rows, estimator, task)
    if task == "regression" and model in ("gradient_boosting", "decision_tree") and (cells := _cells(rows)) is not None:
        fitted = estimator.setWeightCol("_weight").fit(cells)
        discard(cells)
        return fitted
    return estimator.fit(rows)


class AdaBoost:
    """SAMME over shallow trees: each round weighs up the rows that the last tree missed."""

    def __init__(self, rounds: int = 10, depth: int = 1, seed: int = 42):
        self.rounds, self.depth, self.seed, self.trees = rounds, depth, seed, []

    def fit(self, rows: DataFrame, classes: int) -> AdaBoost:
        rows, self.classes, names = checkpointed(rows.withColumn("_w", F.lit(1.0))), classes, rows.columns
        for _ in range(self.rounds):
            tree = mc.DecisionTreeClassifier(maxDepth=self.depth, weightCol="_w", seed=self.seed).fit(rows)
            scored = tree.transform(rows).withColumn("_miss", (F.col("prediction") != F.col("label")).cast("double"))
            s = scored.agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_miss")).alias("e")).first()
            error = min(max(s.e / s.w, 1e-10), 1 - 1e-10)
            if error >= 1 - 1 / classes:
                break
            alpha = float(np.log((1 - error) / error) + np.log(classes - 1))
            self.trees.append((alpha, tree))
            total = s.w + (np.exp(alpha) - 1) * s.e
            before, rows = rows, checkpointed(scored.select(*names, (F.col("_w") * F.exp(alpha * F.col("_miss")) / F.lit(total)).alias("_w")))
            discard(before)
        discard(rows)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_votes", F.array_repeat(F.lit(0.0), self.classes))
        for alpha, tree in self.trees:
            out = tree.transform(out)
            out = out.withColumn("_votes", F.transform("_votes", _voter(alpha))).drop("prediction", "rawPrediction", "probability")
        return out.withColumn("prediction", (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"))


def _voter(alpha: float):
    return lambda x, i: x + F.when(F.col("prediction") == i, F.lit(alpha)).otherwise(0.0)


def _voted(rows: DataFrame, fitted: list, task: str) -> DataFrame:
    out = rows.withColumn("_id", F.monotonically_increasing_id())
    parts = []
    for k, model in enumerate(fitted):
        made = model.transform(out)
        out = made.withColumn(f"_s{k}", F.col("prediction") if task == "regression" else vector_to_array("probability")).drop("prediction", "probability", "rawPrediction")
        parts.append(F.col(f"_s{k}"))
    if task == "regression":
        return out.withColumn("prediction", sum(parts, F.lit(0.0)) / len(parts))
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    return out.withColumn("probability", F.transform(total, lambda x: x / len(parts))).withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def calibrated(train: DataFrame, test: DataFrame, key: str, method: str = "sigmoid", k: int = 3, trees: int = 40, classes: int = 2) -> DataFrame:
    """test with probabilities of all classes, prediction and calibrated: the probability of label 1 of two, else of the predicted class.

    Out-of-fold forest scores of each class go to a logistic or isotonic map of its own; with more than two classes the maps' values are
    divided by their sum (all equal, if that is 0).
    """
    rows, scores = folds(train, key, k, stratify="label"), None
    forest = mc.RandomForestClassifier(numTrees=trees, seed=42)
    of = [1] if classes == 2 else list(range(classes))
    columns = lambda: [vector_to_array("probability")[c].cast("double").alias(f"_s{c}") for c in of]
    for f in range(k):
        part = forest.fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f)).select("label", *columns())
        scores = part if scores is None else scores.union(part)
    scores = checkpointed(scores)
    out = forest.fit(rows).transform(test).select(*(c for c in test.columns if c != "features"), *columns())
    for c in of:
        own = scores.select((F.col("label") == c).cast("double").alias("label"), F.col(f"_s{c}"))
        if method == "isotonic":
            out = mr.IsotonicRegression(featuresCol=f"_s{c}", predictionCol=f"_p{c}").fit(own).transform(out)
        else:
            fitted = mc.LogisticRegression().fit(VectorAssembler(inputCols=[f"_s{c}"], outputCol="features").transform(own))
            out = out.withColumn(f"_p{c}", 1 / (1 + F.exp(-(F.col(f"_s{c}") * float(fitted.coefficients[0]) + float(fitted.intercept)))))
    if classes == 2:
        probabilities = F.array(1 - F.col("_p1"), F.col("_p1"))
    else:
        total = sum((F.col(f"_p{c}") for c in of), F.lit(0.0))
        probabilities = F.array(*(F.when(total > 0, F.col(f"_p{c}") / total).otherwise(1.0 / classes) for c in of))
    out = out.withColumn("probabilities", probabilities).drop(*(f"_{x}{c}" for c in of for x in "sp"))
    best = F.col("probabilities")[1] >= 0.5 if classes == 2 else F.array_position("probabilities", F.array_max("probabilities")) - 1
    shown = F.col("probabilities")[1] if classes == 2 else F.array_max("probabilities")
    return out.withColumns({"calibrated": shown, "prediction": best.cast("double")})


def scoring_of(task: str, name: str | None) -> str:
    """The scoring that a name stands for in a task; the task's own without a name."""
    known, name = SCORING[task], (name or "").strip().lower() or DEFAULT_SCORING[task]
    found = known.get(name, name)
    if found not in known.values():
        raise LearningError("ML_SCORING_INVALID", f"no {task} scoring {name!r}; there are {', '.join(sorted(set(known.values())))}")
    return found


def _least_class(rows: DataFrame, target: str) -> int:
    return rows.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).first().m or 0


def _checked(df: DataFrame, columns: list[str] | None, chosen: list[str], target: str | None) -> None:
    """Raises an error if columns were named that aren't there, if there are none, or if no row is complete enough."""
    if missing := [c for c in columns or () if c not in df.columns]:
        raise LearningError("ML_FEATURES_NOT_FOUND", f"no columns {', '.join(missing)}")
    if not chosen:
        raise LearningError("ML_FEATURES_REQUIRED", "no column to learn from")
    if df.na.drop(subset=[target] if target else chosen).isEmpty():
        raise LearningError("ML_EMPTY_AFTER_CLEAN", "no row has the values that it takes")


def train(df: DataFrame, task: str, model: str, target: str, columns: list[str] | None = None, key: str | None = None, **options) -> MLResult:
    """Fits and scores on a hold-out, of a classification stratified by class; key identifies rows for the split.

    task is regression or classification, or one of timeseries, clustering, dimension_reduction and anomaly, which need no
    target but a time series' and give their own tables as predictions. scoring names the primary metric.
    """
    task, scoring = TASKS.get(task, task), options.get("scoring")
    if task not in ("regression", "classification"):
        return _without_target(df, task, ALIASES.get(model, model), target, columns, key, options)
    scoring = scoring_of(task, scoring) if scoring is not None else None
    if target not in df.columns:
        raise LearningError("ML_TARGET_REQUIRED", f"no column {target!r}")
    if target in ("label", "actual", "prediction", "features"):  # names that fitting and scoring add
        df, target = df.withColumnRenamed(target, f"_{target}"), f"_{target}"
    warnings, asked = [], ALIASES.get(model, model)
    model = INSTEAD.get(asked, asked)
    if model != asked:
        warnings.append(f"{asked} is trained as {model}.")
    if options.get("preset", "balanced") not in PRESETS:
        warnings.append("An unknown preset is taken as balanced.")
    options = options | {"asked": asked}
    columns = columns or [f.name for f in df.schema if f.name not in (target, key) and isinstance(f.dataType, NUMERIC)]
    _checked(df, columns, columns, target)
    rows, _, names = features(df, columns, target)
    if task == "regression":
        rows, labels = rows.withColumn("label", to_number(F.col(target))).where("label is not null"), None
        if rows.limit(LEAST_REGRESSION).count() < LEAST_REGRESSION:
            raise LearningError("ML_TOO_FEW_ROWS", f"regression needs {LEAST_REGRESSION} rows with a number")
    else:
        indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
        rows, labels = indexer.transform(rows), indexer.labels
    classes = len(labels) if labels else 0
    if task == "classification" and classes < 2:
        raise LearningError("ML_CLASS_LABELS_REQUIRED", "the target has fewer than two classes")
    if classes > MANY_CLASSES:
        warnings.append(f"{classes} classes make metrics unstable.")
    fit_rows, test = holdout(rows, key or columns, options.get("test_share", 0.2), stratify="label" if labels else None)
    if model == "adaboost" and labels:
        fitted = AdaBoost(options.get("rounds", 10)).fit(fit_rows.select("features", "label"), classes)
        predicted = fitted.transform(test)
    elif model == "knn" and labels:
        fitted, numbered = None, rows.withColumn("_key", F.xxhash64(*([key] if key else columns)))
        fit_rows, test = holdout(numbered, "_key", options.get("test_share", 0.2), stratify="label")
        near = knn_classify(fit_rows, test, columns, "label", "_key", options.get("k", 5))
        predicted = test.join(near.dropDuplicates(["_key"]).withColumn("prediction", F.col("prediction").cast("double")), "_key")
    elif model == "calibrated" and labels:
        least, k = _least_class(fit_rows, "label"), max(2, int(options.get("folds", 3)))
        if least < 2:
            raise LearningError("ML_TOO_FEW_ROWS", "calibration needs two rows of each class to fit")
        if k > least:
            k = least
            warnings.append(f"Calibration takes {k} folds, as the smallest class has no more rows.")
        numbered = fit_rows.withColumn("_key", F.xxhash64(*([key] if key else columns)))
        fitted, predicted = None, calibrated(numbered, test, "_key", options.get("method", "sigmoid"), k, options.get("trees", 40), classes)
    elif model == "voting":
        options = {"trees": 40} | options
        members = ["linear", "decision_tree", "random_forest"] if task == "regression" else ["logistic", "decision_tree", "random_forest"]
        fitted = [_fitted(fit_rows, task, m, options, len(names), classes) for m in members]
        predicted = _voted(test, fitted, task)
    else:
        fitted = _fitted(fit_rows, task, model, options, len(names), classes)
        predicted = fitted.transform(test)
    if labels:
        word = F.array(*map(F.lit, labels))
        predicted = predicted.withColumns({"actual": F.col(target).cast("string"), "prediction": word[F.col("prediction").cast("int")]})
        metrics = classification_metrics(predicted)
    else:
        predicted = predicted.withColumn("actual", F.col("label"))
        metrics = regression_metrics(predicted)
    contract = metric_contract(metrics, METRIC_OF[scoring or DEFAULT_SCORING[task]][0])
    if scoring is not None:
        metrics = contract
    return MLResult(task, model, metrics, predicted, importance(fitted, names, df) if fitted is not None else None, fitted, warnings, contract)


def _without_target(df: DataFrame, task: str, model: str, target: str | None, columns: list[str] | None, key: str | None, o: dict) -> MLResult:
    preset = PRESETS.get(o.get("preset", "balanced"), PRESETS["balanced"])
    columns = columns or [f.name for f in df.schema if f.name not in (target, key) and isinstance(f.dataType, NUMERIC)]
    unknown = LearningError("ML_MODEL_INVALID", f"no {task} model {model!r}")
    if task not in PRIMARY:
        raise LearningError("ML_TASK_INVALID", f"no task {task!r}")
    ignored = ["Folds and scorings are for regression and classification."] if o.get("scoring") else []
    if task == "timeseries":
        from . import series

        if not target:
            raise LearningError("ML_TARGET_REQUIRED", "a series needs a target")
        if model not in ("naive", "seasonal_naive", "moving_avg", "exp_smoothing", "ar", "arima"):
            raise unknown
        extra = {n: o[n] for n in ("horizon", "window", "trend", "season", "lags", "difference") if n in o}
        found = checkpointed(series.forecast(df, o["time"], target, o.get("keys", []), "ar" if model == "arima" else model, **extra))
        metrics = series.forecast_metrics(found, o.get("keys", []))
        return MLResult(task, model, metrics, found, warnings=ignored, contract=metric_contract(metrics, "mae"))
    _checked(df, columns, columns, None)
    if task == "clustering":
        if model == "kmeans":
            n, k = df.na.drop(subset=columns).count(), max(2, int(o.get("k", 3)))
            if n < LEAST_CLUSTERING:
                raise LearningError("ML_TOO_FEW_ROWS", f"clustering needs {LEAST_CLUSTERING} rows")
            if k >= n:
                k = max(2, n - 1)
                ignored.append(f"There are rows for {k} clusters.")
            rows, inertia, centres = kmeans(df, columns, k, o.get("starts", preset["starts"]), o.get("seed", 42))
            noise = F.lit(0).cast("long")
        elif model == "dbscan" and key:
            found = dbscan(df, key, columns, o.get("eps", 0.5), o.get("min_samples", 5))
            rows, inertia, centres = df.join(found, key), None, None
            noise = F.count_if(F.col("cluster") < 0)
        else:
            raise unknown
        rows = checkpointed(rows.drop("features"))
        counted = rows.agg(F.lit(inertia).cast("double").alias("inertia"), noise.alias("noise"), F.try_divide(noise, F.count(F.lit(1))).alias("noise_ratio"))
        score = {"euclidean": silhouette, "squared": silhouette_squared}[o.get("silhouette", "euclidean")]
        metrics = checkpointed(score(rows.where("cluster >= 0"), columns).crossJoin(F.broadcast(counted)))
        if rows.where("cluster >= 0").select("cluster").distinct().limit(2).count() < 2:
            ignored.append("There are fewer than two clusters.")
        return MLResult(task, model, metrics, rows, cluster_summary(rows), centres, ignored, metric_contract(metrics, "silhouette"))
    if task == "dimension_reduction":
        if model != "pca":
            raise unknown
        rows, ratios, loadings = pca(df, columns, o.get("k", 2))
        best = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
        top = loadings.withColumn("rank", F.row_number().over(best)).where("rank <= 10")
        return MLResult(task, model, ratios, rows, top, warnings=ignored, contract=metric_contract(ratios.agg(F.sum("ratio").alias("ratio")), "ratio"))
    if task == "anomaly":
        share = o.get("contamination")
        if share is not None and not 0 < share <= 0.5:
            share = None
            ignored.append("An invalid contamination is left out.")
        if model == "isolation_forest":
            rows, score = isolation_forest(df, columns, share, o.get("trees", preset["trees"]), key=[key] if key else None), "score"
        elif model == "autoencoder":
            rows, score = reconstruction_anomalies(df, columns, o.get("k", 1), share or 0.05), "error"
        else:
            raise unknown
        rows = checkpointed(rows)
        metrics = rows.agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("least"), F.avg(score).alias("mean"), F.max(score).alias("most"), F.avg(F.col("outlier").cast("int")).alias("outlier_ratio"))
        return MLResult(task, model, metrics, rows, warnings=ignored, contract=metric_contract(metrics, "outlier_ratio"))
    raise unknown


def importance(fitted, names: list[str], df: DataFrame, top: int = 20) -> DataFrame | None:
    """feature, importance: impurity decrease, else absolute coefficients."""
    values = None
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficients"):
        try:
            values = np.abs(fitted.coefficients.toArray())
        except Exception:  # a multinomial model has a matrix only
            values = np.abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    if values is None:
        return None
    rows = sorted(zip(names, map(float, values), strict=True), key=lambda r: (-r[1], r[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _exchanged(n: int, seed: int):
    @F.pandas_udf("long")
    def place(p: pd.Series) -> pd.Series:
        return pd.Series(permuted(p.to_numpy(np.int64), n, seed))

    return place


def permutation_importance(fitted, test: DataFrame, columns: list[str], assembler_input: list[str], score, repeats: int | None = None, seed: int = 42, most: int = 20) -> DataFrame:
    """feature, mean, std of how much score(predictions) falls when one column is permuted over all rows; the largest means by size.

    Repeats are 5 up to 1200 rows and 3 above, if not given. The rows have places 0 to n - 1 in the order of their values; a bijection of
    places, other in each repeat, says from which row each takes its value, by one join for all columns.
    """
    assembler = VectorAssembler(inputCols=assembler_input, outputCol="features")
    rows, n = placed(test.select("label", *assembler_input), [*assembler_input, "label"])
    rows = checkpointed(rows)
    repeats = repeats or (5 if n <= 1200 else 3)
    base, drops = score(fitted.transform(assembler.transform(rows))), {c: [] for c in columns}
    for r in range(repeats):
        donors = rows.select(_exchanged(n, seed + r)("place").alias("place"), *(F.col(c).alias(f"_d{k}") for k, c in enumerate(columns)))
        mixed = checkpointed(rows.join(donors, "place"))
        for k, c in enumerate(columns):
            drops[c].append(base - score(fitted.transform(assembler.transform(mixed.withColumn(c, F.col(f"_d{k}"))))))
        discard(mixed)
    out = sorted(((c, float(np.mean(d)), float(np.std(d))) for c, d in drops.items()), key=lambda x: -abs(x[1]))[:most]
    return test.sparkSession.createDataFrame(out, "feature string, mean double, std double")


def cross_validate(df: DataFrame, task: str, model: str, target: str, columns: list[str], key: str, k: int = 5, scoring: str | None = None, **options) -> CVResult:
    """A score and all metrics of each fold, and their summary.

    There are no more folds than rows, or than rows of the smallest class, which has to have two; folds are stratified by class.
    """
    scoring, warnings = scoring_of(task, scoring), []
    _checked(df, columns, columns, target)
    rows, _, names = features(df, columns, target)
    labels = None
    if task == "classification":
        indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
        rows, labels = indexer.transform(rows), indexer.labels
        if len(labels) < 2:
            raise LearningError("ML_CLASS_LABELS_REQUIRED", "the target has fewer than two classes")
        most, reason = _least_class(rows, "label"), "as the smallest class has no more rows"
    else:
        rows = rows.withColumn("label", to_number(F.col(target))).where("label is not null")
        most, reason = rows.count(), "as there are no more rows"
    if most < 2:
        raise LearningError("ML_TOO_FEW_ROWS", "folds need two rows, of each class in a classification")
    if k > most:
        k = most
        warnings.append(f"{k} folds are made, {reason}.")
    named = ALIASES.get(model, model)
    options = options | {"asked": named}
    rows, out = checkpointed(folds(rows.select("label", "features", key), key, k, stratify="label" if labels else None)), None
    metric, sign = METRIC_OF[scoring]
    for f in range(max(2, k)):
        fitted = _fitted(rows.where(F.col("fold") != f), task, INSTEAD.get(named, named), options, len(names), len(labels or ()))
        predicted = fitted.transform(rows.where(F.col("fold") == f))
        metrics = regression_metrics(predicted, "label") if task == "regression" else classification_metrics(predicted, "label")
        metrics = metrics.withColumns({"fold": F.lit(f), "score": F.col(metric) * sign})
        out = metrics if out is None else out.unionByName(metrics)
    scores = checkpointed(out)
    return CVResult(scores, cv_summary(scores, scoring), warnings)


def cv_summary(scores: DataFrame, scoring: str) -> DataFrame:
    """folds, scoring, mean, std (of the folds as a whole), min and max of the scores."""
    return scores.agg(F.count("score").alias("folds"), F.lit(scoring).alias("scoring"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


def gaussian_naive_bayes(train: DataFrame, test: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    """key, prediction from per-class means and variances (1e-9 of the largest variance is added to each)."""
    x = lambda c: F.col(c).cast("double")
    most = train.agg(F.greatest(*(F.var_pop(x(c)) for c in columns), F.lit(0.0)).alias("m")).first().m * 1e-9
    sums = train.groupBy(F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x(c)).alias(f"m{i}") for i, c in enumerate(columns)), *((F.var_pop(x(c)) + most).alias(f"v{i}") for i, c in enumerate(columns)))
    classes = sums.orderBy("k").collect()  # one row a class
    total = sum(c.n for c in classes)

    def log(c) -> Column:
        parts = [-0.5 * F.log(F.lit(2 * np.pi * c[f"v{i}"])) - (x(name) - c[f"m{i}"]) ** 2 / (2 * c[f"v{i}"]) for i, name in enumerate(columns)]
        return sum(parts, F.lit(float(np.log(c.n / total))))

    best = F.greatest(*(F.struct(log(c).alias("l"), F.lit(-i).alias("i"), F.lit(c.k).alias("k")) for i, c in enumerate(classes))) if len(classes) > 1 else F.struct(F.lit(classes[0].k).alias("k"))
    return test.select(key, best["k"].alias("prediction"))


# clusters and anomalies


def kmeans(df: DataFrame, columns: list[str], k: int = 3, starts: int = 10, seed: int = 42):
    """(rows with cluster, inertia, centroids): the best of several starts, which are improved together."""
    rows, _, _ = features(df, columns)
    rows = rows.withColumn("_x", vector_to_array("features"))
    centres, inertia = lloyd(rows.select(F.col("_x").alias("x")), k, starts, seed)
    number = nearest_centre(F.col("_x"), centres) if len(centres) else F.lit(None)
    return rows.withColumn("cluster", number.cast("int")).drop("_x"), inertia, list(centres)


def centroid_preview(df: DataFrame, centres: list, columns: list[str], most: int = 3, features: int = 6) -> DataFrame:
    """cluster, feature, value of the first centres and features."""
    rows = [(c, name, float(v)) for c, centre in enumerate(centres[:most]) for name, v in list(zip(columns, centre, strict=True))[:features]]
    return df.sparkSession.createDataFrame(rows, "cluster int, feature string, value double")


def projection_preview(rows: DataFrame, key: str, most: int = 20) -> DataFrame:
    """key and projection of the rows with the smallest keys."""
    return rows.select(key, "projection").orderBy(key).limit(most)


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, size, ratio; cluster -1 is noise."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))).select(cluster, "size", (F.col("size") / F.col("_n")).alias("ratio"))


def pca(df: DataFrame, columns: list[str], k: int = 2):
    """(projection rows, ratios, loadings): centred components, explained shares, and term loadings by component."""
    rows, _, names = features(df, columns)
    centred = StandardScaler(inputCol="features", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="projection").fit(centred)
    spark = df.sparkSession
    ratios = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, ratio double")
    loadings = spark.createDataFrame([(n, j + 1, float(model.pc.toArray()[i, j])) for i, n in enumerate(names) for j in range(k)], "feature string, component int, loading double")
    return model.transform(centred).withColumn("projection", vector_to_array("projection")), ratios, loadings


def reconstruction_anomalies(df: DataFrame, columns: list[str], k: int = 1, contamination: float = 0.05) -> DataFrame:
    """df with error (mean square over columns of what the k main components leave) and outlier.

    Outliers are errors of at least the value whose place, from 0, is the floor of (1 - contamination) (n - 1).
    """
    rows, _, loadings = pca(df, columns, k)
    w = np.zeros((len(columns), k))
    for r in loadings.collect():
        w[columns.index(r.feature), r.component - 1] = r.loading
    means = df.na.drop(subset=columns).agg(*(F.avg(c).alias(c) for c in columns)).first()
    x = [F.col(c).cast("double") - means[c] for c in columns]
    score = [sum((x[i] * float(w[i, j]) for i in range(len(columns))), F.lit(0.0)) for j in range(k)]
    error = sum(((x[i] - sum((s * float(w[i, j]) for j, s in enumerate(score)), F.lit(0.0))) ** 2 for i in range(len(columns))), F.lit(0.0))
    rows = checkpointed(rows.drop("features", "_c", "projection").withColumn("error", error / len(columns)))
    share = contamination if 0 < contamination < 0.5 else 0.05
    n, found = values_at(rows, {"e": F.col("error")}, lambda n: [int((1 - share) * (n - 1))])["e"]
    return rows.withColumn("outlier", F.col("error") >= F.lit(found[0] if n else None))


def export_model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)
