"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are hashes of words and of word beginnings of 4, 5 and 6 bytes, which carry over to unseen inflections;
the model's are those whose log odds between the labelled classes lie LEAST_Z (a parameter) standard errors from none, on either
side, and a ridge shrinks them. Grades: a text labelled not toxic is 0; toxic training texts are graded 1 to 3 by thirds
of the score that a binary model of the other folds gives them. The model is P(grade <= k) = sigmoid(theta_k - w.x)
with one weight vector for all thresholds and x = log(1 + count). Its output is the expected grade, and a text is
rejected when a grade of 1 or more has a probability of REJECT.

Scale: fitted on at most SAMPLE labelled texts of each class, taken by a hash of the id and weighted by how
many labels each stands for, so that probabilities mean the same at every size. Of copies and near copies with one label
one is used, so that a copied text does not make all its words toxic. Term counts of these texts are aggregated
in Spark and at most VOCABULARY terms are kept. Scoring is one pass without a shuffle with a model of bounded size.

Defined cases: a null or wordless text has no features and the base rate's grade, which isn't rejected
unless most labels are toxic; labels with a null id or value aren't used, and a text labelled twice
counts once, as toxic if one label says so (texts that are equal under two ids keep both labels); without labels of both kinds the severity is 0 and nothing is rejected;
of terms with equal odds the smaller hash is kept; very long texts are scored whole; repeated rows are
scored each; an empty table gives no rows; extra columns pass through, but columns with the results' names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._sample import hashed_sample
from ._text import LOWER, Words, bounded_batches, mixed, sliced
from .dedup import shingles

SAMPLE, VOCABULARY, LEAST_TEXTS, LEAST_Z = 6000, 8_000, 3, 2.5
GRADES, FOLDS, RIDGE, REJECT = 3, 3, 0.5, 0.3  # grades above 0
RESULTS = ("severity", "p_toxic", "rejected")


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of each word and of the beginnings of longer words; repeated as they occur."""
    rows, found = [words.row], [words.hash]
    begin = words.offsets[words.row] + words.start
    length = words.end - words.start
    code = np.zeros(len(begin), np.uint64)
    for j in range(6):
        some = length > j
        code[some] |= LOWER[words.data[begin[some] + j]].astype(np.uint64) << np.uint64(8 * j)
        if j >= 3:
            longer = length > j + 1
            rows.append(words.row[longer])
            found.append(mixed(code[longer] + np.uint64((j + 1) << 56)))
    return np.concatenate(rows), np.concatenate(found)


def counted(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with counts, ordered."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[at], feature[at], np.diff(np.concatenate([at, [len(row)]]))


def _term_counts(batches):
    """feature, toxic, other: in how many texts of each class a feature is."""
    for batch in sliced(batches):
        row, feature, _ = counted(*features(Words(batch.column(0))))
        toxic = np.asarray(batch.column(1))[row] > 0
        names, which = np.unique(feature, return_inverse=True)
        sums = [np.bincount(which, weights=w, minlength=len(names)).astype(np.int64) for w in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *map(pa.array, sums)], names=["feature", "toxic", "other"])


def looked_up(vocabulary: np.ndarray, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of known features, as places in the sorted vocabulary."""
    if not len(vocabulary):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
    known = vocabulary[at] == feature
    return row[known], at[known]


def _vectors(vocabulary: np.ndarray):
    def run(batches):
        for batch in sliced(batches):
            words = Words(batch.column(0))
            row, at, n = counted(*looked_up(vocabulary, *features(words)))
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (at, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], names=["toxic", "place", "at", "n"])

    return run


class CumulativeLink:
    """Weights of features and ordered thresholds."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        kept = weights != 0
        self.vocabulary, self.weights, self.thresholds = vocabulary[kept], weights[kept], thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    def scores(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        row, at, n = counted(*looked_up(self.vocabulary, *features(words)))
        return np.bincount(row, weights=self.weights[at] * np.log1p(n), minlength=words.rows)


def _near_copy_key(batches):
    """text, toxic and two minima of hashed shingles, which near copies mostly share."""
    for batch in sliced(batches):
        row, value, _ = shingles(Words(batch.column(0)), 3)
        keys = []
        for salt in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03):
            low = np.full(batch.num_rows, np.iinfo(np.uint64).max)
            np.minimum.at(low, row, mixed(value + np.uint64(salt)))
            keys.append(pa.array(low.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=["text", "toxic", "k1", "k2"])


def loss_and_gradient(params: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, grades: int, part: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Of the weighted mean log loss with a ridge; params are weights, the first threshold and log gaps to the others."""
    n, each = len(grade), np.arange(len(grade))
    weights, gaps = params[:size], np.exp(params[size + 1 :])
    thresholds = params[size] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.bincount(rows, weights=weights[at] * value, minlength=n)
    inner = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -500, 500)))
    edges = np.concatenate([np.zeros((n, 1)), inner, np.ones((n, 1))], axis=1)
    slope = edges * (1 - edges)
    p = np.maximum(edges[each, grade + 1] - edges[each, grade], 1e-12)
    upper, lower = slope[each, grade + 1] / p * part, slope[each, grade] / p * part
    d_theta = np.array([lower[grade == k + 1].sum() - upper[grade == k].sum() for k in range(grades)])
    d_gaps = np.cumsum(d_theta[::-1])[::-1][1:] * gaps
    d_weights = np.bincount(at, weights=(upper - lower)[rows] * value, minlength=size) + l2 * weights
    loss = -(part * np.log(p)).sum() + l2 / 2 * (weights**2).sum()
    return float(loss), np.concatenate([d_weights, [d_theta.sum()], d_gaps])


def fit_cumulative_link(rows: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, steps: int = 400, ridge: float = RIDGE, stands: np.ndarray | None = None, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam; stands: how many rows each stands for. With one grade it is logistic regression."""
    n = len(grade)
    part = np.full(n, 1 / n) if stands is None else stands / stands.sum()
    share = np.array([part[grade > k].sum() for k in range(grades)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    params = np.concatenate([np.zeros(size), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        _, gradient = loss_and_gradient(params, rows, at, value, grade, size, grades, part, ridge / n)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:size], params[size] + np.concatenate([[0], np.cumsum(np.exp(params[size + 1 :]))])


def cross_fitted(rows: np.ndarray, at: np.ndarray, value: np.ndarray, toxic: np.ndarray, size: int, fold: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """Each row's score by a binary model that the rows of other folds made."""
    out = np.zeros(len(toxic))
    for k in range(FOLDS):
        train = fold != k
        if not toxic[train].any() or toxic[train].all():
            continue
        number = np.cumsum(train) - 1
        used = train[rows]
        weights, _ = fit_cumulative_link(number[rows[used]], at[used], value[used], toxic[train].astype(int), size, 150, stands=stands[train], grades=1)
        scores = np.bincount(rows, weights=weights[at] * value, minlength=len(toxic))
        out[~train] = scores[~train]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, vocabulary_size: int = VOCABULARY, least_texts: int = LEAST_TEXTS, least_z: float = LEAST_Z) -> CumulativeLink | None:
    """A model from labelled texts; None without labels of both kinds.

    Terms are those that least_texts texts hold and whose log odds lie least_z standard errors from none, the vocabulary_size furthest
    ones at most. Rows are fitted in the order of a hash of their words, which also deals them to folds, so the model doesn't depend on partitions.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    classes = {r._toxic: r["count"] for r in known.groupBy("_toxic").count().collect()}
    stands = [max(1.0, classes.get(k, 0) / sample) for k in (0, 1)]
    picked = [hashed_sample(known.where(F.col("_toxic") == k), F.xxhash64("_id"), sample, classes.get(k, 0)) for k in (0, 1)]
    picked = picked[0].union(picked[1]).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "_id")
    texts = texts.select("text", F.col("_toxic").alias("toxic")).mapInArrow(_near_copy_key, "text string, toxic int, k1 long, k2 long")
    texts = texts.groupBy("k1", "k2", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", F.xxhash64("k1", "k2", "toxic").alias("place")).persist()
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        texts.unpersist()
        return None
    terms = texts.mapInArrow(_term_counts, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    inside, outside = F.col("t") + 0.5, F.col("o") + 0.5
    rest_in, rest_out = F.lit(sizes[1] + 1.0) - inside, F.lit(sizes[0] + 1.0) - outside
    z = F.abs(F.log(inside * rest_out / (outside * rest_in))) / F.sqrt(1 / inside + 1 / outside + 1 / rest_in + 1 / rest_out)
    terms = terms.where(F.col("t") + F.col("o") >= least_texts).withColumn("z", z).where(F.col("z") >= least_z)
    terms = terms.orderBy(F.desc("z"), "feature").limit(vocabulary_size).select("feature").toPandas()
    vocabulary = np.sort(terms["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    data = texts.mapInArrow(_vectors(vocabulary), "toxic int, place long, at array<int>, n array<int>").toPandas().sort_values("place", ignore_index=True)
    texts.unpersist()
    counts = np.array([len(x) for x in data["at"]])
    rows = np.repeat(np.arange(len(data)), counts)
    at = np.concatenate([np.asarray(x, np.int64) for x in data["at"]]) if len(data) else np.zeros(0, np.int64)
    n = np.concatenate([np.asarray(x, np.float64) for x in data["n"]]) if len(data) else np.zeros(0)
    toxic = data["toxic"].to_numpy() > 0
    weight, size = np.where(toxic, stands[1], stands[0]), len(vocabulary)
    scores = cross_fitted(rows, at, np.log1p(n), toxic, size, data["place"].to_numpy() % FOLDS, weight)
    cuts = np.quantile(scores[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, scores, side="right"), 0)
    weights, thresholds = fit_cumulative_link(rows, at, np.log1p(n), grade, size, stands=weight)
    return CumulativeLink(vocabulary, weights, thresholds)


def grade_texts(docs: DataFrame, model: CumulativeLink | None, text_col: str = "text", keep_text: bool = True, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """docs with severity (expected grade, 0 to 3), p_toxic and rejected, under the names in results."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*results)
    names = [c for c in docs.columns if keep_text or c != text_col]
    if model is None:
        return docs.withColumns(dict(zip(results, (F.lit(0.0), F.lit(0.0), F.lit(False)), strict=True))).select(*names, *results)
    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, t) for n, t in zip(results, kinds, strict=True)])

    def run(batches):
        for batch in sliced(batches, column=text_col):
            above = model.above(model.scores(batch.column(batch.schema.get_field_index(text_col))))
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= REJECT)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op6_cumulative_link_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of every document: doc_id, severity, p_toxic, rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grade_texts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep_text=False)
