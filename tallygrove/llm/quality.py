"""Text quality from a weak-label model and a hashed linear scorer.

Overlapping heuristics each call a text good, bad or neither. Expectation-maximisation over the counts of
their vote patterns estimates how often each votes which way on good and on bad texts, with the share of
good ones; the posterior of a text's pattern is its label. A linear scorer on hashed word shapes, byte
trigrams and repetitions is trained on posterior labels and scores every text.

Scale: votes are a few numbers a text, and all texts' patterns are counted in Spark (at most 3**6 reach
the driver), so the label model covers everything. The scorer is trained on at most SAMPLE texts of any length,
taken by a hash of their text, of whose features it sees how often each bucket occurs. Votes and scores are made in single passes without a shuffle.

Defined cases: a null or wordless text has score 0, is bad and isn't kept; repeated rows each get a row;
wordless texts aren't counted for the label model; very long texts are read whole; a score of exactly 0.5 is kept; an
empty table gives no rows; only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import hashed_sample
from ._text import IS_WORD, LOWER, Words, bounded_batches, mixed, sliced

SAMPLE, BUCKETS = 6000, 1 << 16
FALSE_ALARMS = 0.001  # a heuristic calls at most so many good texts bad; else EM takes a common fault for normal
#: The heuristics, in the order of their votes.
LABELLERS = ("symbols", "capitals", "repeats", "variety", "sentences", "word_length")


def _per_row(words: Words, flags: np.ndarray) -> np.ndarray:
    """Sums of flags by row; flags has a number for each byte or word."""
    edges = words.offsets if len(flags) == len(words.data) else words.first
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])


def votes(words: Words) -> np.ndarray:
    """1 good, 0 bad or -1 neither, by row and labeller."""
    d = words.data
    size, n = np.maximum(np.diff(words.offsets), 1), np.maximum(words.counts, 1)
    plain = IS_WORD[LOWER[d]] | np.isin(d, np.frombuffer(b" \n\t.,'", np.uint8))
    symbols = 1 - _per_row(words, plain) / size
    letters = np.maximum(_per_row(words, (LOWER[d] >= 97) & (LOWER[d] <= 122)), 1)
    capitals = _per_row(words, (d >= 65) & (d <= 90)) / letters
    again = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])]) if len(words.hash) else np.zeros(0, bool)
    repeats = _per_row(words, again) / n
    order = np.lexsort((words.hash, words.row))
    h, r = words.hash[order], words.row[order]
    distinct = np.bincount(r[np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])] if len(r) else r, minlength=words.rows)
    variety = distinct / np.sqrt(n)
    stops = _per_row(words, d == 46) / n
    length = _per_row(words, IS_WORD[LOWER[d]]) / n
    pick = lambda bad, good: np.where(bad, 0, np.where(good, 1, -1))
    out = np.stack(
        [
            pick((symbols > 0.03) & (symbols * size > 8), symbols < 0.01),
            pick((capitals > 0.3) & (letters > 60), capitals < 0.08),
            pick((repeats > 0.1) & (words.counts > 10), repeats < 0.03),
            pick((variety < 2.5) & (words.counts > 40), variety > 4.0),
            pick((stops < 0.01) & (words.counts > 40), (stops > 0.03) & (stops < 0.3)),
            pick((length < 2.0) | (length > 12.0), (length > 3.0) & (length < 9.0)),
        ],
        axis=1,
    )
    out[words.counts == 0] = 0
    return out


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word's shape with what follows it, of repeated words, and of byte trigrams."""
    d = words.data
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = words.offsets[words.row] + words.start, words.offsets[words.row] + words.end
    padded = np.concatenate([d, np.zeros(4, np.uint8)])
    upper = (d >= 65) & (d <= 90)
    caps = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    n_caps = caps[end] - caps[begin]
    shape = np.where(n_caps == 0, 0, np.where(n_caps * 2 > end - begin, 2, 1)) + 3 * np.minimum((end - begin) // 3, 6)
    follows = padded[end].astype(np.int64) | padded[end + 1].astype(np.int64) << 8
    follows = np.where(IS_WORD[LOWER[padded[end + 1]]], follows & 255, follows)
    again = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])])
    bucket = lambda x, salt: (mixed(x.astype(np.uint64) + np.uint64(salt << 48)) % np.uint64(BUCKETS)).astype(np.int64)
    trigram = LOWER[padded[:-4]].astype(np.int64) | LOWER[padded[1:-3]].astype(np.int64) << 8 | LOWER[padded[2:-2]].astype(np.int64) << 16
    at = begin  # one trigram a word, where it begins
    rows = [words.row, words.row, words.row]
    found = [bucket(shape | follows << 8, 1), bucket(again.astype(np.int64), 2), bucket(trigram[at], 3)]
    return np.concatenate(rows), np.concatenate(found)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM on vote patterns: share of good, P(vote | bad or good) by labeller and vote, posterior of good by pattern.

    Starts from the belief that a bad vote is right and silence means little: the heuristics are for
    different faults, so on a bad text most of them see nothing wrong.
    """
    counts = counts.astype(np.float64)
    posterior = np.where((patterns == 0).any(axis=1), 0.05, 0.95)
    share, chance = 0.5, np.ones((2, patterns.shape[1], 3)) / 3
    for _ in range(rounds):
        weights = np.stack([(1 - posterior) * counts, posterior * counts])
        share = (weights[1].sum() + 1) / (counts.sum() + 2)
        for v in (-1, 0, 1):
            chance[:, :, v + 1] = (weights @ (patterns == v) + 1) / (weights.sum(axis=1, keepdims=True) + 3)
        alarms = np.minimum(chance[1, :, 1], FALSE_ALARMS)
        chance[1, :, ::2] *= ((1 - alarms) / (1 - chance[1, :, 1]))[:, None]
        chance[1, :, 1] = alarms
        log = np.log([1 - share, share])[:, None] + sum(np.log(chance[:, j, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return share, chance, posterior


class Scorer:
    """Weights by bucket; a text's score is the sigmoid of their mean over its features, scaled."""

    SCALE = 20.0

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def gradient(weights: np.ndarray, bias: float, rows: np.ndarray, at: np.ndarray, share: np.ndarray, target: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
        """Of the mean log loss with a ridge; share: the part that an entry is of its row's features, scaled."""
        z = np.bincount(rows, weights=weights[at] * share, minlength=len(target)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / len(target)
        return np.bincount(at, weights=error[rows] * share, minlength=BUCKETS) + l2 * weights, error.sum()

    @staticmethod
    def fit(rows: np.ndarray, at: np.ndarray, n: np.ndarray, size: int, target: np.ndarray, steps: int = 300, l2: float = 1e-6) -> Scorer:
        share = Scorer.SCALE * n / np.maximum(np.bincount(rows, weights=n, minlength=size), 1)[rows]
        weights, bias = np.zeros(BUCKETS), 0.0
        m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
        for t in range(1, steps + 1):
            g, gb = Scorer.gradient(weights, bias, rows, at, share, target, l2)
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            weights = weights - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            bias = bias - 0.05 * (mb / (1 - 0.9**t)) / ((vb / (1 - 0.999**t)) ** 0.5 + 1e-8)
        return Scorer(weights, bias)

    def scores(self, words: Words) -> np.ndarray:
        row, at = hashed(words)
        n = np.maximum(np.bincount(row, minlength=words.rows), 1)
        z = self.SCALE * np.bincount(row, weights=self.weights[at], minlength=words.rows) / n + self.bias
        return np.where(words.counts > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def _code(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _pattern_counts(batches):
    sums = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in sliced(batches):
        words = Words(batch.column(0))
        sums += np.bincount(_code(votes(words))[words.counts > 0], minlength=len(sums))
    seen = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["code", "n"])


class QualityModel:
    """The label model's posteriors by vote pattern, and the scorer."""

    def __init__(self, posterior: np.ndarray, chance: np.ndarray, share: float, scorer: Scorer | None):
        self.posterior, self.chance, self.share, self.scorer = posterior, chance, share, scorer


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """The label model of all of docs, and the scorer from a sample of them."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    seen = texts.mapInArrow(_pattern_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    codes, counts = seen["code"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)
    every = np.arange(3 ** len(LABELLERS))[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    share, chance, known = fit_labellers(every[codes], counts)
    posterior = np.full(len(every), share)
    posterior[codes] = known
    order = F.xxhash64("text", F.lit("quality"))
    picked = texts.where(F.length("text") > 0).select("text", order.alias("o"))

    def sampled(batches):
        for batch in sliced(batches):
            words = Words(batch.column(0))
            row, at = hashed(words)
            pair, n = np.unique(row * BUCKETS + at, return_counts=True)
            edges = np.searchsorted(pair, np.arange(batch.num_rows + 1) * BUCKETS)
            lists = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in ((pair % BUCKETS).astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(posterior[_code(votes(words))]), *(pa.array(x, pa.binary()) for x in lists)], names=["p", "at", "n"])

    texts = hashed_sample(picked, F.col("o"), sample, int(counts.sum())).select("text")
    rows = texts.mapInArrow(sampled, "p double, at binary, n binary").toPandas()
    if not len(rows):
        return QualityModel(posterior, chance, share, None)
    at, n = ([np.frombuffer(x, np.int32) for x in rows[c]] for c in ("at", "n"))
    row = np.repeat(np.arange(len(at)), [len(x) for x in at])
    return QualityModel(posterior, chance, share, Scorer.fit(row, np.concatenate(at), np.concatenate(n), len(at), rows["p"].to_numpy()))


def score_texts(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weak_label (posterior of good), score and kept for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in sliced(batches):
            words = Words(batch.column(1))
            weak = np.where(words.counts > 0, model.posterior[_code(votes(words))], 0.0)
            score = model.scorer.scores(words) if model.scorer else weak
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "weak_label", "score", "kept"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, weak_label double, score double, kept boolean")


def op10_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, train(docs))
