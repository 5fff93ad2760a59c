"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 run over fixed windows of WINDOW bytes, each filter's
largest response is kept, and a softmax layer gives the languages; a text's score is the mean of its
windows' probabilities, weighted by their bytes. To apply it, embedding and filters are folded into
tables by byte pair, so that a filter is one or two table rows for each place.

Scale: trained on the driver on pieces of at most SAMPLE labelled texts, taken by a hash of id and text;
every text is then read whole, in batches of windows, in one pass without a shuffle.

Defined cases: a null text, or one without a letter, is und with score 0; so is every text if nothing can
be learned from; texts with a null language aren't learned from; of languages with equal scores the first in
alphabetical order is named; repeated rows each get a row; only the id, text and language columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import hashed_sample
from ._text import bounded_batches, sliced, text_bytes

SAMPLE, PIECE = 4000, 384  # texts, characters of each
WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 12, (2, 3, 4)


class ByteCNN:
    """The network's parameters; languages are its outputs."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBED))
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages)))
        self.bias = np.zeros(len(languages))

    def _forward(self, x: np.ndarray):
        e = self.embedding[x]
        pooled, where, views = [], [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            view = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            response = view @ f
            at = response.argmax(axis=1)
            where.append(at)
            views.append(view)
            pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        z = np.maximum(h, 0) @ self.out + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), h, where, views

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy of windows x with languages y, by parameter."""
        p, h, where, views = self._forward(x)
        dz = p
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dh = (dz @ self.out.T) * (h > 0)
        d_embedding, grads, rows = np.zeros_like(self.embedding), [], np.arange(len(x))[:, None]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            chosen = views[k][rows, where[k]]  # batch, filter, width * embed
            grads.append(np.einsum("bfe,bf->ef", chosen, g))
            back = (g[:, :, None] * f.T[None]).reshape(len(x), FILTERS, w, EMBED)
            np.add.at(d_embedding, x[rows[:, :, None], where[k][:, :, None] + np.arange(w)], back)
        return [d_embedding, *grads, np.maximum(h, 0).T @ dz, dz.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on the cross entropy of windows x with languages y."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                t += 1
                for i, (p_, g_) in enumerate(zip(params, self.gradients(x[some], y[some]), strict=True)):
                    m[i] += 0.1 * (g_ - m[i])
                    v[i] += 0.001 * (g_**2 - v[i])
                    p_ -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses by byte pair (low byte first): all filters' first two places, then places 3 of width 3 and 3-4 of width 4."""
        part = lambda f, j: self.embedding @ f[j * EMBED : (j + 1) * EMBED]
        pair = lambda f, j: (part(f, j)[None, :, :] + part(f, j + 1)[:, None, :]).reshape(65536, -1)
        first = np.concatenate([pair(f, 0) for f in self.filters], axis=1).astype(np.float32)
        return first, part(self.filters[1], 2).astype(np.float32), pair(self.filters[2], 2).astype(np.float32)

    def predictor(self):
        """A function from windows (rows of WINDOW bytes) to probabilities."""
        first, third, last = self.tables()
        out, bias = self.out.astype(np.float32), self.bias.astype(np.float32)

        def predict(x: np.ndarray) -> np.ndarray:
            pairs = x[:, :-1].astype(np.int32) | (x[:, 1:].astype(np.int32) << 8)
            r = first[pairs]
            h = [r[:, :, :FILTERS].max(axis=1)]
            r[:, :-1, FILTERS : 2 * FILTERS] += third[x[:, 2:]]
            h.append(r[:, :-1, FILTERS : 2 * FILTERS].max(axis=1))
            r[:, :-2, 2 * FILTERS :] += last[pairs[:, 2:]]
            h.append(r[:, :-2, 2 * FILTERS :].max(axis=1))
            z = np.maximum(np.concatenate(h, axis=1), 0) @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)

        return predict


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the rows in windows: row, bytes in it, the windows (spaces after the end)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + number * WINDOW
    used = np.minimum(WINDOW, offsets[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = np.arange(WINDOW)[None, :] < used[:, None]
    padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
    return row, used, np.where(inside, padded[np.minimum(at, len(data))], np.uint8(32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, piece: int = PIECE) -> ByteCNN | None:
    """A network from a bounded sample of docs, of each so many characters from a place that the row's hash gives; None if no row has a text and a language."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    order = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("language"))
    begin = F.lit(1) + F.pmod(order, F.greatest(F.length(text_col) - piece + 1, F.lit(1))).cast("int")
    pieces = known.select(order.alias("o"), F.col(lang_col).alias("l"), F.substring(F.col(text_col), begin, F.lit(piece)).alias("t"))
    rows = hashed_sample(pieces, F.col("o"), sample, docs.select(lang_col).where(F.col(lang_col).isNotNull()).count()).toPandas()
    if not len(rows):
        return None
    languages = sorted(set(rows["l"]))
    data, offsets = text_bytes(pa.array(rows["t"], pa.string()))
    row, used, x = windows(data, offsets)
    some = used >= min(32, int(used.max()))
    network = ByteCNN(languages)
    network.fit(x[some], np.searchsorted(languages, rows["l"].to_numpy())[row[some]])
    return network


def identify(docs: DataFrame, network: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if network is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        predict = network.predictor()
        for batch in sliced(batches, 1 << 19):
            row, used, x = windows(*text_bytes(batch.column(1)))
            sums = np.zeros((batch.num_rows, len(network.languages)))
            for at in range(0, len(x), 512):
                p = predict(x[at : at + 512]) * used[at : at + 512, None]
                for k in range(p.shape[1]):
                    sums[:, k] += np.bincount(row[at : at + 512], weights=p[:, k], minlength=batch.num_rows)
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in batch.column(1).to_pylist()], dtype=bool)
            best = sums.argmax(axis=1)
            score = np.where(letters, sums[np.arange(len(sums)), best] / np.maximum(sums.sum(axis=1), 1e-300), 0.0)
            named = [network.languages[b] if known else "und" for b, known in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score.clip(0, 1))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 after division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_byte_cnn_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
