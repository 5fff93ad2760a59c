"""Periodic runs of words, found as branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with smallest period q, long enough, that can't be extended. The words of a batch
of documents make one array of symbols in which no document shares a symbol with another, so one suffix array
(rank refinement), its inverse and its common prefixes serve them all. An LCP interval of depth d has two parts at
each of its borders; for each suffix i of the smaller part it is looked up in the inverse whether i + d or i - d lies in
the other part. If so, the two are a square of period d that its next word breaks, that is, the end of a run.
No tree is built: borders are arrays of previous and next smaller values. The squares are rotated to the
left as long as the words agree, which gives the run; squares with a multiple of a run's period are part of it.

Scale: rows are independent, nothing is shuffled. A task holds a slice of a batch of bounded bytes, or one text; the
work for n words is O(n log n). Words are compared by 64-bit hashes.

Defined cases: a null or blank text has no words and no runs; very long texts are processed whole; an empty table gives no rows;
repeated rows get the same result; extra columns stay, and those with the names of results are replaced; of runs with
equal exponents the first, then the one with the smaller period, is the greatest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._suffix import _extended, common_prefixes, suffix_array
from ._text import BlankWords, bounded_batches, sliced

LEAST_WORDS, LEAST_EXPONENT, PAIRS = 6, 4, 1 << 21
RESULTS = ("n_words", "runs", "collapsed")


def _smaller(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one before it with a smaller value (or, if not strict, no larger one); -1 if there is none."""
    found = np.arange(-1, len(values) - 1)
    live = np.flatnonzero(found >= 0)
    while len(live):
        at = found[live]
        beyond = values[at] >= values[live] if strict else values[at] > values[live]
        live = live[beyond]
        found[live] = found[at[beyond]]
        live = live[found[live] >= 0]
    return found


def branching_squares(sa: np.ndarray, inverse: np.ndarray, prefix: np.ndarray):
    """(start, period) of each square whose two halves' suffixes part right after the first half, in blocks."""
    n = len(sa)
    low = _smaller(prefix, strict=False)
    high = n - 1 - _smaller(prefix[::-1], strict=True)[::-1]
    border = np.flatnonzero(prefix > 0)
    left = np.maximum(low[border], 0)
    right = high[border]
    small_left = border - left <= right - border
    begin, size = np.where(small_left, left, border), np.where(small_left, border - left, right - border)
    other_from, other_to = np.where(small_left, border, left), np.where(small_left, right, border)
    total = np.cumsum(size)
    at = 0
    while at < len(border):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        which = np.repeat(np.arange(at, to), size[at:to])
        place = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        i, d = sa[place], prefix[border[which]]
        for step in (d, -d):
            j = i + step
            inside = (j >= 0) & (j < n)
            rank = inverse[np.where(inside, j, 0)]
            hit = inside & (rank >= other_from[which]) & (rank < other_to[which])
            yield np.minimum(i, j)[hit], d[hit]
        at = to


def periodic_runs(symbols: np.ndarray, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least `least` symbols and `exponent` (2 or more) periods, by start and period.

    Each sequence in symbols ends with a symbol that occurs once.
    """
    sa, inverse = suffix_array(symbols)
    shared, _ = common_prefixes(symbols, sa)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, d in branching_squares(sa, inverse, shared[sa]):
        first = i + 2 * d - np.maximum(least, exponent * d)  # where a run that is long enough begins at the latest
        keep = first >= 0
        i, d, first = i[keep], d[keep], first[keep]
        keep = (symbols[first] == symbols[first + d]) & ((first >= i) | (symbols[i - 1] == symbols[i - 1 + d]))
        starts.append(i[keep])
        periods.append(d[keep])
    i, d = np.concatenate(starts), np.concatenate(periods)
    end = i + 2 * d
    order = np.lexsort((d, end))
    i, d, end = i[order], d[order], end[order]
    found = [np.zeros((0, 3), np.int64)]
    while len(i):
        head = np.concatenate([[True], end[1:] != end[:-1]])
        begin = i[head] - _extended(symbols, i[head], i[head] + d[head], -1)
        length, period = end[head] - begin, d[head]
        ok = length >= np.maximum(least, exponent * period)
        found.append(np.stack([begin, length, period], 1)[ok])
        of = np.cumsum(head) - 1  # the square of least period with the same end
        rest = ~head & ((d % period[of] != 0) | (i < begin[of]))
        i, d, end = i[rest], d[rest], end[rest]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _joined(words: BlankWords, kept: np.ndarray) -> pa.Array:
    """Each row's kept words, joined by one space."""
    row = words.row[kept]
    begin, size = words.start[kept] + words.offsets[row], (words.end - words.start)[kept] + 1
    to = np.cumsum(size)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    body = np.ones(len(out), bool)
    body[to - 1] = False
    source = np.repeat(begin - (to - size), size) + np.arange(len(out))
    out[body] = words.data[source[body]]
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    stays = np.ones(len(out), bool)
    stays[to[last] - 1] = False  # no space after a row's last word
    per_row = np.bincount(row, weights=size, minlength=words.rows).astype(np.int64) - (np.bincount(row, minlength=words.rows) > 0)
    return pa.Array.from_buffers(pa.string(), words.rows, [None, _offsets(per_row).buffers()[1], pa.py_buffer(out[stays].tobytes())])


def _marked(text_col: str, least: int, exponent: int, results: tuple[str, ...]):
    def run(batches):
        for batch in sliced(batches, column=text_col):
            words = BlankWords(batch.column(batch.schema.get_field_index(text_col)))
            n = len(words.hash)
            _, ids = np.unique(words.hash, return_inverse=True)
            kinds = int(ids.max()) + 2 if n else 1
            # words of different documents differ, and each document ends with an own symbol
            place = np.arange(n) + words.row
            symbols = np.empty(n + words.rows, np.int64)
            symbols[place] = words.row * kinds + ids
            symbols[words.first[1:] + np.arange(words.rows)] = (np.arange(words.rows) + 1) * kinds - 1
            start, length, period = periodic_runs(symbols, least, exponent)
            row = np.searchsorted(words.first[1:] + np.arange(words.rows), start)
            start = start - row  # without the ends before it
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
            listed = pa.StructArray.from_arrays([pa.array(start - words.first[row]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=words.rows)), listed)
            made = dict(zip(results, (pa.array(words.counts, pa.int64()), runs, _joined(words, kept)), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], names=[*batch.schema.names, *made])

    return run


def mark_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """docs with n_words, runs (start, length, period in words) and collapsed, the text with only the first period of each run.

    Collapsed texts have one space between words.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*results)
    run = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    types = (T.LongType(), run, T.StringType())
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in zip(results, types, strict=True)])
    return docs.mapInArrow(_marked(text_col, least, exponent, results), schema)


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the smaller start, then period; null without runs."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.slice(runs, 2, 2**31 - 2), F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def _seeded(batches):
    """Texts of some documents with a period from some word on, which the document's id fixes."""
    for batch in sliced(batches):
        texts = []
        for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
            if h % 10 == 0 and text:
                words = BlankWords(pa.array([text]))
                n, g, raw = len(words.hash), h // 10, words.data.tobytes()
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    source = np.arange(n)
                    source[a:] = a + (source[a:] - a) % p
                    text = b" ".join([raw[s:e] for s, e in zip(words.start[source].tolist(), words.end[source].tolist(), strict=True)]).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def op12_branching_tandem_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of which get a period from their id (not those without an id)."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_runs(docs.mapInArrow(_seeded, docs.schema)).withColumn("best", greatest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return marked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
