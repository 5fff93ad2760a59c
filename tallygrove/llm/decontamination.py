"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows (w consecutive words of an item; a shorter item is one window) are searched
backward through wavelet-matrix ranks in an index of each shard of documents, occurrences are located
by sampled suffix positions, and overlapping ones are merged into removal spans.

The index is over words, reduced to the benchmark's vocabulary: every other word is a separator, and
so is a run of benchmark words shorter than the shortest window, since no window fits in either.

Scale: one pass over the documents without a shuffle. A shard is what one task has gathered when it
reaches SHARD_WORDS index words or SHARD_BYTES of text, so memory does not grow with the input. Of the
benchmark one block of BLOCK_WORDS words at most is on the driver and in a task at a time; further
blocks are further passes chained on the same rows.

Defined cases: a null or wordless text has no words and no hit; an item without words or without an id
has no windows; equal rows each get their own result, and items that share a window are all named; a text longer
than a shard is a shard of its own; an empty table gives no rows; extra columns pass through, but columns that
have the names of results are replaced, which remove_passages avoids by other names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import checkpointed, discard
from ._text import Words, bounded_batches, sliced, unused

SHARD_WORDS, SHARD_BYTES, BLOCK_WORDS = 1 << 19, 8 << 20, 2_000_000
SAMPLE = 8  # every so many positions one suffix is kept for locating


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = (len(bits) >> 6) + 1
        padded = np.zeros(n << 6, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[np.minimum(w, len(self.words) - 1)] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth, self.levels = max(1, int(symbols - 1).bit_length()), []
        for level in range(self.depth - 1, -1, -1):
            bits = (sequence >> level) & 1 != 0
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 != 0, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position i."""
        return self._down(symbol, i) - self._down(symbol, np.zeros_like(i))

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i and its rank there."""
        symbol, at = np.zeros(len(i), dtype=np.int64), i
        for level, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << level
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self._down(symbol, np.zeros_like(i))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; equal separators (0) sort by position."""
    separators = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    n, k = len(text), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """An index of a text of words (1..symbols-1) between separators (0); the text begins and ends with one."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        last = text[order - 1].astype(np.int64)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.wavelet = Wavelet(last, symbols)
        kept = order % SAMPLE == 0
        kept |= last == 0  # the first word of a run, so that no walk crosses a separator
        self.kept, self.sample = Bits(kept), order[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each row of a matrix of words; all of one length."""
        live = np.arange(len(windows))
        low, high = self.below[windows[:, -1]], self.below[windows[:, -1] + 1]
        for j in range(windows.shape[1] - 2, -1, -1):
            some = high > low
            live, low, high = live[some], low[some], high[some]
            symbol = windows[live, j]
            low, high = (self.below[symbol] + self.wavelet.rank(symbol, x) for x in (low, high))
        lows, highs = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        lows[live], highs[live] = low, high
        return lows, highs

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to sampled ones."""
        at, where, steps = np.full(len(rows), -1, np.int64), np.arange(len(rows)), 0
        while len(where):
            found = self.kept.get(rows)
            at[where[found]] = self.sample[self.kept.rank(rows[found])] + steps
            rows, where = rows[~found], where[~found]
            if len(where):
                symbol, rank = self.wavelet.access(rows)
                rows, steps = self.below[symbol] + rank, steps + 1
        return at


class Patterns:
    """The distinct windows of a benchmark block, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.names)}
        words = Words(pa.array([t for _, t in items], pa.large_string()))
        self.vocabulary = np.unique(words.hash)
        ids = np.searchsorted(self.vocabulary, words.hash).astype(np.int64) + 1
        found: dict[int, list] = {}
        for k, (name, _) in enumerate(items):
            own = ids[words.first[k] : words.first[k + 1]]
            if len(own):
                n = min(window, len(own))
                cut = np.lib.stride_tricks.sliding_window_view(own, n)
                found.setdefault(n, []).append((cut, np.full(len(cut), place[name])))
        self.shortest, self.by_length = min(found, default=0), []
        for n, parts in sorted(found.items()):
            every, held = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            distinct, which = np.unique(every, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), held], 1), axis=0)
            self.by_length.append((n, distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))


class Shard:
    """Rows that wait for their index, and the runs of benchmark words in them."""

    def __init__(self, patterns: Patterns):
        self.patterns, self.batches, self.n_words, self.bytes = patterns, [], [], 0
        self.runs: list[tuple] = []  # row, first word, word ids, byte starts, byte ends
        self.size = self.rows = 0

    def add(self, batch: pa.RecordBatch, words: Words) -> None:
        p = self.patterns
        if len(p.vocabulary) and len(words.hash):
            near = np.minimum(np.searchsorted(p.vocabulary, words.hash), len(p.vocabulary) - 1)
            known = p.vocabulary[near] == words.hash
            breaks = np.ones(len(known) + 1, dtype=bool)
            breaks[1:-1] = (known[1:] != known[:-1]) | (words.row[1:] != words.row[:-1])
            at = np.flatnonzero(breaks)
            long_enough = known[at[:-1]] & (np.diff(at) >= p.shortest)
            for a, b in zip(at[:-1][long_enough].tolist(), at[1:][long_enough].tolist(), strict=True):
                row = int(words.row[a])
                self.runs.append((self.rows + row, a - int(words.first[row]), near[a:b] + 1, words.start[a:b].copy(), words.end[a:b].copy()))
                self.size += b - a + 1
        self.batches.append(batch)
        self.n_words.append(words.counts)
        self.rows, self.bytes = self.rows + batch.num_rows, self.bytes + len(words.data)

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def found(self) -> tuple[dict[int, list[tuple[int, int, int, int]]], dict[int, list[int]]]:
        """By row: merged spans (first word, past the last, byte start, byte end), and the items in order of their names."""
        if not self.runs:
            return {}, {}
        lengths = np.array([len(r[2]) for r in self.runs])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + 1
        text = np.zeros(int(lengths.sum() + len(lengths)) + 1, dtype=np.int64)
        for b, r in zip(begins.tolist(), self.runs, strict=True):
            text[b : b + len(r[2])] = r[2]
        index = FMIndex(text, len(self.patterns.vocabulary) + 1)
        row_of, word_of = np.array([r[0] for r in self.runs]), np.array([r[1] for r in self.runs])
        starts, ends, items = [], [], []
        for n, windows, edges, held in self.patterns.by_length:
            low, high = index.search(windows)
            hit = np.flatnonzero(high > low)
            for some in np.array_split(hit, max(1, int((high - low).sum()) >> 20)):  # bounds what is located at once
                sizes = high[some] - low[some]
                if not len(some):
                    continue
                which = np.repeat(some, sizes)
                rows = np.repeat(low[some], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = index.locate(rows)
                starts.append(at)
                ends.append(at + n)
                pair = np.unique(np.stack([row_of[np.searchsorted(begins, at, "right") - 1], which], 1), axis=0)
                counts = edges[pair[:, 1] + 1] - edges[pair[:, 1]]
                flat = np.repeat(edges[pair[:, 1]], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                items.append(np.unique(np.stack([np.repeat(pair[:, 0], counts), held[flat]], 1), axis=0))
        if not starts:
            return {}, {}
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order])
        new = np.concatenate([[True], start[1:] > reach[:-1]])  # a separator lies between runs, so spans stay in theirs
        first, past = start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
        spans: dict[int, list] = {}
        for s, e, run in zip(first.tolist(), past.tolist(), (np.searchsorted(begins, first, "right") - 1).tolist(), strict=True):
            a, b = s - int(begins[run]), e - int(begins[run])
            spans.setdefault(int(row_of[run]), []).append((int(word_of[run]) + a, int(word_of[run]) + b, int(self.runs[run][3][a]), int(self.runs[run][4][b - 1])))
        by_row: dict[int, list[int]] = {}
        for row, item in np.unique(np.concatenate(items), axis=0).tolist():
            by_row.setdefault(row, []).append(item)
        return spans, by_row


SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("past_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def _marker(items: list[tuple[str, str | None]], window: int, text_col: str, last: bool, keep_text: bool, carried: tuple[str, str], results: tuple[str, ...]):
    """The mapInArrow function of one benchmark block. Earlier blocks' findings come in the columns carried."""

    def emitted(shard: Shard):
        spans, by_row = shard.found()
        row = 0
        for batch, n_words in zip(shard.batches, shard.n_words, strict=True):
            names = batch.schema.names
            old_spans, old_items = (batch.column(names.index(c)).to_pylist() for c in carried)
            all_spans, all_items = [], []
            for k in range(batch.num_rows):
                was = [tuple(x.values()) for x in old_spans[k] or ()]
                new = spans.get(row + k, [])
                all_spans.append(_merged(was + new) if was else new)
                ids = [shard.patterns.names[i] for i in by_row.get(row + k, ())]
                all_items.append(sorted({*ids, *old_items[k]}) if old_items[k] else ids)
            row += batch.num_rows
            fields = [(n, c) for n, c in zip(names, batch.columns, strict=True) if n not in carried and (n != text_col or keep_text or not last)]
            as_dicts = [[dict(zip(("first_word", "past_word", "start", "end"), s, strict=True)) for s in x] for x in all_spans]
            if last:
                hits = [sum(s[1] - s[0] for s in x) for x in all_spans]
                made = (pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(all_items, pa.list_(pa.string())), pa.array(as_dicts, SPAN))
                fields += zip(results, made, strict=True)
            else:
                fields += zip(carried, (pa.array(as_dicts, SPAN), pa.array(all_items, pa.list_(pa.string()))), strict=True)
            yield pa.RecordBatch.from_arrays([c for _, c in fields], names=[n for n, _ in fields])

    def run(batches):
        patterns = Patterns(items, window)
        shard = Shard(patterns)
        for batch in sliced(batches, column=text_col):
            shard.add(batch, Words(batch.column(batch.schema.get_field_index(text_col))))
            if shard.full():
                yield from emitted(shard)
                shard = Shard(patterns)
        yield from emitted(shard)

    return run


_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "past_word", "start", "end")]))
RESULTS = ("n_words", "n_hit", "item_ids", "spans")


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep_text: bool = True, results: tuple[str, str, str, str] = RESULTS) -> DataFrame:
    """docs with n_words, n_hit, item_ids (as sorted strings) and spans of benchmark passages, under the names in results.

    A span has word numbers and byte offsets in the UTF-8 text, ends exclusive. keep_text=False leaves
    the text column out, so that it isn't sent back.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*results)
    carried = tuple(unused(n, docs.columns) for n in ("_spans", "_items"))
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    n_words = items.agg(F.sum(F.length("t")).alias("n")).first().n or 0
    blocks = max(1, -(-n_words // (5 * BLOCK_WORDS)))
    types = (_SPAN_TYPE, T.ArrayType(T.StringType()))
    marked = docs.withColumns({n: F.lit(None).cast(t) for n, t in zip(carried, types, strict=True)})
    for k in range(blocks):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()]
        last = k == blocks - 1
        fields = [f for f in marked.schema.fields if f.name not in carried and (f.name != text_col or keep_text or not last)]
        more = zip(results, (T.LongType(), T.LongType(), *reversed(types)), strict=True) if last else zip(carried, types, strict=True)
        before, marked = marked, marked.mapInArrow(_marker(part, window, text_col, last, keep_text, carried, results), T.StructType(fields + [T.StructField(n, t) for n, t in more]))
        if not last:  # written, so that the driver and the plan hold one block at a time
            marked = checkpointed(marked)
            if k:
                discard(before)
    return marked


def _without(batches, text_col: str, results: tuple[str, ...]):
    for batch in batches:
        names = batch.schema.names
        texts, spans = batch.column(names.index(text_col)).to_pylist(), batch.column(names.index(results[3])).to_pylist()
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            if cuts:
                raw, at, kept = text.encode(), 0, []
                for c in cuts:
                    kept.append(raw[at : c["start"]])
                    at = c["end"]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        columns = [pa.array(out, pa.string()) if n == text_col else c for n, c in zip(names, batch.columns, strict=True) if n not in results]
        yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n not in results])


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the benchmark passages cut out of the texts; all other columns as they were."""
    results = tuple(unused(n, docs.columns) for n in RESULTS)
    marked = mark_contamination(docs, benchmark, text_col, results=results, **options)
    return marked.mapInArrow(lambda batches: _without(batches, text_col, results), docs.schema)


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def op1_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by 10-word windows of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
i as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[k : k + n - 1], ' ') as s from i, unnest(range(1, len(w) - n + 2)) as t(k)),
lens as (select distinct n from win),
pos as (select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as s from d, lens, unnest(range(1, greatest(len(w) - n + 2, 1))) as t(k)),
hits as (select doc_id, k, pos.n, item from pos join win on pos.s = win.s and pos.n = win.n),
words as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, k, n from hits), unnest(range(k, k + n)) as t(p) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, coalesce(len(d.w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
