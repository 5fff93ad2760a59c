"""Packing of tokenised documents into sequences by the sum-of-squares rule.

A piece goes to the open sequence, or a new one, that makes the sum over residual gaps g of N(g)**2
smallest, N(g) being how many open sequences have g tokens left. That keeps many different gaps open
for what comes later. Pieces come longest first; ties go to the smallest gap.

Scale: tokenising is one pass without a shuffle and leaves a short row for each piece; these are dealt
by a hash of the row's number, so that equal rows part, to shards of SHARD pieces, each packed alone, so a task's
memory is bounded. Sequences that a
shard left less than REPACK full are opened and packed again in shards of their own, which leaves a few
open sequences for each SHARD pieces.

Defined cases: a null text is empty and becomes the end token alone; repeated rows are packed each; a very long
text is cut into pieces, none is left out; ties of length go by id and piece; an empty table gives no rows; a
null id stays null; only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import array
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..plans.lineage import checkpointed
from ._text import LOWER, bounded_batches, sliced, text_bytes

VOCABULARY = "word_bpe_49k.json"
CAPACITY, SHARD, REPACK, CACHED = 2048, 8192, 0.985, 250_000


#: By byte: 0 white space, 1 letter, 2 digit, 3 other, 4 left to the tokenizer.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[39] = 4  # an apostrophe may begin a contraction
_PLAIN = re.compile(r"[\x21-\x26\x28-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def units(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What can be tokenised alone, in order, and how many there are up to each row.

    A chunk between white space that holds ASCII and the Latin letters of two bytes from C3 80 on only is lower-cased and
    cut into runs of letters, single digits and runs of other signs; any other chunk is one unit as it is.
    """
    data, edges = text_bytes(column)
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    fine = (after != 0x97) & (after != 0xB7)
    letter, after = lead[fine], after[fine]
    kind[letter] = kind[letter + 1] = 1
    solid = kind != 0
    first = np.zeros(n + 1, dtype=bool)
    first[edges] = True
    first[1:n] |= ~solid[:-1]
    first = first[:n] & solid
    chunk = np.cumsum(first, dtype=np.int32) - 1
    odd = np.zeros(chunk[-1] + 1 if n else 0, dtype=bool)
    odd[chunk[kind == 4]] = True
    plain = ~odd[chunk] & solid if n else solid
    begins = first.copy()
    begins[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    lowered = np.where(plain, LOWER[data], data)
    upper = letter[(after <= 0x9E) & plain[letter]] + 1
    lowered[upper] += 32
    at = np.flatnonzero(begins)
    places = np.cumsum(solid, dtype=np.int64)
    offsets = np.concatenate([places[at] - 1, places[-1:]]) if len(at) else np.zeros(1, np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(lowered[solid])])
    return found, np.searchsorted(at, edges)


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer's on the whole text.

    The tokenizer drops white space and joins nothing across the edges of units, so a text's ids are those of its units.
    Arrow dictionary-encodes the units; only those that are new are tokenised, and their ids are gathered for all
    occurrences at once. What is known of units is bounded.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_part = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_part[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.begins = array.array("I"), array.array("q", [0])  # of unit k from begins[k] to begins[k + 1]

    def direct(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_plain(self, some: list[str]) -> None:
        """Many at once: in the ids of all, a word's end shows."""
        ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_part[ids]) + 1
        if len(ends) != len(some):
            for x in some:
                self._learn_odd(x)
            return
        self.place.update(zip(some, range(len(self.begins) - 1, len(self.begins) - 1 + len(some)), strict=True))
        self.begins.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.tobytes())

    def _learn_odd(self, unit: str) -> None:
        self.place[unit] = len(self.begins) - 1
        self.ids.frombytes(self.direct(unit))
        self.begins.append(len(self.ids))

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text; of a null, none."""
        column = column.cast(pa.large_string()).fill_null("")
        special = pc.match_substring(column, "<|")  # may hold an added token
        whole = {k: self.direct(column[k].as_py()) for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            column = pc.if_else(special, pa.scalar("", pa.large_string()), column)
        found, edges = units(column)
        found = found.dictionary_encode()
        names = found.dictionary.to_pylist()
        if len(self.place) + len(names) > CACHED or len(self.ids) > 8 * CACHED:
            self._forget()
        new = [x for x in names if x not in self.place]
        plain = [x for x in new if _PLAIN.fullmatch(x)]
        for at in range(0, len(plain), 5000):
            self._learn_plain(plain[at : at + 5000])
        if len(plain) < len(new):
            for x in new:
                if x not in self.place:
                    self._learn_odd(x)
        begins = np.frombuffer(self.begins, np.int64)
        which = np.array([self.place[x] for x in names], dtype=np.int64)[np.asarray(found.indices)]
        sizes = begins[which + 1] - begins[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(self.ids, "<u4")[np.repeat(begins[which] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[edges]).tolist()
        return [whole.get(k) or raw[cut[k] : cut[k + 1]] for k in range(len(column))]


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: its ids and the end token, cut after every capacity tokens.

    keep_ids adds the token ids, as an array.
    """
    bounded_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    end = array.array("I", [end_id]).tobytes()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []))

    def run(batches):
        tokens = None
        for batch in sliced(batches):
            tokens = tokens or WordTokens(path)
            raws = [x + end for x in tokens.encode(batch.column(1))]
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(raws):
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if keep_ids:
                        ids.append(np.frombuffer(cut, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in the order given: bin number, offset in the bin; then how full each bin is."""
    open_bins = np.zeros(capacity + 1, dtype=np.int64)  # by gap; gaps 0 and capacity stay 0
    by_gap: dict[int, list[int]] = {}
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    far = np.int64(1) << 60
    for k, size in enumerate(lengths.tolist()):
        # 2 (N(g - s) - N(g)) + 2 for a gap g > s; 1 - 2 N(s) for an exact fit; 2 N(c - s) + 1 for a new bin
        change = 2 * (open_bins[1 : capacity - size] - open_bins[size + 1 : capacity]) + 2
        change[open_bins[size + 1 : capacity] == 0] = far
        best = int(change.argmin()) if len(change) else -1
        gap, least = (size + 1 + best, int(change[best])) if best >= 0 else (capacity, int(far))
        if size < capacity and open_bins[size] and 1 - 2 * int(open_bins[size]) <= least:
            gap, least = size, 1 - 2 * int(open_bins[size])
        if least == far or 2 * int(open_bins[capacity - size]) * (size < capacity) + 1 < least:
            gap = capacity
        if gap == capacity:
            b = len(fill)
            fill.append(0)
        else:
            b = by_gap[gap].pop()
            open_bins[gap] -= 1
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        if left := capacity - fill[b]:
            by_gap.setdefault(left, []).append(b)
            open_bins[left] += 1
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, repack: float = REPACK) -> DataFrame:
    """pieces with sequence_id and offset."""
    columns = [f.name for f in pieces.schema.fields]
    pieces = checkpointed(pieces)  # row numbers of a table are the same when a task is run again
    schema = T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())])

    def packed(level: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
            bins, offsets, fill = sum_of_squares(frame["length"].to_numpy(), capacity)
            base = (level << 60) + (int(frame["_shard"].iloc[0]) << 28)
            return frame[columns].assign(sequence_id=base + bins, offset=offsets, _fill=fill[bins])

        return run

    def dealt(frame: DataFrame, shards: int, level: int) -> DataFrame:
        key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("_shard")
        return frame.select(*columns, key).groupBy("_shard").applyInPandas(packed(level), schema)

    first = checkpointed(dealt(pieces, max(1, -(-pieces.count() // shard)), 0))
    loose = first.where(F.col("_fill") < int(repack * capacity))
    again = dealt(loose, max(1, -(-loose.count() // shard)), 1)
    return first.where(F.col("_fill") >= int(repack * capacity)).unionByName(again).drop("_fill")


def sequences(placed: DataFrame) -> DataFrame:
    """The token sequences themselves, from placed pieces that have ids: sequence_id, ids, n_pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces, at most capacity tokens
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"), F.count(F.lit(1)).alias("n_pieces"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, path: str | None = None) -> DataFrame:
    """Documents to placed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenized_pieces(docs, id_col, text_col, path, capacity, keep_ids=keep_ids)
    return pack(pieces, capacity)


def op4_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    """Every document placed in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
