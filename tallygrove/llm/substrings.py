"""Exact substring deduplication by suffix arrays: bytes covered by a string of LENGTH bytes that starts elsewhere too.

1. A window is LENGTH consecutive bytes. Its name is the least hash of the GRAM-byte strings in it (the leftmost of the
   least), which depends on nothing but the window, so equal windows have equal names. Consecutive windows of one name
   are a unit; units are counted by name and content. A unit whose content occurs twice is repeated as a whole.
   A name with one content, whose gram occurs once in it, can't hold any other repeat, and is done.
2. One unit of each other content goes to a shard: all contents of a name to one, or, where they are more than a
   shard holds, to several. A shard sorts its suffixes by Larsson and Sadakane's refinement; Kasai's common prefixes
   of neighbours show which windows repeat.
3. A name in several shards: each of them puts out its distinct windows as a run sorted by fingerprints, a row for each range
   of fingerprints. The runs of a range are merged by binary search, and windows that two shards hold are repeated.
4. The marked intervals of a document are joined to it, and their union is cut out.

Scale: all shuffles are linear in the input. A text is shuffled twice, and is never in a group with others. Counts are
partial before they are shuffled. A shard holds SHARD bytes, or one unit; a merge range RANGE windows on average, and
of one window at most one for each shard of its name. Nothing but totals goes to the driver.

Windows are compared byte by byte inside a shard; contents of units and windows of different shards by fingerprints of 128 bits.

Defined cases: a null text is empty; a text shorter than LENGTH has no windows and stays whole; very long texts are cut in
pieces of PIECE windows that overlap by LENGTH - 1 bytes, so no window is lost; an empty table gives no rows; repeated rows (equal
ids too) are copies of one another, and each gets its row back; null ids are allowed; extra columns stay, and those with the names
of results are replaced; no occurrence is preferred to another: all go, as the input is judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import checkpointed
from ._suffix import common_prefixes, suffix_array
from ._text import bounded_batches, mixed, released, sliced, text_bytes, unused

LENGTH, GRAM = 400, 64
PIECE, SHARD, RANGE = 1 << 20, 1 << 19, 100_000
PLACE_BITS = 23  # holds a place in a piece, or in a slice of several texts
RESULTS = ("n_bytes", "n_removed", "spans", "kept")
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
UNIT = "k1 long, k2 long, at long, n int, name long, content long, again boolean"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of gram bytes; equal strings anywhere have equal hashes."""
    span, done, total, ahead = 1, 0, np.zeros(len(data) - gram + 1, np.uint64), _BYTES[data]
    while True:  # the gram is put together from spans of 1, 2, 4 ... bytes, as its length says in binary
        factor = mixed(np.array([2 * span, 2 * span + 1], np.uint64)) | np.uint64(1)
        if gram & span:
            total = total * factor[0] + ahead[done : done + len(total)]
            done += span
        if done == gram:
            return mixed(total)
        ahead = ahead[:-span] * factor[1] + ahead[span:]
        span *= 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, from running minima of blocks from either side."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def window_names(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the hash of its least gram (the leftmost, if it occurs more than once), and where it is first and last."""
    hashes = _gram_hashes(data, gram)
    bits = np.uint64(PLACE_BITS)
    place, top = np.arange(len(hashes), dtype=np.uint64), (hashes >> bits) << bits
    mask = (np.uint64(1) << bits) - np.uint64(1)
    first = (_sliding_least(top | place, length - gram + 1) & mask).astype(np.int64)
    last = (mask - (_sliding_least(top | (mask - place), length - gram + 1) & mask)).astype(np.int64)
    return hashes[first], first, last


def _units(length: int, gram: int, piece: int):
    names_of = [f.split()[0] for f in UNIT.split(", ")]

    def of(data: np.ndarray, bounds: np.ndarray):
        """(row, at, n, name, again) of the units of concatenated texts."""
        if len(data) < length:
            return
        name, first, last = window_names(data, length, gram)
        start = np.arange(len(name))
        row = np.searchsorted(bounds, start, "right") - 1
        valid = start + length <= bounds[row + 1]
        start, row = start[valid], row[valid]
        if not len(start):
            return
        new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(row) != 0) | (name[start][1:] != name[start][:-1])])
        begin = start[new]
        end = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
        yield row[new], begin, end - begin + 1, name[begin], first[begin] != last[end]

    def run(batches):
        for batch in sliced(batches):
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = text_bytes(batch.column(2))
            out = []
            # a long text is alone in its slice and goes piece by piece
            long = len(data) > piece + length and len(k1) == 1
            parts = [(a, min(a + piece + length - 1, len(data))) for a in range(0, max(1, len(data) - length + 1), piece)] if long else [(0, len(data))]
            for a, b in parts:
                bounds = np.array([0, b - a]) if long else offsets
                for row, at, n, name, again in of(data[a:b], bounds):
                    raw = data[a:b].tobytes()
                    content = [xxhash.xxh3_64_intdigest(raw[s : s + k]) for s, k in zip(at.tolist(), (n + length - 1).tolist(), strict=True)]
                    out.append((k1[row], k2[row], at - bounds[row] + a, n, name.view(np.int64), np.array(content, np.uint64).view(np.int64), again))
            if out:
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_of)

    return run


BODY = "shard long, hot boolean, k1 long, k2 long, at long, body binary"


def _cut_units(length: int):
    """The bytes of the listed units of each text."""
    names_of = [f.split()[0] for f in BODY.split(", ")]
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column(2))
            keys, begin = [batch.column(k).to_pylist() for k in (0, 1)], offsets.tolist()
            rows = []
            for k, units in enumerate(batch.column(3).to_pylist()):
                raw = data[begin[k] : begin[k + 1]].tobytes()
                rows += [(u["shard"], u["hot"], keys[0][k], keys[1][k], u["at"], raw[u["at"] : u["at"] + u["n"] + length - 1]) for u in units]
            columns = zip(*rows, strict=True) if rows else ((),) * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_of)

    return run


def repeated_windows(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(body, place, repeated, class, first of its class) of each window of a shard's bodies, in the order of the suffix array.

    A suffix's first key holds seven bytes of nine bits, with zeros after the end of its body; the ends differ by their place.
    """
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    begins = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    text = np.zeros(n + 7, np.int64)
    ends = begins + sizes - 1
    real = np.ones(n, bool)
    real[ends] = False
    text[:n][real] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes before the end
    keys = np.zeros(n, np.int64)
    for k in range(7):
        keys = (keys << 9) | np.where(left > k, text[k : n + k], 0)
    sa, _ = suffix_array(keys, 7, left < 7)
    symbols = text[:n]
    symbols[ends] = 256 + np.arange(1, len(ends) + 1)
    shared, _ = common_prefixes(symbols, sa)
    same = shared[sa] >= length  # as the suffix before
    same[:1] = False
    window = left[sa] >= length
    again = same | np.concatenate([same[1:], [False]])
    body = np.searchsorted(begins, sa, "right") - 1
    return body[window], (sa - begins[body])[window], again[window], np.cumsum(~same)[window], ~same[window]


MARK = "k1 long, k2 long, spans array<struct<start:long,end:long>>, range int, run binary"
SPAN = "k1 long, k2 long, spans array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: A window of a run: its fingerprint, where it is, and whether it isn't known to repeat yet.
WINDOW = np.dtype([("high", "u8"), ("low", "u8"), ("k1", "i8"), ("k2", "i8"), ("at", "i8"), ("single", "?")])


def _by_document(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, length: int) -> list[pa.Array]:
    """k1, k2 and spans: a row for each document with the union of its windows that begin at the given places."""
    order = np.lexsort((at, k2, k1))
    k1, k2, at = k1[order], k2[order], at[order]
    doc = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(at) else np.zeros(0, bool)
    new = doc | np.concatenate([[True], np.diff(at) > length]) if len(at) else doc
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:] - 1, [len(at) - 1]]) if len(at) else begin
    spans = pa.StructArray.from_arrays([pa.array(at[begin], pa.int64()), pa.array(at[last] + length, pa.int64())], fields=list(SPANS.value_type))
    edges = np.concatenate([np.flatnonzero(doc[new]), [len(begin)]])
    return [pa.array(k1[doc], pa.int64()), pa.array(k2[doc], pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans).cast(SPANS)]


def _searched(length: int, ranges: int):
    names_of = ["k1", "k2", "spans", "range", "run"]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = {}  # rows that are equal in every column give a unit more than once
        for *unit, body in zip(*(table.column(c).to_pylist() for c in ("k1", "k2", "at", "body")), strict=True):
            rows[tuple(unit)] = body
        k1, k2, at = np.array(list(rows), np.int64).T
        bodies = list(rows.values())
        body, place, again, _, first = repeated_windows(bodies, length)
        found = _by_document(k1[body[again]], k2[body[again]], at[body[again]] + place[again], length)
        n = len(found[0])
        out = [pa.table([*found, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names_of)]
        if key[1].as_py():  # a sorted run of distinct windows for the other shards of the name, cut at the bounds of the ranges
            own = np.empty(int(first.sum()), WINDOW)
            digests = b"".join([xxhash.xxh3_128_digest(bodies[b][w : w + length]) for b, w in zip(body[first].tolist(), place[first].tolist(), strict=True)])
            own["high"], own["low"] = np.frombuffer(digests, ">u8").reshape(-1, 2).T
            own["k1"], own["k2"], own["at"], own["single"] = k1[body[first]], k2[body[first]], at[body[first]] + place[first], ~again[first]
            own.sort(order=["high", "low"])
            cuts = np.searchsorted(own["high"], np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64))
            parts = [(k, p.tobytes()) for k, p in enumerate(np.split(own, cuts)) if len(p)]
            n = len(parts)
            out.append(pa.table([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, SPANS), pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=names_of))
        released()
        return pa.concat_tables(out)

    return run


def _merged(length: int):
    """The windows in a range of fingerprints that two shards have: each run is looked up in those before by binary search."""

    def run(table: pa.Table) -> pa.Table:
        merged, hit = np.zeros(0, WINDOW), []
        for raw in table.column("run").to_pylist():
            own = np.frombuffer(raw, WINDOW)
            names = [np.rec.fromarrays([w["high"], w["low"]], dtype=WINDOW.descr[:2]) for w in (merged, own)]
            at = np.searchsorted(*names)
            inside = at < len(merged)
            known = np.zeros(len(own), bool)
            known[inside] = names[0][at[inside]] == names[1][inside]
            hit += [own[known], merged[at[known]]]
            merged = np.insert(merged, at[~known], own[~known])
        found = np.concatenate(hit) if hit else merged
        found = np.unique(found[found["single"]])
        return pa.table(_by_document(found["k1"], found["k2"], found["at"], length), names=["k1", "k2", "spans"])

    return run


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What a row's units and marks are joined by: two hashes of its id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.col(text_col), F.lit(1), F.col(id_col))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE, shard: int = SHARD, merge_rows: int = RANGE) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, spans) of byte intervals that are made of repeated windows, and the tables to discard once it is read.

    texts has the key (k1, k2) and text. A document can have several rows, whose spans may overlap.
    """
    gram = min(gram, length)
    doc = ("k1", "k2")
    units = checkpointed(texts.where(F.octet_length("text") >= length).mapInArrow(_units(length, gram, min(piece, PIECE)), UNIT))
    # the unit that stands for a content: all its columns are first in the same row
    contents = checkpointed(units.groupBy("name", "content").agg(F.count(F.lit(1)).alias("copies"), F.max("again").alias("again"), *(F.first(c).alias(c) for c in (*doc, "at", "n"))))
    named = contents.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.max("again").alias("again"), F.sum(F.col("n") + length).alias("bytes")).where("kinds > 1 or again")
    named = checkpointed(named.select("name", "bytes"))
    total = named.agg(F.coalesce(F.sum(F.when(F.col("bytes") <= shard, F.col("bytes"))), F.lit(0)).alias("cold"), F.coalesce(F.sum(F.when(F.col("bytes") > shard, F.col("bytes"))), F.lit(0)).alias("hot")).first()
    shards = max(1, -(-total.cold // shard))
    ranges = max(1, -(-total.hot // merge_rows))  # a name's bytes bound its windows
    hot = F.col("bytes") > shard
    # a hot name's shards are numbered by a hash of their own, beyond the others
    part = F.pmod("content", F.ceil(F.col("bytes") / shard))
    number = F.when(hot, F.xxhash64("name", part).bitwiseOR(F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("name"), F.lit(shards)))
    searched = contents.join(named, "name").select(*doc, F.struct(number.alias("shard"), hot.alias("hot"), "at", "n").alias("unit"))
    listed = searched.groupBy(*doc).agg(F.collect_list("unit").alias("units"))
    bodies = texts.join(listed, list(doc)).select(*doc, "text", "units").mapInArrow(_cut_units(length), BODY)
    marks = checkpointed(bodies.groupBy("shard", "hot").applyInArrow(_searched(length, ranges), MARK))
    across = marks.where("run is not null").select("range", "run").groupBy("range").applyInArrow(_merged(length), SPAN)
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end"))
    whole = units.join(contents.where("copies > 1").select("name", "content"), ["name", "content"]).select(*doc, F.array(span).alias("spans"))
    return whole.unionByName(marks.where("run is null").select(*doc, "spans")).unionByName(across), [units, contents, named, marks]


def _without(text_col: str, marks: str, drop: list[str], results: tuple[str, ...]):
    def run(batches):
        for batch in sliced(batches, column=text_col):
            names = batch.schema.names
            data, offsets = text_bytes(batch.column(names.index(text_col)))
            begin = offsets.tolist()
            spans, kept, removed = [], [], []
            for k, cuts in enumerate(batch.column(names.index(marks)).to_pylist()):
                raw = data[begin[k] : begin[k + 1]].tobytes()
                joined: list[list[int]] = []
                for start, end in sorted((c["start"], c["end"]) for c in cuts or ()):
                    if joined and start <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], end)
                    else:
                        joined.append([start, end])
                edges = [0, *(e for s in joined for e in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(len(raw) - len(kept[-1]))
                spans.append([{"start": s, "end": e} for s, e in joined])
            made = (pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary()))
            left = [(n, c) for n, c in zip(names, batch.columns, strict=True) if n not in drop]
            yield pa.RecordBatch.from_arrays([c for _, c in left] + list(made), names=[n for n, _ in left] + list(results))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True, results: tuple[str, str, str, str] = RESULTS, **options) -> DataFrame:
    """docs with n_bytes, n_removed, spans (start, end) and kept, the bytes that are left, under the names in results.

    A cut may fall inside a character, so kept is binary. keep_text=False leaves the text column out.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*results)
    key, marks = [unused(n, docs.columns) for n in ("_k1", "_k2")], unused("_marks", docs.columns)
    keyed = docs.withColumns(dict(zip(key, _keys(id_col, text_col), strict=True)))
    spans, _ = repeated_spans(keyed.select(F.col(key[0]).alias("k1"), F.col(key[1]).alias("k2"), F.col(text_col).alias("text")), length, **options)
    listed = spans.groupBy(F.col("k1").alias(key[0]), F.col("k2").alias(key[1])).agg(F.flatten(F.collect_list("spans")).alias(marks))
    drop = [*key, marks, *([] if keep_text else [text_col])]
    span = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))
    types = (T.LongType(), T.LongType(), span, T.BinaryType())
    schema = T.StructType([f for f in docs.schema.fields if f.name not in drop] + [T.StructField(n, t) for n, t in zip(results, types, strict=True)])
    return keyed.join(listed, key, "left").mapInArrow(_without(text_col, marks, drop, results), schema)


def op13_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of its repeated strings of 400 bytes; text is what is left, with U+FFFD for a character that is cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, keep_text=False)
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), left)
