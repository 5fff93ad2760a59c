"""Personal data: base patterns, and terms that disclose them by information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers; their values are the
protected entities. A term (a word of LEAST_LENGTH bytes or more) that stands within NEAR words of an
entity's mention is a candidate. Over all documents, a term's pointwise mutual information with an entity
is set against the entity's own information: a ratio of 1 means that the term occurs only where the
entity does. Terms that reach DISCLOSURE in at least TEXTS different texts disclose the entity, so all
their occurrences are spans too, which redaction generalises.

Time is linear in a text but for sorting its spans, whatever digits or addresses it holds.

Scale: three passes over the documents: candidates, their document counts, and marking. What is shuffled are counts.
Up to BLOCK terms go to the tasks as an array. More stay in a table: words that a Bloom filter of SIEVE bits lets through are
joined with it, once for each distinct text, for the counts as for the marks; then a text is shuffled once to meet its terms. So nothing that is broadcast
or sent to the driver outgrows its bound, and the passes don't grow with the terms.

Defined cases: a null text is empty and has no span (redaction leaves it null); equal rows each get their own
result; terms that stand in too few different texts give no span; an empty table gives no rows; very long texts are
read whole; where base spans of two kinds overlap, redaction names the first (of ties, the first kind) for both; extra columns
pass through redaction unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import checkpointed
from ._text import Words, bounded_batches, sliced, text_bytes, unused

NEAR, LEAST_LENGTH, TEXTS, DISCLOSURE, BLOCK = 5, 3, 3, 0.9, 1_000_000
SIEVE = 1 << 25
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, longest local parts before each @; work is linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        elif start < at:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """IP addresses: of each run of dotted numbers the first four, the next four and so on; linear in the text."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in own):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(kind's place in KINDS, start, end) of the base patterns, by start and kind; code points."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows that have an @ or a digit; no other can hold a base span."""
    data, offsets = text_bytes(column)
    sums = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)), dtype=np.int64)])
    return np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])


def _points(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in code points of their rows."""
    sums = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)])
    base = words.offsets[words.row]
    return sums[base + words.start] - sums[base], sums[base + words.end] - sums[base]


def _entity(text: str, span: tuple[int, int, int]) -> int:
    value = text[span[0] : span[2]]
    value = value.lower() if span[1] == 0 else value if span[1] == 1 else _NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{KINDS[span[1]]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _covered(words: Words, begin: np.ndarray, end: np.ndarray, spans: dict[int, list]) -> np.ndarray:
    """Which words overlap a base span of their row; by sorted places, so in linear time but for a logarithm."""
    edges = np.zeros(len(begin) + 1, np.int64)
    for row, own in spans.items():
        a, b = int(words.first[row]), int(words.first[row + 1])
        starts, ends = (np.array([s[k] for s in own if s[1] < 4], np.int64) for k in (0, 2))
        low = a + np.searchsorted(end[a:b], starts, "right")
        high = np.maximum(low, a + np.searchsorted(begin[a:b], ends, "left"))
        np.add.at(edges, low, 1)
        np.add.at(edges, high, -1)
    return np.cumsum(edges[:-1]) > 0


def _contexts(near: int, least_length: int):
    """term, entity, text: each term near a mention, once for a document; term 0 stands for the mention itself."""

    def run(batches):
        for batch in sliced(batches):
            suspects = _suspects(batch.column(0))
            out: set = set()
            if len(suspects):
                texts = batch.column(0).take(pa.array(suspects))
                words = Words(texts)
                begin, end = _points(words)
                spans = {k: own for k, text in enumerate(texts.to_pylist()) if (own := base_spans(text))}
                usable = (words.end - words.start >= least_length) & ~_covered(words, begin, end, spans)
                hashes = words.hash.view(np.int64)
                for k, own in spans.items():
                    text = texts[k].as_py()
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    before = a + np.searchsorted(end[a:b], [s[0] for s in own], "right")
                    after = a + np.searchsorted(begin[a:b], [s[2] for s in own], "left")
                    for s, first, past in zip(own, before.tolist(), after.tolist(), strict=True):
                        entity = _entity(text, s)
                        out.add((k, 0, entity))
                        for low, high in ((max(a, first - near), first), (past, min(b, past + near))):
                            out.update((k, h, entity) for h in hashes[low:high][usable[low:high]].tolist())
                text_hash = batch.column(1).take(pa.array(suspects)).to_pylist()
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([text_hash[r[0]] for r in rows] if rows else [], pa.int64())], names=["term", "entity", "text"])

    return run


def _known(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted terms."""
    return terms[np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)] == hashes if len(terms) else np.zeros(len(hashes), bool)


def _few(terms: DataFrame, block: int) -> np.ndarray | None:
    """The term hashes, sorted; None if there are more than block."""
    values = terms.select("term").limit(block + 1).toPandas()["term"].to_numpy(np.int64)
    return np.sort(values.view(np.uint64)) if len(values) <= block else None


def _sieve(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms, with one bit for each; some tasks send SIEVE bits each."""

    def bits(batches):
        found = np.zeros(SIEVE, bool)
        for batch in batches:
            found[batch.column(0).to_numpy().view(np.uint64) % np.uint64(SIEVE)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["bits"])

    rows = terms.select("term").coalesce(4).mapInArrow(bits, "bits binary").collect()
    return np.bitwise_or.reduce([np.frombuffer(r.bits, np.uint8) for r in rows] or [np.zeros(SIEVE // 8, np.uint8)])


def _passed(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(SIEVE)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _distinct(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], term[new]


def _counter(keep):
    """term, df: how many texts of a task hold each word that keep lets through; in parts of some hundred thousand terms."""

    def run(batches):
        held: list[np.ndarray] = []
        names, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in sliced(batches):
            words = Words(batch.column(0))
            hit = keep(words.hash)
            held.append(_distinct(words.row[hit], words.hash[hit])[1])
            if sum(map(len, held)) > 1 << 20:
                names, sums = _summed(names, sums, held)
                held = []
            if len(names) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(sums)], names=["term", "df"])
                names, sums = names[:0], sums[:0]
        names, sums = _summed(names, sums, held)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(sums)], names=["term", "df"])

    return run


def _summed(names: np.ndarray, sums: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([names, *more])
    kinds, place = np.unique(every, return_inverse=True)
    return kinds, np.bincount(place, weights=np.concatenate([sums, np.ones(len(every) - len(names))]), minlength=len(kinds)).astype(np.int64)


def disclosing_terms(docs: DataFrame, text_col: str = "text", texts: int = TEXTS, disclosure: float = DISCLOSURE, block: int = BLOCK, near: int = NEAR, least_length: int = LEAST_LENGTH) -> DataFrame:
    """term (hash) of each term that discloses an entity, measured over all of docs.

    Terms within near words of a mention count, of least_length bytes or more, if they are there in so many different texts.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = rows.select("text", F.xxhash64("text").alias("h")).mapInArrow(_contexts(near, least_length), "term long, entity long, text long")
    by_text = found.groupBy("term", "entity", "text").agg(F.count(F.lit(1)).alias("n"))
    pairs = checkpointed(by_text.groupBy("term", "entity").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("texts")))
    candidates = checkpointed(pairs.where((F.col("term") != 0) & (F.col("texts") >= texts)))
    wanted = candidates.select("term").distinct()
    terms = _few(wanted, block)
    if terms is not None and not len(terms):
        return candidates.select("term").limit(0)
    sieve = _sieve(candidates) if terms is None else None
    keep = (lambda h: _passed(sieve, h)) if terms is None else (lambda h: _known(terms, h))
    counts = rows.mapInArrow(_counter(keep), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    entities = pairs.where("term = 0").select("entity", F.col("c").alias("mentions"))
    total = F.lit(float(max(2, docs.count())))
    found = candidates.join(counts, "term").join(entities, "entity")
    information = F.log2(total / F.col("mentions"))
    mutual = F.log2(F.col("c") * total / (F.col("df") * F.col("mentions")))
    return checkpointed(found.where((information > 0) & (mutual >= disclosure * information)).select("term").distinct())


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _term_spans(terms: np.ndarray, words: Words, spans: dict[int, list]) -> dict[int, list]:
    """By row the terms that overlap no base span."""
    found: dict[int, list] = {}
    if len(terms) and len(words.hash):
        at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
        known = terms[at] == words.hash
        if known.any():
            begin, end = _points(words)
            hits = np.flatnonzero(known & ~_covered(words, begin, end, spans))
            for row, a, b in zip(words.row[hits].tolist(), begin[hits].tolist(), end[hits].tolist(), strict=True):
                found.setdefault(row, []).append((a, 4, b))
    return found


def _marked(terms: np.ndarray | None, text_col: str, own_terms: str | None, finish):
    """finish(batch, texts, spans) with the spans of base kinds and of terms, by row; own_terms names a column with each row's terms."""

    def run(batches):
        for batch in sliced(batches, column=text_col):
            column = batch.column(batch.schema.get_field_index(text_col))
            suspects, spans = _suspects(column), {}
            for k, text in zip(suspects.tolist(), column.take(pa.array(suspects)).to_pylist(), strict=True):
                if own := base_spans(text):
                    spans[k] = own
            found = {}
            if own_terms:
                lists = batch.column(batch.schema.get_field_index(own_terms))
                some = np.flatnonzero(np.array(lists.is_valid()))
                if len(some):
                    words, known = Words(column.take(pa.array(some))), np.sort(lists.flatten().to_numpy().view(np.uint64))
                    moved = {k: spans[row] for k, row in enumerate(some.tolist()) if row in spans}
                    # a term of one text is a term in all, so the batch's terms are looked up at once
                    found = {int(some[k]): own for k, own in _term_spans(known, words, moved).items()}
            elif len(terms):
                found = _term_spans(terms, Words(column), spans)
            for k, own in found.items():
                spans[k] = sorted(spans.get(k, []) + own)
            yield finish(batch, column, spans)

    return run


def _emitted(sieve: np.ndarray):
    """k1, k2, term of the words of each text that pass the sieve, once for a text."""

    def run(batches):
        for batch in sliced(batches):
            words = Words(batch.column(0))
            hit = _passed(sieve, words.hash)
            row, term = _distinct(words.row[hit], words.hash[hit])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in (1, 2)), pa.array(term.view(np.int64))], names=["k1", "k2", "term"])

    return run


def _applied(docs: DataFrame, terms: DataFrame | None, text_col: str, finish, schema: T.StructType, block: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    few = _few(terms, block) if terms is not None else np.zeros(0, np.uint64)
    if few is not None:
        return docs.mapInArrow(_marked(few, text_col, None, finish), schema)
    names = [unused(n, docs.columns) for n in ("_k1", "_k2", "_terms")]
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({names[0]: F.xxhash64(text), names[1]: F.xxhash64(F.lit(1), text)})
    words = keyed.select(text.alias("text"), names[0], names[1]).where("text is not null").mapInArrow(_emitted(_sieve(terms)), "k1 long, k2 long, term long")
    own = words.distinct().join(terms.select("term").distinct(), "term").groupBy(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).agg(F.collect_list("term").alias(names[2]))
    return keyed.join(own, names[:2], "left").select(*docs.columns, names[2]).mapInArrow(_marked(None, text_col, names[2], finish), schema)


def _listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, terms: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans (kind:start:end, comma-joined), n_term and found (any span) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_term", T.LongType()), T.StructField("found", T.BooleanType())])

    def finish(batch, column, spans):
        lists = [spans.get(k, []) for k in range(batch.num_rows)]
        counts = [pa.array([sum(s[1] == kind for s in own) for own in lists], pa.int64()) for kind in range(5)]
        base = [hashlib.sha256(_listed([s for s in own if s[1] < 4]).encode()).hexdigest() for own in lists]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts[:4], pa.array(base, pa.string()), pa.array([_listed(own) for own in lists], pa.string()), counts[4], pa.array([bool(own) for own in lists])], names=schema.names)

    return _applied(rows, terms, "text", finish, schema, block)


def redact(docs: DataFrame, terms: DataFrame | None, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with base spans replaced by their kind, as [EMAIL], and disclosing terms generalised to [TERM]."""
    schema = docs.schema

    def finish(batch, column, spans):
        texts = column.to_pylist()
        for k, own in spans.items():
            kept, at = [], 0
            for a, kind, b in own:
                if a >= at:
                    kept += [texts[k][at:a], f"[{KINDS[kind].upper()}]"]
                at = max(at, b)
            texts[k] = "".join([*kept, texts[k][at:]])
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_col else batch.column(batch.schema.get_field_index(n)) for n in schema.names], names=schema.names)

    return _applied(docs, terms, text_col, finish, schema, block)


def op9_information_sanitisation(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal_data(docs, disclosing_terms(docs))
