"""Fill-in-the-middle: texts are cut in three at token borders and their parts put in another order.

A token is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: a word with the white space before it, or white space at
the end. All cuts are found for a whole Arrow batch: token ends come as bytes, and code points from them through a
sparse index of the exceptions, which holds the multibyte characters' positions and their excess bytes only.
A position is moved by the excess of the characters before it, found by searchsorted; in a batch of
ASCII text the index is empty and both counts are one.

Scale: rows are independent, nothing is shuffled; a task holds one slice of a batch of bounded bytes, or one text.

Defined cases: a null text is empty and stays plain; a null id counts as an empty string in the digits' seed; texts that hold a
sentinel stay plain, so that every output can be undone; empty tables give no rows; repeated rows get the
same result; extra columns stay, and those with the names of results are replaced; there are no ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import IS_BLANK, bounded_batches, sliced, text_bytes, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n_tokens", "form", "prefix_chars", "middle_chars", "output")


class Exceptions:
    """The multibyte characters of UTF-8 bytes: where they begin, in bytes and in code points, and the excess so far."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        extra = 1 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64)
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        self.points = self.at - self.excess[:-1]

    def to_points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before byte positions, which are borders of characters."""
        return byte - self.excess[np.searchsorted(self.at, byte, "left")]

    def to_bytes(self, point: np.ndarray) -> np.ndarray:
        """Byte positions of code points."""
        return point + self.excess[np.searchsorted(self.points, point, "left")]


class Tokens:
    """Token borders of a column of texts: for each row the number of tokens, and the byte and the code point where each ends."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        blank = IS_BLANK[self.data]
        last = np.zeros(len(self.data), bool)
        last[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = True
        # a word ends before white space or at its row's end; white space at a row's end is a token as well
        ends = np.flatnonzero(last | (~blank & np.concatenate([blank[1:], [True]]))) + 1
        row = np.searchsorted(self.offsets, ends - 1, "right") - 1
        self.count = np.bincount(row, minlength=len(self.offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.ends, self.index = ends, Exceptions(self.data)

    def cut(self, row: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code point) in its row where the given number of tokens ends."""
        begin = self.offsets[row]
        ends = np.concatenate([self.ends, [0]])  # for batches without tokens
        byte = np.where(after > 0, ends[np.maximum(self.first[row] + after - 1, 0)], begin)
        return byte - begin, self.index.to_points(byte) - self.index.to_points(begin)


def _transformed(text_col: str, digits: str, rate: int, spm_rate: int, results: tuple[str, ...]):
    def run(batches):
        for batch in sliced(batches, column=text_col):
            names = batch.schema.names
            texts = batch.column(names.index(text_col))
            tokens = Tokens(texts)
            n = tokens.count
            h = [np.array([int(x[k : k + 8], 16) for x in batch.column(names.index(digits)).to_pylist()], np.int64) for k in range(0, 32, 8)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            rows = np.arange(batch.num_rows)
            (a, a_points), (b, b_points) = tokens.cut(rows, np.minimum(one, two)), tokens.cut(rows, np.maximum(one, two))
            forms, outputs = [], []
            for k in range(batch.num_rows):
                raw = tokens.data[tokens.offsets[k] : tokens.offsets[k + 1]].tobytes()
                plain = not raw or h[2][k] % 100 >= rate or any(s in raw for s in (b"<P>", b"<S>", b"<M>"))
                prefix, middle, suffix = raw[: a[k]], raw[a[k] : b[k]], raw[b[k] :]
                if plain:
                    forms.append("plain")
                    outputs.append(raw)
                elif h[3][k] % 100 < spm_rate:
                    forms.append("spm")
                    outputs.append(b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle)))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle)))
            form = np.array(forms)
            none = form == "plain"
            made = (pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(a_points, pa.int64(), mask=none), pa.array(b_points - a_points, pa.int64(), mask=none), pa.array(outputs, pa.binary()).cast(pa.string()))
            kept = [(name, c) for name, c in zip(names, batch.columns, strict=True) if name != digits]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + list(made), names=[name for name, _ in kept] + list(results))

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """docs with n_tokens, form (plain, psm or spm), prefix_chars, middle_chars and output, under the names in results.

    rate is the share of texts in a hundred that are transformed, spm_rate the share of those that begin with the suffix.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*results)
    digits = unused("_digits", docs.columns)
    seeded = docs.withColumn(digits, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in zip(results, types, strict=True)])
    return seeded.mapInArrow(_transformed(text_col, digits, rate, spm_rate, results), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed; no part holds a sentinel."""
    before, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring(before, 4, 2**31 - 1), SUFFIX, 1), middle, F.substring_index(before, SUFFIX, -1))
    spm = F.concat(F.substring_index(before, PREFIX, -1), middle, F.substring_index(F.substring(before, 4, 2**31 - 1), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_exception_index_infilling(spark, sf_dir: str) -> DataFrame:
    """Every document, transformed and rebuilt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select doc_id, t, w, len(w)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from g),
p as (select doc_id, t, n, form, array_to_string(w[1:a], '') as x, array_to_string(w[a + 1:b], '') as y, array_to_string(w[b + 1:n], '') as z from c)
select doc_id, n, form, case when form <> 'plain' then length(x)::bigint end as prefix_chars, case when form <> 'plain' then length(y)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256
from p
"""
