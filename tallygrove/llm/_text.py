"""Word scanning of Arrow string columns with numpy, shared by the text operators.

A word is a maximal run of UTF-8 bytes that are digits, ASCII letters or part of a non-ASCII
character, after A-Z are lower-cased: the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.
All work is on whole byte blocks, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, dtype=np.uint64)
    up, down = ones * _BASE, ones * _INVERSE
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[first:last] if body is not None and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


class Words:
    """The words of a column: row number, byte start and end in that row, 64-bit hash; in text order."""

    inside, folded = IS_WORD, LOWER

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        self.rows = len(self.offsets) - 1
        parts = [self._block(a, b) for a, b in self._blocks()]
        starts, ends, hashes = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts) if parts else [()] * 3, (np.int64, np.int64, np.uint64)))
        self.row = np.searchsorted(self.offsets, starts, side="right") - 1
        self.start, self.end, self.hash = starts - self.offsets[self.row], ends - self.offsets[self.row], hashes
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def _blocks(self):
        """Blocks of about BLOCK bytes that no word crosses."""
        at, n = 0, len(self.data)
        while at < n:
            to = min(at + BLOCK, n)
            while to < n:
                tail = self.inside[self.folded[self.data[max(at, to - 4096) : to + 1]]]
                breaks = np.flatnonzero(~tail)
                if len(breaks):
                    to = max(at, to - 4096) + int(breaks[-1]) + 1
                    break
                nearest = np.flatnonzero(~self.inside[self.folded[self.data[to : to + BLOCK]]])
                to = to + int(nearest[0]) + 1 if len(nearest) else min(to + BLOCK, n)
                if len(nearest):
                    break
            yield at, min(to, n)
            at = to

    def _block(self, a: int, b: int):
        x = self.folded[self.data[a:b]]
        inside = self.inside[x]
        edge = np.zeros(len(x) + 1, dtype=bool)
        cuts = self.offsets[np.searchsorted(self.offsets, a, "left") : np.searchsorted(self.offsets, b, "right")] - a
        edge[cuts] = True  # rows end words
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]])
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = _powers(1 << max(16, int(len(x)).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        return starts + a, ends + a, mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class BlankWords(Words):
    """The words between white space, [^\\x20\\x09-\\x0D]+, as they are written."""

    inside, folded = ~IS_BLANK, np.arange(256, dtype=np.uint8)


def bounded_batches(spark) -> None:
    """Arrow batches of BATCH_BYTES at most in this session, from now on; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    shown = spark.conf.get(name, "64m").strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(shown[-1:], 1)
    if int(shown.rstrip("kmg") or 0) * unit > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def released() -> None:
    """Gives memory that is free in this worker back to the machine; workers live on between tasks."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batches, most_bytes: int = SLICE_BYTES, column: str = "text"):
    """The Arrow batches, cut so that none holds much more text than most_bytes; frees memory at the end."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
                yield batch.slice(at, min(to, batch.num_rows) - at)
                at = to
    finally:
        released()


def unused(name: str, columns: list[str]) -> str:
    """A column name like name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
