"""Suffix arrays and common prefixes of many sequences at once, in numpy.

Sequences lie one after the other in one array of symbols, each followed by an end symbol that occurs nowhere
else, so that no two suffixes are equal and no common prefix crosses an end.
"""

from __future__ import annotations

import numpy as np

WIDE = 32


def _places(new: np.ndarray) -> np.ndarray:
    """For each entry the index of the last True at or before it."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _order(group: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The order by (group, key), both below n; where they fit, a number and its index are sorted as one integer."""
    bits, low = int(n).bit_length(), len(key).bit_length()
    if 2 * bits + low > 63:
        return np.lexsort((key, group))
    packed = (group << (bits + low)) | (key << low) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << low) - 1)


def suffix_array(keys: np.ndarray, depth: int = 1, unique: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) by Larsson and Sadakane's refinement.

    A key orders the next depth symbols of its suffix. unique marks keys that reach an end and thus stand alone; by
    default those that occur once do. Groups of suffixes with h equal symbols are sorted by the rank h symbols on,
    which doubles h; suffixes that are alone in their group are never touched again.
    """
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = np.argsort(keys, kind="stable")
    ordered = keys[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if unique is not None:
        new |= unique[sa]
        new[1:] |= unique[sa[:-1]]
    start = _places(new)
    rank = np.empty(n, np.int64)
    rank[sa] = start
    place = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(place):
        suffix = sa[place]
        group, key = rank[suffix], rank[suffix + depth]
        order = _order(group, key, n)
        suffix, key = suffix[order], key[order]
        sa[place] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        rank[suffix] = place[_places(new)]
        place = place[~(new & np.concatenate([new[1:], [True]]))]
        depth *= 2
    return sa, rank


def _extended(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """How many symbols from a and b on are equal, pair by pair; WIDE symbols are compared at a time.

    With step -1 the symbols before a and b are compared, going left. An end or the border of the array stops a pair.
    """
    n, length, live = len(symbols), np.zeros(len(a), np.int64), np.arange(len(a))
    at, reach = (0, 1) if step > 0 else (-1, -1)
    while len(live):
        k = at + reach * np.arange(WIDE)
        x, y = a[live, None] + reach * length[live, None] + k, b[live, None] + reach * length[live, None] + k
        same = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        same &= symbols[np.where(same, x, 0)] == symbols[np.where(same, y, 0)]
        run = np.where(same.all(1), WIDE, same.argmin(1))
        length[live] += run
        live = live[run == WIDE]
    return length


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of the common prefix with the suffix before it in sa, that suffix), in text order, after Kasai.

    A suffix whose left neighbour in the text continues the neighbour's match has a prefix one shorter than it; only
    the other suffixes are compared, all at once.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    has = before >= 0
    follows = has & (before > 0)
    follows[:1] = False
    at = np.flatnonzero(follows)
    follows[at] = symbols[at - 1] == symbols[before[at] - 1]
    first = np.flatnonzero(~follows)
    found = np.zeros(len(first), np.int64)
    paired = before[first] >= 0
    found[paired] = _extended(symbols, first[paired], before[first[paired]])
    which = np.cumsum(~follows) - 1
    return found[which] - (np.arange(n) - first[which]), before
