"""Repeated substrings of a bundle of texts, from the Burrows-Wheeler transform of their suffix array, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(code: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of ``code``, whose zeros are separators: each is a symbol of its own, and smaller than all
    others. No two separators lie more than ``longest`` symbols apart. Ranks by 8 symbols, then by doubling."""
    n = len(code)
    p = code.astype(np.uint64)
    for k in (1, 2, 4):
        ahead = np.zeros(n, np.uint64)
        ahead[:-k] = p[k:]
        ended = (p & np.uint64(0xFF)) == 0  # what follows a separator doesn't count
        p = np.where(ended, p << np.uint64(8 * k), (p << np.uint64(8 * k)) | ahead)
    sa = np.argsort(p, kind="stable")
    key = p[sa]
    new = np.r_[True, key[1:] != key[:-1]] | ((key & np.uint64(0xFF)) == 0)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 8
    alone = new & np.r_[new[1:], True]
    slots = np.flatnonzero(~alone)
    while len(slots) and k <= 2 * longest:
        at = sa[slots]
        key = rank[at] * n + rank[np.minimum(at + k, n - 1)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.r_[new[1:], True])]
        k *= 2
    return sa, rank


def short_prefixes(code: np.ndarray, sa: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """True at row r if the suffixes of rows r - 1 and r share fewer than ``least`` symbols.

    Breadth-first: an interval of rows holds all suffixes that begin with one string. Level by level each interval is extended
    backward by every symbol that precedes its suffixes; the row after an extended interval's end has the level as its common
    prefix if it has none yet, and only such intervals go on. So values are found in increasing order, and the search stops
    at ``least``.
    """
    n = len(code)
    back = rank[sa - 1]  # the row of the suffix that is one symbol longer (of the text's first, the last one's)
    first = code[sa]
    ahead = rank[np.minimum(sa + 1, n - 1)]  # the row of the suffix without its first symbol
    ahead[first == 0] = -1
    same_next = np.r_[(first[1:] == first[:-1]) & (first[1:] != 0), False]
    # rows of the next and the last suffix that the same symbol precedes
    after = np.where(same_next[back], ahead[np.minimum(back + 1, n - 1)], n)
    same_last = np.r_[False, same_next[:-1]]
    before = np.where(same_last[back], ahead[np.maximum(back - 1, 0)], -1)
    found = np.zeros(n + 1, bool)
    found[0] = True
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(least):
        size = hi - lo + 1
        rows = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        starts = np.sort(back[rows[before[rows] < np.repeat(lo, size)]])
        ends = np.sort(back[rows[after[rows] > np.repeat(hi, size)]])
        fresh = ~found[ends + 1]
        lo, hi = starts[fresh], ends[fresh]
        found[hi + 1] = True
        if not len(lo):
            break
    return found[:n]


def classes(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, offset and class of each substring of ``least`` bytes that occurs twice or more in the texts."""
    code = np.frombuffer(b"\0".join(t.translate(_UP) for t in texts) + b"\0", np.uint8)
    sa, rank = suffix_order(code, max(map(len, texts)) + 1)
    short = short_prefixes(code, sa, rank, least)
    grouped = ~short | np.r_[~short[1:], False]
    rows = np.flatnonzero(grouped)
    at = sa[rows]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(starts, at, side="right") - 1
    return text, at - starts[text], np.cumsum(short[rows])


#: UTF-8 has no byte over 0xF4, so every byte can make room for the separator.
_UP = bytes(min(b + 1, 255) for b in range(256))
