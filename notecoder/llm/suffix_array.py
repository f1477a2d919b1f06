"""Substring dedup over bytes: suffix arrays of shards by induced sorting, and permuted common prefixes."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import BASES, Bytes, Search, _Hashes, without_repeats

WINDOW = 200
#: Bytes whose hash marks a shard's groups; with the window it gives an anchor each 85 bytes or so.
GRAM = 32


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is the smallest of all."""
    n = len(t)
    out = np.zeros(n, bool)
    out[-1] = True
    if n > 1:
        # equal neighbours take the type of the first difference to their right
        differ = np.flatnonzero(t[:-1] != t[1:])
        at = np.searchsorted(differ, np.arange(n - 1))
        out[:-1] = (t[differ] < t[differ + 1])[at] if len(differ) else False
    return out


def _appended(sa: np.ndarray, fill: np.ndarray, places: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put ``places`` at the ends of their characters' buckets, in the given order."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    inner = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    sa[fill[c] + step * inner] = places[order]
    np.add.at(fill, c[first], step * np.diff(np.append(first, len(c))))


def _induced(t: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order, in two linear passes.

    A pass goes bucket by bucket; what a bucket's entries induce is appended together, and a
    bucket is gone through again only as far as it has induced entries of its own.
    """
    n, k = len(t), len(heads)
    sa = np.full(n, -1, np.int64)
    chars = t[lms]
    bounds = np.searchsorted(chars, np.arange(k + 1))
    fill = heads.copy()
    for c in range(k):
        done = heads[c]
        while True:
            chunk = sa[done:fill[c]] if fill[c] > done else None
            if chunk is None:
                break
            done = fill[c]
            before = chunk[chunk > 0] - 1
            before = before[~small[before]]
            if len(before):
                _appended(sa, fill, before, t[before], 1)
        own = lms[bounds[c]:bounds[c + 1]]
        before = own[own > 0] - 1
        before = before[~small[before]]
        if len(before):
            _appended(sa, fill, before, t[before], 1)
    larger_end = fill.copy()
    fill = tails - 1
    for c in range(k - 1, -1, -1):
        done = tails[c] - 1
        while fill[c] < done:
            chunk = sa[fill[c] + 1:done + 1][::-1]
            done = fill[c]
            before = chunk[chunk > 0] - 1
            before = before[small[before]]
            if len(before):
                _appended(sa, fill, before, t[before], -1)
        chunk = sa[heads[c]:larger_end[c]][::-1]
        before = chunk[chunk > 0] - 1
        before = before[small[before]]
        if len(before):
            _appended(sa, fill, before, t[before], -1)
    sa[0] = n - 1
    return sa


def _sorted_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a sequence of names, told apart by ``depth`` names at least.

    The reduced string has as many names as places, where passes bucket by bucket gain
    nothing; its suffixes are sorted by doubling instead.
    """
    rank, width, n = names.astype(np.int64), 1, len(names)
    while width < depth and n > 1 and int(rank.max()) < n - 1:
        ahead = np.full(n, -1, np.int64)
        ahead[:-width or None] = rank[width:]
        _, rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)
        width *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Suffixes of a byte string in order, for the first ``depth`` bytes at least."""
    if not len(text):
        return np.zeros(0, np.int64)
    t = np.concatenate([text.astype(np.int16) + 1, [0]])
    n = len(t)
    small = _types(t)
    sizes = np.bincount(t, minlength=257)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    if len(lms) > 1:
        ordered = _induced(t, small, heads, tails, lms[np.argsort(t[lms], kind="stable")])
        ordered = ordered[np.isin(ordered, lms, assume_unique=False)] if n < 64 else ordered[_mask(n, lms)[ordered]]
        # neighbours in this order have the same name if their substrings, up to the next one, are equal
        stop = np.empty(n, np.int64)
        stop[lms] = np.append(lms[1:] + 1, n)
        one, two = (_Hashes(t.astype(np.uint64) + np.uint64(7), b) for b in BASES)
        length = stop[ordered] - ordered
        h1, h2 = one.of(ordered, stop[ordered]), two.of(ordered, stop[ordered])
        name = np.cumsum(np.concatenate([[0], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (length[1:] != length[:-1])]))
        of = np.empty(n, np.int64)
        of[ordered] = name
        lms = lms[_sorted_names(of[lms], depth)]
    return _induced(t, small, heads, tails, lms)[1:]


def _mask(n: int, places: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def common_prefixes(text: np.ndarray, starts: np.ndarray, before: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that the suffixes at ``starts`` and ``before`` have in common, up to ``cap``; eight at a time."""
    padded = np.concatenate([text, np.zeros(cap + 8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        eight |= padded[i:len(padded) - 7 + i] << np.uint64(8 * i)
    room = np.minimum(len(text) - np.maximum(starts, before), cap)
    out, open_ = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for at in range(0, cap, 8):
        x = eight[starts[open_] + at] ^ eight[before[open_] + at]
        same = x == 0
        ended = open_[~same]
        bits = x[~same]
        low = (bits & (~bits + np.uint64(1))).astype(np.float64)
        out[ended] = at + (np.log2(low).astype(np.int64) >> 3)
        open_ = open_[same]
        open_ = open_[room[open_] > at]
        out[open_] = at + 8
        if not len(open_):
            break
    return np.minimum(out, room)


def equal_windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each start, alike where ``WINDOW`` bytes are equal; -1 where none other is."""
    sa = suffix_array(text, WINDOW)
    wanted = np.full(len(text), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = sa[wanted[sa] >= 0]
    # the prefix each suffix shares with the one before it, kept in text order
    shared = np.zeros(len(text), np.int64)
    shared[order[1:]] = common_prefixes(text, order[1:], order[:-1], WINDOW)
    joins = shared[order] >= WINDOW
    number = np.cumsum(~joins) - 1
    sizes = np.bincount(number, minlength=1)
    out = np.full(len(starts), -1, np.int64)
    out[wanted[order]] = np.where(sizes[number] > 1, number, -1)
    return out


SEARCH = Search(Bytes, WINDOW, GRAM, equal_windows, first_stays=False)


def deduplicated(docs: DataFrame, full: bool = False) -> DataFrame:
    """Remove every byte under a 200-byte string that also starts anywhere else.

    See ``repeats.without_repeats`` for columns, nulls, ties and empty tables.
    """
    return without_repeats(docs, SEARCH, full)
