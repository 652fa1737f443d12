"""Common prefixes of bounded length from a Burrows-Wheeler transform, by interval expansion."""

from __future__ import annotations

import numpy as np

#: Symbols (9 bits each) in one sort key.
PACKED = 7
NONE = np.iinfo(np.int64).max


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least, by sorting keys of doubling length."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(PACKED, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(PACKED):
        key = (key << np.uint64(9)) | padded[j : j + n]
    known = PACKED
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - known)] = rank[known:]
        key = (rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        known *= 2


def boundaries(lf: np.ndarray, first: np.ndarray, separators: int, depth: int) -> np.ndarray:
    """Rows of the suffix order at which the common prefix with the row before is shorter than depth.

    Breadth-first: the intervals of all strings of one length are extended backward by each symbol in their part of
    the transform (the rows that LF maps them to); the ends of an interval found at length l have a common prefix below
    l. An interval whose ends are both known leads to known ends only and is not followed. Strings don't contain separators.
    """
    n = len(lf)
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    owner = np.zeros(n, np.int32)
    for _ in range(depth):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        own = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        rows = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        to = lf[rows]
        inside = to >= separators
        to, own = to[inside], own[inside]
        if not len(to):
            break
        owner[to] = own
        to.sort()
        own = owner[to]
        symbol = first[to]
        new = np.flatnonzero((to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])) + 1
        start = np.concatenate([[0], new])
        lo = to[start]
        hi = to[np.concatenate([new, [len(to)]]) - 1] + 1
        fresh = ~found[lo] | ~found[hi]
        found[lo] = True
        found[hi] = True
        lo, hi = lo[fresh], hi[fresh]
    return found


def least_owner(contents: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` bytes of each content, the least owner of any content that has the same window.

    Returns (positions' content numbers, least owners), window after window, content after content.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    n = int((sizes + 1).sum())
    text = np.zeros(n, np.uint16)
    joined = np.frombuffer(b"".join(contents), np.uint8)
    which = np.repeat(np.arange(len(contents)), sizes)
    at = np.arange(len(joined)) + which
    text[at] = joined.astype(np.uint16) + 1
    order = suffix_order(text, length)
    transform = text[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    found = boundaries(lf, transform[by_symbol], len(contents), length)
    del lf, by_symbol, transform
    windows = np.maximum(sizes - length + 1, 0)
    content = np.repeat(np.arange(len(contents)), windows)
    position = np.arange(int(windows.sum())) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    own = np.full(n, NONE, np.int64)
    own[row[position]] = owners[content]
    heads = np.flatnonzero(found[:n])
    least = np.minimum.reduceat(own, heads)
    group = np.cumsum(found[:n]) - 1
    return content, least[group[row[position]]]
