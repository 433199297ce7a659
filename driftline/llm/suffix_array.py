"""Suffix arrays by induced sorting, and their common prefixes in text order."""

from __future__ import annotations

import numpy as np


def _induced(s: list[int], larger: list[bool], ends: list[int], lms: list[int]) -> list[int]:
    """All suffixes in the order that the given order of leftmost-smaller ones induces, bucket by bucket."""
    n = len(s)
    sa = [-1] * n
    tail = ends[1:]
    for i in reversed(lms):
        c = s[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = ends[:-1]
    for x in sa:  # grows ahead of the scan
        if x > 0 and larger[x - 1]:
            c = s[x - 1]
            sa[head[c]] = x - 1
            head[c] += 1
    tail = ends[1:]
    for k in range(n - 1, -1, -1):
        x = sa[k] - 1
        if x >= 0 and not larger[x]:
            c = s[x]
            tail[c] -= 1
            sa[tail[c]] = x
    return sa


def _named(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings in their order; equal ones share a number."""
    stop = np.empty(len(s), np.int64)
    stop[lms] = np.r_[lms[1:], len(s) - 1]
    a, b = order[:-1], order[1:]
    size = stop[a] - a
    same = size == stop[b] - b
    live, k = np.flatnonzero(same), 0
    while len(live):
        alike = s[a[live] + k] == s[b[live] + k]
        same[live[~alike]] = False
        live = live[alike]
        k += 1
        live = live[size[live] >= k]
    return np.r_[0, np.cumsum(~same)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s``, whose last symbol must be its only 0.

    Suffixes are smaller or larger than their successors; the leftmost smaller ones are sorted
    by their substrings, by recursion where substrings repeat, and the others are induced from them in two scans.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    turn = np.flatnonzero(s[:-1] != s[1:])
    larger = np.zeros(n, bool)
    larger[: n - 1] = (s[turn] > s[turn + 1])[np.searchsorted(turn, np.arange(n - 1))]
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    ends = np.r_[0, np.cumsum(np.bincount(s))].tolist()
    plain, types = s.tolist(), larger.tolist()
    sa = np.array(_induced(plain, types, ends, lms.tolist()))
    first = np.zeros(n, bool)
    first[lms] = True
    order = sa[first[sa]]
    names = _named(s, order, lms)
    if names[-1] + 1 < len(order):
        at = np.empty(n, np.int64)
        at[order] = names
        order = lms[suffix_array(at[lms])]
    return np.array(_induced(plain, types, ends, order.tolist()))


def permuted_prefixes(raw: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each place of ``raw``: the bytes that its suffix shares with the one before it in ``sa``.

    ``left`` is how many bytes each suffix has before its piece ends; prefixes end there.
    Only places where the prefix is not the last one less its first byte are compared, eight bytes at a time.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    cut = np.ones(n, bool)
    b = before[1:]
    cut[1:] = (b < 1) | (raw[: n - 1] != raw[np.maximum(b - 1, 0)]) | (left[: n - 1] == 0) | (left[np.maximum(b - 1, 0)] == 0)
    some = np.flatnonzero(cut)
    some_b = before[some]
    out = np.zeros(n, np.int64)
    most = np.where(some_b < 0, 0, np.minimum(left[some], left[np.maximum(some_b, 0)]))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + 1,), (1,))
    shared, live = np.zeros(len(some), np.int64), np.flatnonzero(most > 0)
    while len(live):
        x = word[some[live] + shared[live]] ^ word[some_b[live] + shared[live]]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        shared[live[differ]] += np.log2(low.astype(np.float64)).astype(np.int64) >> 3
        live = live[~differ]
        shared[live] += 8
        live = live[shared[live] < most[live]]
    out[some] = np.minimum(shared, most)
    # in between, each is one less than the place before
    last = np.maximum.accumulate(np.where(cut, i, 0))
    return np.maximum(out[last] - (i - last), 0)
