"""Suffix arrays by induced sorting and permuted common prefixes, a bucket at a time in numpy."""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. Beyond the end stands a letter below all others."""
    s = np.zeros(len(t), bool)
    if len(t) > 1:
        step = np.sign(t[1:].astype(np.int32) - t[:-1])
        at = np.where(step != 0, np.arange(len(step)), len(step))
        at = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = np.append(step, -1)[at] > 0
    return s


def _deal(into: np.ndarray, pointer: np.ndarray, letters: np.ndarray, values: np.ndarray, sign: int) -> None:
    """Put values into their letters' buckets in order, from the pointers up (sign 1) or down (-1)."""
    order = np.argsort(letters, kind="stable")
    letters, values = letters[order], values[order]
    count = np.bincount(letters, minlength=len(pointer))
    within = np.arange(len(letters)) - (np.cumsum(count) - count)[letters]
    if sign > 0:
        into[pointer[letters] + within] = values
        pointer += count
    else:
        into[pointer[letters] - 1 - within] = values
        pointer -= count


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller suffixes in order: one scan up induces the larger-type suffixes,
    one scan down the smaller-type ones. A scan takes one bucket at a time, all of its entries at once."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    total = np.bincount(t, minlength=letters)
    end = np.cumsum(total)
    start = end - total
    up = start.copy()
    seed = np.cumsum(np.bincount(t[lms], minlength=letters)) if len(lms) else np.zeros(letters, int)
    sa[up[t[n - 1]]] = n - 1
    up[t[n - 1]] += 1
    for c in np.flatnonzero(total):
        found, at = [], start[c]
        while at < up[c]:
            before = sa[at : up[c]] - 1
            at = up[c]
            before = before[before >= 0]
            before = before[~small[before]]
            same = t[before] == c
            here = before[same]
            sa[at : at + len(here)] = here
            up[c] += len(here)
            found.append(before[~same])
        found.append(lms[(seed[c - 1] if c else 0) : seed[c]] - 1)
        if len(found := np.concatenate(found)):
            _deal(sa, up, t[found], found, 1)
    down = end.copy()
    for c in np.flatnonzero(total)[::-1]:
        found, at = [], end[c]
        while at > down[c]:
            before = sa[down[c] : at][::-1] - 1
            at = down[c]
            before = before[before >= 0]
            before = before[small[before]]
            same = t[before] == c
            here = before[same]
            sa[at - len(here) : at] = here[::-1]
            down[c] -= len(here)
            found.append(before[~same])
        before = sa[start[c] : up[c]][::-1] - 1
        before = before[before >= 0]
        found.append(before[small[before]])
        if len(found := np.concatenate(found)):
            _deal(sa, down, t[found], found, -1)
    return sa


def _ranks(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names: names of ever longer pairs, until all differ."""
    rank, k = names.astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        if k < len(rank):
            after[:-k] = rank[k:] + 1
        values, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        if len(values) == len(rank):
            return rank
        k *= 2


def suffix_array(t: np.ndarray, letters: int = 257) -> np.ndarray:
    """Order of all suffixes of t. Leftmost-smaller substrings are sorted by inducing and named; while names tie, the
    string of names is sorted in its turn (by ranks of pairs, as its alphabet is too large for buckets)."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    small = classify(t)
    head = np.zeros(n, bool)
    head[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(head).astype(np.int32)
    sa = induce(t, small, lms[np.argsort(t[lms], kind="stable")], letters)
    if len(lms) < 2:
        return sa
    placed = sa[head[sa]]
    # Substrings run to the next leftmost-smaller place, inclusive; the last one to the end, where it differs from all.
    size = np.zeros(n, np.int32)
    size[lms] = np.append(np.diff(lms) + 1, 0)
    a, b = placed[:-1], placed[1:]
    new = size[a] != size[b]
    live, k = np.flatnonzero(~new), 0
    while live.size:
        differ = t[a[live] + k] != t[b[live] + k]
        new[live[differ]] = True
        k += 1
        live = live[~differ & (size[a[live]] > k)]
    names = np.zeros(n, np.int64)
    names[placed] = np.concatenate([[0], np.cumsum(new)])
    order = placed
    if not new.all():
        order = np.empty(len(lms), np.int32)
        order[_ranks(names[lms])] = lms
    return induce(t, small, order, letters)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position: letters shared with the suffix before it in order.

    Where the letters before both suffixes agree, a value is one less than that of the position before;
    only the others are compared letter by letter.
    """
    n = len(t)
    prev = np.full(n, -1, np.int64)
    prev[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = np.ones(n, bool)
    inner = (at > 0) & (prev > 0)
    own[inner] = t[at[inner] - 1] != t[prev[inner] - 1]
    padded = np.concatenate([t.astype(np.int32), [-1]])
    lcp = np.zeros(n, np.int64)
    live, k = at[own & (prev >= 0)], 0
    # Where a text ends the other differs from it, so no comparison runs past both ends.
    while live.size:
        same = padded[np.minimum(live + k, n)] == padded[np.minimum(prev[live] + k, n)]
        lcp[live[~same]] = k
        live = live[same]
        k += 1
    origin = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(lcp[origin] - (at - origin), 0)
