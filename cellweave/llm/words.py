"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z, keeps every other byte.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Any odd numbers do; these are fixed so that runs agree.
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a multiplier and of its inverse modulo 2**64, kept as long as the longest text seen."""

    def __init__(self, by: np.uint64 = _P):
        self.by = by
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                step = np.full(n, self.by)
                step[0] = 1
                self.up = np.multiply.accumulate(step)
                step = np.full(n, np.uint64(pow(int(self.by), -1, 1 << 64)))
                step[0] = 1
                self.down = np.multiply.accumulate(step)
        return self.up[:n], self.down[:n]


def word_hashes(texts: list[bytes], powers: Powers):
    """(64-bit hash of each blank-separated word, first word of each text and the end of the last)."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    solid = np.concatenate([[False], ~BLANK[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    first, end = edge[::2], edge[1::2]
    up, down = powers.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = mix((total[end] - total[first]) * down[first])
    return h, np.searchsorted(first, begin)


def shingles(texts: list[bytes], size: int, powers: Powers):
    """(hashes of the distinct shingles, grouped by text and sorted; start of each text's group and the end of the last).

    A text of fewer words than ``size`` has its whole sequence as one shingle; one without words has none.
    """
    h, at = word_hashes(texts, powers)
    n = np.diff(at)
    made = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), made)
    start = np.repeat(at[:-1] - (np.cumsum(made) - made), made) + np.arange(made.sum())
    left = at[owner + 1] - start
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        s = np.zeros(len(start), np.uint64)
        for k in range(size):
            # Beyond the text's last word a sequence of fewer words adds nothing.
            s += np.where(left > k, padded[start + k], np.uint64(0)) * _Q[k % len(_Q)] + np.uint64(k // len(_Q))
        s = mix(s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(texts) + 1))


def chunks(texts: list[bytes], limit: int = 4 << 20):
    """(first, end) ranges of texts of about ``limit`` bytes; a longer text is a chunk of its own."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > limit:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
