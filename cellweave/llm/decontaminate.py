"""Benchmark decontamination by suffix arrays over the training text and binary search of every test suffix."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from ..session import stage
from .common import map_rows, utf8

FOUND = "_words long, _spans array<struct<first:int,end:int>>, _items array<string>"
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


class TestSet:
    """The test texts as word numbers: one array with a 0 after each item, and the length of each item's windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        ids, owner, left, width = [], [], [], []
        self.names = []
        for name, text in items:
            words = text.translate(FOLD).split()
            if not words:
                continue
            n = len(words)
            ids += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] + [0]
            owner += [len(self.names)] * (n + 1)
            left += list(range(n, -1, -1))
            width += [min(window, n)] * (n + 1)
            self.names.append(name)
        self.ids, self.owner, self.left, self.width = (np.array(x, np.int32) for x in (ids, owner, left, width))
        self.starts = np.flatnonzero(self.left > 0)
        self.least = int(self.width.min()) if ids else 0
        self.longest = int(self.left.max()) if ids else 0


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` words, by doubling of ranks."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k or None] = rank[k:] if k < len(rank) else 0
        values, rank = np.unique(rank * (len(ids) + 2) + after, return_inverse=True)
        rank = rank + 1
        if len(values) == len(ids):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def search(test: TestSet, text: np.ndarray, order: np.ndarray):
    """All test suffixes at once: the interval of text suffixes that share their window, and the longest match.

    Returns (window starts found, low, high, longest match of each test suffix).
    """
    at = test.starts
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    longest = np.zeros(len(at), np.int32)
    padded = np.concatenate([text, np.zeros(test.longest + 1, text.dtype)])
    alive, found, depth = np.arange(len(at)), [], 0

    def bound(lo, hi, word, right):
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            v, w = padded[order[mid] + depth], word[open_]
            go = v <= w if right else v < w
            lo[open_] = np.where(go, mid + 1, lo[open_])
            hi[open_] = np.where(go, hi[open_], mid)
        return lo

    while alive.size:
        word = test.ids[at[alive] + depth]
        lo, hi = bound(low[alive], high[alive], word, False), bound(low[alive], high[alive], word, True)
        ok = (word > 0) & (lo < hi)
        alive, lo, hi = alive[ok], lo[ok], hi[ok]
        low[alive], high[alive] = lo, hi
        depth += 1
        longest[alive] = depth
        full = test.width[at[alive]] == depth
        found.append((at[alive[full]], lo[full], hi[full]))
    return (*[np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found)], longest) if found else (np.zeros(0, np.int64),) * 3 + (longest,)


def scan(test: TestSet, texts: list[bytes]):
    """For each text: its word count, the spans of words inside occurring windows, the items that occur.

    Positions whose next words (as many as the shortest window has) are not all test words cannot start an
    occurrence, so the suffix array leaves them out; this loses nothing.
    """
    counts, parts = [], []
    for t in texts:
        words = t.translate(FOLD).split()
        counts.append(len(words))
        parts.append(np.fromiter(map(test.vocab.get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    spans, items = [[] for _ in texts], [set() for _ in texts]
    if not test.names or not texts:
        return counts, spans, items
    ids = np.concatenate(parts)
    del parts
    begin = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
    first, end = edges[::2], edges[1::2]
    long = end - first >= test.least
    first, end = first[long], end[long]
    if not first.size:
        return counts, spans, items
    size = end - first + 1  # each run keeps the 0 after it
    origin = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text = ids[np.minimum(origin, len(ids) - 1)]
    text[np.cumsum(size) - 1] = 0
    order = suffix_array(text, test.longest)
    left = np.repeat(np.cumsum(size) - 1, size) - np.arange(size.sum())
    order = order[left[order] >= test.least]
    window, low, high, _ = search(test, text, order)
    if not window.size:
        return counts, spans, items
    width = test.width[window]
    cover = np.zeros(len(ids) + 1, np.int32)
    places, which = np.unique(np.stack([low, high, width]), axis=1, return_inverse=True)
    which = which.ravel()
    for lo, hi, w in places.T:
        at = origin[order[lo:hi]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + w, -1)
    inside = np.cumsum(cover[:-1]) > 0
    # A window never crosses the 0 between two texts, so spans don't either.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    for a, b, d in zip(edges[::2].tolist(), edges[1::2].tolist(), (np.searchsorted(begin, edges[::2], "right") - 1).tolist()):
        spans[d].append((a - int(begin[d]), b - int(begin[d])))
    owners: dict[int, set] = {}
    for k, o in zip(which.tolist(), test.owner[window].tolist()):
        owners.setdefault(k, set()).add(test.names[o])
    for k, (lo, hi, _) in enumerate(places.T):
        for d in np.unique(np.searchsorted(begin, origin[order[lo:hi]], "right") - 1).tolist():
            items[d] |= owners[k]
    return counts, spans, items


def union(a: list, b: list) -> list:
    out: list = []
    for first, end in sorted([*a, *b]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def locate(docs: DataFrame, tests: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", test_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """All rows with ``_words``, ``_spans`` (word ranges inside occurring windows) and ``_items``.

    A shard is one Arrow batch of documents. The test set goes to the executors in blocks, cut by running totals of
    the bytes of its distinct rows: at most ``block_bytes`` and one row each, whatever its size and however often an item
    repeats. Every block makes one more pass over the same rows, which unites its spans with those found before.
    """
    tests = tests.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(test_col), F.lit("")).alias("t")).where("i IS NOT NULL").distinct()
    tests = running(tests.withColumn("n", F.octet_length("t") + 1), [], ["i", "t"], {"total": "n"})
    tests = stage(tests.select("i", "t", F.floor((F.col("total") - F.col("n")) / block_bytes).alias("block")), "tests")
    blocks = [r.block for r in tests.select("block").distinct().orderBy("block").collect()] or [0]
    context = docs.sparkSession.sparkContext
    for b in blocks:
        rows = tests.where(F.col("block") == b).collect()
        block = context.broadcast([(r.i, r.t.encode()) for r in rows])
        first = b == blocks[0]

        def make(block=block, first=first):
            test = TestSet(block.value, window)

            def work(texts, *old):
                counts, spans, items = scan(test, utf8(texts))
                if not first:
                    spans = [union(s, [(x["first"], x["end"]) for x in o]) for s, o in zip(spans, old[0].to_pylist())]
                    items = [s | set(o) for s, o in zip(items, old[1].to_pylist())]
                return counts, [[{"first": a, "end": e} for a, e in s] for s in spans], [sorted(s) for s in items]

            return work

        docs = map_rows(docs, [text_col] + ([] if first else ["_spans", "_items"]), FOUND, make)
    return docs


def _sha(items):
    return F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256)


def report(docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; items without words or with a null id occur nowhere; repeated
    items are one item; other columns are not read; repeated rows are judged alike.
    """
    found = locate(docs.select(F.col(id_col), F.col(text_col)), tests, window, text_col, **more)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(id_col, F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), _sha(F.col("_items")).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


def remove(docs: DataFrame, tests: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows without any occurring window, with the columns they came with."""
    names = docs.columns
    return locate(docs, tests, window, text_col).where(F.size("_spans") == 0).select(*[f"`{c}`" for c in names])
