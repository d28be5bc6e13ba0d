"""Parts and rings of coverages given as runs, over sorted Arrow batches: whole keys at a time, many keys in each step.

A key of more than ``ROOM`` runs never comes here; ``overlay`` and ``outline`` treat it by rounds over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import each

ROOM = 1 << 14  # runs of one key held at once
BATCH = 1 << 16  # runs looked at in one step


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each item but the first differs from the one before."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_changes(c) for c in column.flatten()])
    a, b = column[:-1], column[1:]
    null = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return null | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)


def whole_keys(rows: DataFrame, keys: list[str], order: list[str], f: Callable, schema: T.StructType) -> DataFrame:
    """``f(table, number of the key)`` over whole keys, sorted by keys and ``order``; a batch holds ``BATCH`` rows and the rest of a key."""
    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= BATCH:
                new = np.flatnonzero(np.logical_or.reduce([_changes(held.column(k)) for k in keys])) + 1
                if len(new):
                    yield from go(held.slice(0, int(new[-1])))
                    held = held.slice(int(new[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield from go(held)

    def go(table):
        table = table.combine_chunks()
        key = np.zeros(table.num_rows, np.int64)
        if table.num_rows > 1:
            key[1:] = np.cumsum(np.logical_or.reduce([_changes(table.column(k)) for k in keys]))
        return f(table, key).to_batches(max_chunksize=1 << 14)

    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_keys(runs: DataFrame, keys: list[str], f: Callable, schema: T.StructType, more: list[str] | None = None) -> DataFrame:
    """``whole_keys`` of runs by iy and x0, with the columns ``more``."""
    return whole_keys(runs.select(*keys, *(more or []), "iy", "x0", "x1"), keys, ["iy", "x0"], f, schema)


def numbers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().astype(np.int64) for c in ("iy", "x0", "x1"))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of ``lo .. hi`` (end excluded) of every row."""
    n = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def least_linked(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 .. n - 1 that each is linked with: roots hang below lesser ones, then paths are halved."""
    at = np.arange(n)
    while True:
        a, b = at[u], at[v]
        apart = a != b
        if not apart.any():
            return at
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(at, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = at[at]
            if np.array_equal(up, at):
                break
            at = up


def label(key: np.ndarray, iy: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Number of the connected part, from 1 in each key, of runs sorted by key, iy and x0. Equal runs belong together."""
    n = len(key)
    line = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (iy[1:] != iy[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    # Lines side by side on one axis: only the next line of the same key is looked at.
    wide = int(x1.max() - x0.min()) + 2
    above = np.append(first, n)[line + 1]
    ok = above < n
    ok[ok] = (key[above[ok]] == key[ok]) & (iy[above[ok]] == iy[ok] + 1)
    i = np.flatnonzero(ok)
    start, end = line * wide + (x0 - x0.min()), line * wide + (x1 - x0.min())
    lo, hi = np.searchsorted(end, start[i] + wide, "left"), np.searchsorted(start, end[i] + wide, "right")
    row, j = _ranges(lo, hi)
    twin = np.flatnonzero((line[1:] == line[:-1]) & (x0[1:] == x0[:-1]))
    at = least_linked(n, np.concatenate([i[row], twin]), np.concatenate([j, twin + 1]))
    nth = np.cumsum(at == np.arange(n))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return nth[at] - nth[begin][np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))] + 1


def label_runs(runs: DataFrame, keys: list[str], name: str, cut: bool) -> DataFrame:
    """``(keys, name, iy, x0, x1)``: with ``cut``, runs that touch end to end become one; then every run gets the number of its part."""
    fields = runs.select(*keys, F.lit(0).cast("long").alias(name), *[F.col(c).cast("long").alias(c) for c in ("iy", "x0", "x1")]).schema

    def f(table, key):
        iy, x0, x1 = numbers(table)
        new = np.flatnonzero(np.concatenate([[True], np.full(len(iy) - 1, not cut) | (key[1:] != key[:-1]) | (iy[1:] != iy[:-1]) | (x0[1:] != x1[:-1] + 1)]))
        key, iy, x0, x1 = key[new], iy[new], x0[new], x1[np.append(new[1:], len(x1)) - 1]
        own = table.select(keys).take(pa.array(new))
        return pa.table([*own.columns, pa.array(label(key, iy, x0, x1)), pa.array(iy), pa.array(x0), pa.array(x1)], names=[*keys, name, "iy", "x0", "x1"])

    return by_keys(runs, keys, f, T.StructType([T.StructField(x.name, x.dataType) for x in fields]))


def trace(key: np.ndarray, iy: np.ndarray, x0: np.ndarray, x1: np.ndarray):
    """Straight stretches of the outlines of all keys with their ring and step: (key, dir, sx, sy, ex, ey, ring, step).

    As ``outline.boundary`` and ``outline.ordered_rings`` say: an edge met once is kept, cells on the left, the left turn is taken
    where two rings meet, ``ring`` is the index of the ring's least stretch by (y, x, dir).
    """
    row, ix = _ranges(x0, x1 + 1)
    key, iy = key[row], iy[row]
    left, low = ix.min() - 1, iy.min() - 1
    wide, tall = int(ix.max() - left) + 3, int(iy.max() - low) + 3
    code = lambda k, x, y: (k * tall + (y - low)) * wide + (x - left)
    cell, n = np.unique(code(key, ix, iy), return_counts=True)
    has = lambda c, of: of[np.minimum(np.searchsorted(of, c), len(of) - 1)] == c if len(of) else np.zeros(len(c), bool)
    one = cell[n == 1]
    # Vertices have the codes of the cells that they are the lower left corner of; an edge is its start and direction.
    edges = []
    for d, beside, start in ((0, -wide, 0), (1, 1, 1), (2, wide, wide + 1), (3, -1, wide)):
        c = one[~has(one + beside, cell)]
        edges.append((c + start) * 4 + d)
    e = np.sort(np.concatenate(edges))
    move = np.array([1, wide, -1, -wide])
    d = e % 4
    end = e // 4 + move[d]
    nxt = np.full(len(e), -1)
    for turn in (0, 2, 1):  # straight on, right, and left over both
        want = end * 4 + (d + (turn + 1 if turn == 2 else turn)) % 4
        at = np.minimum(np.searchsorted(e, want), max(len(e) - 1, 0))
        hit = e[at] == want
        nxt[hit] = at[hit]
    # Corners only: an edge that starts where its forerunner had another direction starts a stretch, and runs to the next corner.
    before = np.empty(len(e), np.int64)
    before[nxt] = np.arange(len(e))
    corner = d[before] != d
    ahead = nxt.copy()
    while True:
        go = ~corner[ahead]
        if not go.any():
            break
        ahead[go] = ahead[ahead[go]]
    s = np.flatnonzero(corner)
    place = np.cumsum(corner) - 1
    follow = place[ahead[s]]
    at = e[s] // 4
    k, y, x = at // (tall * wide), at // wide % tall + low, at % wide + left
    # Sorted edges have the order (key, y, x, dir) already: the least index is the least stretch.
    least, off, to, span = np.arange(len(s)), np.zeros(len(s), np.int64), follow, 1
    while True:
        lower = least[to] < least
        if not lower.any() and span > 1:
            break
        off = np.where(lower, off[to] + span, off)
        least = np.where(lower, least[to], least)
        to, span = to[to], span * 2
        if span > 2 * len(s):
            break
    size = np.bincount(least, minlength=len(s))
    step = np.where(off == 0, 0, size[least] - off)
    return k, e[s] % 4, x, y, x[follow], y[follow], least, step


def traced(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ring, step, sx, sy, ex, ey)`` as ``outline.ordered_rings`` gives it."""
    fields = T.StructType([T.StructField(x.name, x.dataType) for x in runs.select(*keys).schema] + T.StructType.fromDDL(
        "ring struct<y: long, x: long, d: int>, step long, sx long, sy long, ex long, ey long").fields)

    def f(table, key):
        k, d, sx, sy, ex, ey, ring, step = trace(key, *numbers(table))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own = table.select(keys).take(pa.array(first[k]))
        node = pa.StructArray.from_arrays([pa.array(sy[ring]), pa.array(sx[ring]), pa.array(d[ring].astype(np.int32))], ["y", "x", "d"])
        return pa.table([*own.columns, node, *[pa.array(c) for c in (step, sx, sy, ex, ey)]], names=[*keys, "ring", "step", "sx", "sy", "ex", "ey"])

    return by_keys(runs, keys, f, fields)


def meeting(key: np.ndarray, iy: np.ndarray, x0: np.ndarray, x1: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, run, number of cells of the first with a cell of the second on the right or above) for runs sorted by key, iy and x0.

    Only the ``own`` runs come first. Runs may overlap, and a run meets itself where it has two cells: each pair of cells counts once.
    """
    line = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (iy[1:] != iy[:-1])]))
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    wide = int(x1.max() - x0.min()) + 3
    start, end = line * wide + (x0 - x0.min()), line * wide + (x1 - x0.min())
    upto = np.maximum.accumulate(end)
    above = np.append(begin, len(key))[line + 1]
    over = own & (above < len(key))
    over[over] = (key[above[over]] == key[over]) & (iy[above[over]] == iy[over] + 1)
    out = []
    for i, right, up in ((np.flatnonzero(own), 1, 0), (np.flatnonzero(over), 0, wide)):
        row, j = _ranges(np.searchsorted(upto, start[i] + right + up, "left"), np.searchsorted(start, end[i] + right + up, "right"))
        i = i[row]
        n = np.minimum(x1[i] + right, x1[j]) - np.maximum(x0[i] + right, x0[j]) + 1
        out.append((i[n > 0], j[n > 0], n[n > 0]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _codes(key: np.ndarray, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows' values within their key, and a row of each number."""
    code = key
    for c in columns:
        for v in c.flatten() if pa.types.is_struct(c.type) else [c]:
            v = v.dictionary_encode()
            code = np.unique(code * (len(v.dictionary) + 1) + pc.fill_null(v.indices, -1).to_numpy(zero_copy_only=False) + 1, return_inverse=True)[1]
    _, row, code = np.unique(code, return_index=True, return_inverse=True)
    return code, row


def touching(runs: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``(keys, a_<cols>, b_<cols>, k)``: pairs of a cell and the one on its right or above it, of the same key, counted by ``cols`` of both; counts
    of the same pair may come in parts. A task sees 64 lines of a key, and the one above them, at once."""
    r = runs.select(*keys, *cols, *[F.col(c).cast("long").alias(c) for c in ("iy", "x0", "x1")])
    r = r.withColumn("_band", F.explode(F.expr("array_distinct(array(shiftright(iy, 6), shiftright(iy - 1, 6)))")))
    fields = r.select(*keys, *[F.col(c).alias(f"{ab}_{c}") for ab in "ab" for c in cols], F.lit(0).cast("long").alias("k")).schema

    def f(table, key):
        iy, x0, x1 = numbers(table)
        a, b, n = meeting(key, iy, x0, x1, iy >> 6 == table.column("_band").to_numpy())
        code, row = _codes(key, [table.column(c).combine_chunks() for c in cols])
        pair, at = np.unique(code[a] * len(row) + code[b], return_inverse=True)
        k = np.zeros(len(pair), np.int64)
        np.add.at(k, at, n)
        a, b = (pa.array(row[x]) for x in (pair // len(row), pair % len(row)))
        own = [table.column(c).take(a) for c in keys] + [table.column(c).take(x) for x in (a, b) for c in cols]
        return pa.table([*own, pa.array(k)], names=[x.name for x in fields])

    return by_keys(r, [*keys, "_band"], f, T.StructType([T.StructField(x.name, x.dataType) for x in fields]), cols)


def large_keys(runs: DataFrame, keys: list[str], room: int) -> DataFrame:
    """Keys of more than ``room`` runs: at most one for every ``room`` rows, so few enough to broadcast."""
    return runs.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > room).select(*keys)


# ---- words: 64 cells of a grid row as the bits of a long ----------------------------------------------------------------------


def _mask(lo: str, hi: str) -> str:
    """SQL text: the bits of cells ``lo`` to ``hi`` within word ``wx``, 0 if there are none."""
    a, b = f"greatest({lo}, wx * 64)", f"least({hi}, wx * 64 + 63)"
    return f"CASE WHEN {a} > {b} THEN 0L ELSE shiftleft(shiftrightunsigned(-1L, CAST(63 - ({b} - {a}) AS INT)), CAST({a} - wx * 64 AS INT)) END"


def words(lines: DataFrame) -> DataFrame:
    """``(..., iy, wx, m)`` from grid rows ``(..., iy, xs)`` with the sorted starts and ends (excluded) of their runs: words of one row, none empty."""
    rest = [c for c in lines.columns if c != "xs"]
    w = each(lines.where("size(xs) > 1"), [*rest, "xs"], F.expr(
        "CASE WHEN xs[0] < xs[size(xs) - 1] THEN sequence(shiftright(xs[0], 6), shiftright(xs[size(xs) - 1] - 1, 6)) END"), "wx")
    m = f"aggregate(sequence(0, size(xs) - 2, 2), 0L, (s, i) -> s | ({_mask('xs[i]', 'xs[i + 1] - 1')}))"
    return each(w, [*rest, "wx"], F.array(F.expr(m)), "m").where("m <> 0")


def run_words(runs: DataFrame) -> DataFrame:
    """``(..., iy, wx, m)`` of runs ``(..., iy, x0, x1)``: a word for each run that it holds."""
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select("*", F.explode(F.expr("sequence(shiftright(x0, 6), shiftright(x1, 6))")).alias("wx")).select(*rest, "wx", F.expr(_mask("x0", "x1")).alias("m"))


def word_runs(words: DataFrame) -> DataFrame:
    """Runs ``(..., iy, x0, x1)`` of words ``(..., iy, wx, m)``, cut where a word ends."""
    rest = [c for c in words.columns if c not in ("wx", "m")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in words.select(*rest).schema] + T.StructType.fromDDL("x0 long, x1 long").fields)

    def run(batches):
        for b in batches:
            m = np.ascontiguousarray(b.column("m").to_numpy(zero_copy_only=False).astype("<i8")).view(np.uint8).reshape(-1, 8)
            bits = np.zeros((len(m), 66), np.int8)
            bits[:, 1:65] = np.unpackbits(m, axis=1, bitorder="little")
            turn = np.diff(bits, axis=1)
            row, lo = np.nonzero(turn == 1)
            hi = np.nonzero(turn == -1)[1]
            at = b.column("wx").to_numpy(zero_copy_only=False).astype(np.int64)[row] * 64
            own = [b.column(c).take(pa.array(row)) for c in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at + lo), pa.array(at + hi - 1)], names=[*rest, "x0", "x1"])

    return words.mapInArrow(run, schema)
