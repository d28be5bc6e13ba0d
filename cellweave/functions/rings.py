"""Row-local repair of point sequences (``array<struct<x, y>>``): no shuffle, one pass per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import haversine, signed_area, single_ring, xy  # noqa: F401 - re-exported for callers


def _at(pts: Column, i) -> Column:
    return F.get(pts, i if isinstance(i, Column) else F.lit(i))


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def thin_near(pts: Column, digits: int = 5) -> Column:
    """Drop points equal to the one before at ``digits`` decimals; the last point always stays."""
    rounded = F.transform(pts, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))

    def keep(r):
        return F.filter(pts, lambda p, i: (i == 0) | (i == F.size(pts) - 1) | (_at(r, i) != F.get(r, F.greatest(i - 1, F.lit(0)))))

    return _bind(rounded, keep)


def dedup_ring(pts: Column) -> Column:
    """Cut at the first return to the start, keep first occurrences, and start at the inner
    point that the last one repeats. A plainly closed ring loses its closing point."""
    n = F.size(pts)
    first, last = _at(pts, 0), _at(pts, n - 1)
    back = F.when(n > 2, F.array_position(F.slice(pts, 2, F.greatest(n - 2, F.lit(0))), first)).otherwise(0)

    def whole(u):
        at = F.array_position(u, last)
        repeats = F.array_position(F.slice(pts, 1, n - 1), last) > 0
        return F.when(repeats & (at > 1), F.concat(F.slice(u, at.cast("int"), F.size(u)), F.array(last))).otherwise(u)

    cut = F.concat(F.array_distinct(F.slice(pts, 1, back.cast("int"))), F.array(first))
    return F.when(back > 0, cut).otherwise(_bind(F.array_distinct(pts), whole))


def drop_spikes(pts: Column, min_area: float = 1e-10) -> Column:
    """Remove out-and-back spikes and loops of at most ``min_area``, inside and around the ends."""
    n = F.size(pts)
    idx = F.transform(pts, lambda p, i: F.struct((F.array_position(pts, p).cast("int") - 1).alias("a"), i.alias("b")))
    pairs = F.array_sort(F.filter(idx, lambda r: r["a"] < r["b"]))
    none = F.array().cast("array<int>")

    def tiny(seq):
        return F.abs(signed_area(seq)) <= min_area

    def inner(gone, r):
        a, b = r["a"], r["b"]
        loop = F.sequence(a + 1, b)
        return (
            F.when(F.array_contains(gone, a), gone)
            .when(b - a == 2, F.concat(gone, F.array(b, b - 1)))
            .when(tiny(F.slice(pts, a + 1, b - a)), F.concat(gone, loop))
            .otherwise(gone)
        )

    def outer(gone, r):
        a, b = r["a"], r["b"]
        around = F.concat(F.slice(pts, b + 1, n), F.slice(pts, 1, a + 1))
        tail = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > b) | (i < a))
        short = F.size(around) <= 3
        return F.when(F.array_contains(gone, b), gone).when(short | tiny(around), F.concat(gone, tail)).otherwise(gone)

    gone1 = F.aggregate(pairs, none, inner)
    gone2 = _bind(gone1, lambda g: F.aggregate(F.reverse(pairs), g, outer))
    return _bind(gone2, lambda g: F.filter(pts, lambda p, i: ~F.array_contains(g, i)))


def close_ring(pts: Column) -> Column:
    """Close an open outline. Where an end runs away from the other end it is cut back first,
    and of the two ways to do so the larger shape is taken."""
    n = F.size(pts)
    s, e = _at(pts, 0), _at(pts, n - 1)
    from_start = F.transform(pts, lambda p: haversine(s["x"], s["y"], p["x"], p["y"]))
    from_end = F.transform(pts, lambda p: haversine(e["x"], e["y"], p["x"], p["y"]))

    def cut_end(d):
        back = F.filter(F.sequence(F.lit(1), n - 2), lambda i: F.get(d, i) > F.get(d, i + 1))
        return F.coalesce(F.array_max(back) + 1, n - 1)

    def cut_start(d):
        forth = F.filter(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: (i <= n - 3) & (F.get(d, i) > F.get(d, i - 1)))
        return F.coalesce(F.array_min(forth) - 1, F.lit(0))

    def choose(c):
        one = F.slice(pts, 1, c["s"] + 1)
        two = F.slice(pts, c["e"] + 1, n)
        larger = F.abs(signed_area(one)) > F.abs(signed_area(two)) * (1 + 1e-9)
        plain = (c["s"] == n - 1) & (c["e"] == 0)
        return (
            F.when(plain, F.concat(pts, F.array(s)))
            .when(larger, F.concat(one, F.array(s)))
            .otherwise(F.concat(two, F.slice(pts, c["e"] + 1, 1)))
        )

    cuts = F.struct(_bind(from_start, cut_end).alias("s"), _bind(from_end, cut_start).alias("e"))
    return F.when((n < 3) | (s == e), pts).otherwise(_bind(cuts, choose))


def densify(pts: Column, metres: float) -> Column:
    """Split every edge into ceil(length / metres) equal pieces."""
    def edge(p, i):
        q = _at(pts, i + 1)
        k = F.greatest(F.ceil(haversine(p["x"], p["y"], q["x"], q["y"]) / metres), F.lit(1)).cast("int")
        # Bound once an edge: inside the next lambda they would be computed for every point.
        return _bind(F.struct(q.alias("q"), k.alias("k")), lambda e: F.transform(
            F.sequence(F.lit(0), e["k"] - 1),
            lambda j: F.when(j == 0, p).otherwise(xy(p["x"] - F.round((p["x"] - e["q"]["x"]) * j / e["k"], 12), p["y"] - F.round((p["y"] - e["q"]["y"]) * j / e["k"], 12))),
        ))

    n = F.size(pts)
    inner = F.transform(F.slice(pts, 1, n - 1), edge)
    return F.concat(F.flatten(inner), F.slice(pts, n, 1))


def line_length(pts: Column) -> Column:
    """Length in metres."""
    n = F.size(pts)
    legs = F.zip_with(F.slice(pts, 1, n - 1), F.slice(pts, 2, n), lambda p, q: haversine(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, v: s + v)


def running_length(pts: Column) -> Column:
    """Distance from the start at every point."""
    n = F.size(pts)
    legs = F.zip_with(F.slice(pts, 1, n - 1), F.slice(pts, 2, n), lambda p, q: haversine(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(legs, F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))


def _thin(pts: pa.ListArray, most: int, passes: int) -> pa.ListArray:
    """The passes of ``thin_outline`` over a batch of outlines side by side. A row that a pass leaves alone is done."""
    start, size = pts.offsets.to_numpy()[:-1].astype(np.int64), pc.fill_null(pc.list_value_length(pts), 0).to_numpy().astype(np.int64)
    x, y = (pts.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    known = pc.and_(pc.is_valid(pts.values.field("x")), pc.is_valid(pts.values.field("y"))).to_numpy(zero_copy_only=False)
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    todo = size >= most
    for _ in range(passes):
        if not todo.any():
            break
        i = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        odd = np.flatnonzero(np.repeat(todo, size) & (i % 2 == 1) & (i < np.repeat(size, size) - 1))
        a, p, b = at[odd - 1], at[odd], at[odd + 1]
        with np.errstate(invalid="ignore"):
            off = np.abs((x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a]))
            # As in Spark: no number is above all numbers, but not above itself.
            ends = np.isnan(x[a]) | np.isnan(x[b]) | np.isnan(y[a]) | np.isnan(y[b])
            far = (off > 0) | (np.isnan(off) & ~ends)
        gone = odd[~(far & known[a] & known[p] & known[b])]
        keep = np.ones(len(at), bool)
        keep[gone] = False
        lost = np.bincount(np.repeat(np.arange(len(size)), size)[gone], minlength=len(size))
        at, size = at[keep], size - lost
        todo = (lost > 0) & (size >= most)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(pc.is_null(pts).to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pts.values.take(pa.array(at)))


def thin_outline(pts: Column, max_points: int = 500, tolerances: tuple[float, ...] = (1e-6, 2e-6, 3e-6), passes: int = 4) -> Column:
    """Thin outlines of ``max_points`` or more, then round to 6 decimals.

    A pass drops every second point that lies on the line through its neighbours, so two neighbours never
    go together; passes go on, at most ``passes`` for each tolerance, while there are still too many points.
    The tolerances are only counted: no version has applied them yet (see REPLY_r03.md), and results stay as they were.
    """
    @F.arrow_udf("array<struct<x: double, y: double>>")
    def thin(a: pa.Array) -> pa.Array:
        return _thin(a, max_points, passes * len(tolerances))

    return F.transform(thin(pts), lambda p: xy(F.round(p["x"], 6), F.round(p["y"], 6)))


def self_crossing(pts: Column) -> Column:
    """Whether two edges of an open ring properly cross."""
    n = F.size(pts)

    def turn(p, q, r):
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def crosses(i, j):
        a, b, c, d = _at(pts, i), _at(pts, (i + 1) % n), _at(pts, j), _at(pts, (j + 1) % n)
        return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)

    ks = F.sequence(F.lit(0), n - 1)
    return F.exists(ks, lambda i: F.exists(ks, lambda j: (j > i + 1) & crosses(i, j)))


def rectangle(a: Column, b: Column) -> Column:
    """Corner points of the box spanned by two diagonal corners."""
    x0, x1 = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    y0, y1 = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    return F.array(xy(x0, y0), xy(x0, y1), xy(x1, y1), xy(x1, y0))
