"""Measures of two outlines side by side, over Arrow batches of pairs: every pair stays in its row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.geometry import METRES_PER_DEGREE

ROOM = 1 << 16  # pairs of edges held at once


def _fold(op: np.ufunc, values: np.ndarray, sizes: np.ndarray, empty):
    """``op`` over consecutive lists of the given sizes."""
    out = np.full(len(sizes), empty, type(empty))
    some = sizes > 0
    if some.any():
        out[some] = op.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


class Edges:
    """The outlines of one side: coordinates of all edges, and how many each row has."""

    def __init__(self, x1, y1, x2, y2, sizes):
        self.xy, self.sizes = (x1, y1, x2, y2), sizes

    @classmethod
    def of(cls, column: pa.ListArray) -> Edges:
        flat = column.flatten()
        xy = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]
        return cls(*xy, np.diff(column.offsets.to_numpy()))

    @property
    def row(self):
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def box(self):
        x, y = self.xy[:2]
        return _fold(np.minimum, x, self.sizes, np.inf), _fold(np.minimum, y, self.sizes, np.inf), _fold(np.maximum, x, self.sizes, -np.inf), _fold(np.maximum, y, self.sizes, -np.inf)

    def moved(self, ox, oy) -> Edges:
        ox, oy = np.repeat(ox, self.sizes), np.repeat(oy, self.sizes)
        x1, y1, x2, y2 = self.xy
        return Edges(x1 - ox, y1 - oy, x2 - ox, y2 - oy, self.sizes)

    def only(self, rows: np.ndarray, edges: np.ndarray | None = None) -> Edges:
        """Edges of the marked rows; with ``edges`` only those that are marked too."""
        go = np.repeat(rows, self.sizes)
        if edges is not None:
            go &= edges
        return Edges(*[c[go] for c in self.xy], np.bincount(self.row[go], minlength=len(rows))[rows])


def side_by_side(a: Edges, b: Edges, measures: dict[str, tuple[Callable, np.ufunc, float]], *per_row: np.ndarray) -> dict[str, np.ndarray]:
    """Each measure of all edge pairs of a row, folded per row; ``ROOM`` edge pairs (or one edge's) at a time."""
    row, n_b = a.row, b.sizes
    of_edge, first = n_b[row], (np.cumsum(n_b) - n_b)[row]
    upto = np.cumsum(of_edge)
    found = {k: [] for k in measures}
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROOM, "right")))
        n = of_edge[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = np.repeat(first[at:end] - (np.cumsum(n) - n), n) + np.arange(len(i))
        ea, eb, more = [c[i] for c in a.xy], [c[j] for c in b.xy], [p[row[i]] for p in per_row]
        with np.errstate(all="ignore"):
            for k, (f, op, empty) in measures.items():
                found[k].append(_fold(op, f(*ea, *eb, *more), n, empty))
        at = end
    return {k: _fold(op, np.concatenate(found[k]) if found[k] else np.zeros(0), a.sizes, empty) for k, (_, op, empty) in measures.items()}


def strip_area(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2):
    """Area under the lower of the two lines over their common x-range, signed by the edges' direction.

    Summed over all edge pairs of two shapes it is the area of their intersection.
    """
    lo = np.maximum(np.minimum(ax1, ax2), np.minimum(bx1, bx2))
    hi = np.minimum(np.maximum(ax1, ax2), np.maximum(bx1, bx2))

    def on_line(x, x1, y1, x2, y2):
        return np.where(x1 == x2, 0.0, y1 + (y2 - y1) * ((x - x1) / (x2 - x1)))

    fl, fh = on_line(lo, ax1, ay1, ax2, ay2), on_line(hi, ax1, ay1, ax2, ay2)
    gl, gh = on_line(lo, bx1, by1, bx2, by2), on_line(hi, bx1, by1, bx2, by2)
    below_l, below_h = np.minimum(fl, gl), np.minimum(fh, gh)
    t = np.where((fl == gl) & (fh == gh), 0.0, np.abs(fl - gl) / (np.abs(fl - gl) + np.abs(fh - gh)))
    mid = fl + (fh - fl) * t
    plain = (below_l + below_h) / 2 * (hi - lo)
    cut = (below_l + mid) / 2 * (hi - lo) * t + (mid + below_h) / 2 * (hi - lo) * (1 - t)
    size = np.where((fl - gl) * (fh - gh) >= 0, plain, cut)
    return np.where(lo < hi, np.where((ax1 > ax2) == (bx1 > bx2), size, -size), 0.0)


def touches(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2):
    """Closed segments a and b have a point in common."""
    turn = lambda x1, y1, x2, y2, x, y: np.sign((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
    boxes = (np.minimum(ax1, ax2) <= np.maximum(bx1, bx2)) & (np.minimum(bx1, bx2) <= np.maximum(ax1, ax2))
    boxes &= (np.minimum(ay1, ay2) <= np.maximum(by1, by2)) & (np.minimum(by1, by2) <= np.maximum(ay1, ay2))
    one = turn(ax1, ay1, ax2, ay2, bx1, by1) * turn(ax1, ay1, ax2, ay2, bx2, by2) <= 0
    return boxes & one & (turn(bx1, by1, bx2, by2, ax1, ay1) * turn(bx1, by1, bx2, by2, ax2, ay2) <= 0)


def gap2(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, kx=1.0, ky=1.0):
    """Least squared distance between the segments a and b when they do not meet."""
    def end(px, py, x1, y1, x2, y2):
        dx, dy, qx, qy = (x2 - x1) * kx, (y2 - y1) * ky, (px - x1) * kx, (py - y1) * ky
        long2 = dx * dx + dy * dy
        u = np.where(long2 > 0, np.clip((qx * dx + qy * dy) / long2, 0.0, 1.0), 0.0)
        return (qx - u * dx) ** 2 + (qy - u * dy) ** 2

    a, b = (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2)
    return np.minimum(np.minimum(end(ax1, ay1, *b), end(ax2, ay2, *b)), np.minimum(end(bx1, by1, *a), end(bx2, by2, *a)))


OVERLAP = {"inter": (strip_area, np.add, 0.0), "touch": (touches, np.logical_or, False)}
GAP = {"dd": (lambda *e: gap2(*e[:8]), np.minimum, np.inf), "dm": (lambda *e: gap2(*e[:8], e[8], METRES_PER_DEGREE), np.minimum, np.inf)}


def box_gap2(a: Edges, b: Edges) -> np.ndarray:
    """Squared metres between the boxes of two outlines: no pair of their points is nearer."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.box(), b.box()
    kx = np.cos(np.radians((ay0 + ay1 + by0 + by1) / 4)) * METRES_PER_DEGREE
    dx, dy = np.maximum(0.0, np.maximum(bx0 - ax1, ax0 - bx1)), np.maximum(0.0, np.maximum(by0 - ay1, ay0 - by1))
    return (dx * kx) ** 2 + (dy * METRES_PER_DEGREE) ** 2


def point_gap(e: Edges, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Metres from a row's point to its outline, 0 inside; local scale at the point."""
    n = e.sizes
    kx, x, y = np.repeat(np.cos(np.radians(y)) * METRES_PER_DEGREE, n), np.repeat(x, n), np.repeat(y, n)
    x1, y1, x2, y2 = e.xy
    with np.errstate(all="ignore"):
        odd = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        dx, dy, qx, qy = (x2 - x1) * kx, (y2 - y1) * METRES_PER_DEGREE, (x - x1) * kx, (y - y1) * METRES_PER_DEGREE
        long2 = dx * dx + dy * dy
        u = np.where(long2 > 0, np.clip((qx * dx + qy * dy) / long2, 0.0, 1.0), 0.0)
        gap = np.hypot(qx - u * dx, qy - u * dy)
    return np.where(_fold(np.add, odd.astype(np.int64), n, 0) % 2 == 1, 0.0, _fold(np.minimum, gap, n, np.inf))


def compare(l_edges: pa.ListArray, r_edges: pa.ListArray, what: str, gaps: tuple[str, ...] = ("dd", "dm")) -> dict[str, np.ndarray]:
    """``inter`` and ``touch`` per row; for ``"distance"`` also the squared distances ``dd`` and ``dm``; for ``"touch"`` that alone.

    Coordinates are relative to the pair's corner, for ``"touch"`` to the start of the left outline.
    """
    a, b = Edges.of(l_edges), Edges.of(r_edges)
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.box(), b.box()
    if what == "touch":
        ox, oy = (c[np.minimum(np.cumsum(a.sizes) - a.sizes, len(c) - 1)] if len(c) else np.zeros(len(a.sizes)) for c in a.xy[:2])
    else:
        ox, oy = np.minimum(ax0, bx0), np.minimum(ay0, by0)
    a, b = a.moved(ox, oy), b.moved(ox, oy)
    near = (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)

    def strip(e: Edges, lo, hi):
        return e.only(near, (np.minimum(e.xy[0], e.xy[2]) <= np.repeat(hi - ox, e.sizes)) & (np.maximum(e.xy[0], e.xy[2]) >= np.repeat(lo - ox, e.sizes)))

    # Only edges inside the common x-range count for areas and touching, and only where boxes meet.
    out = {}
    for k, v in side_by_side(strip(a, bx0, bx1), strip(b, ax0, ax1), {k: OVERLAP[k] for k in (["touch"] if what == "touch" else OVERLAP)}).items():
        out[k] = np.zeros(len(near), v.dtype)
        out[k][near] = v
    if what == "distance":
        kx = np.cos(np.radians((ay0 + ay1 + by0 + by1) / 4)) * METRES_PER_DEGREE
        out |= side_by_side(a, b, {k: GAP[k] for k in gaps}, kx)
    return out


FIELDS = {"overlap": "inter double, touch boolean", "distance": "inter double, touch boolean, dd double, dm double", "touch": "touch boolean"}


#: Rounding is far below this; who asks for ``within`` still has to test the distance itself.
SLACK = 1 + 1e-6


def measured_pairs(pairs: DataFrame, what: str = "overlap", within: float | None = None, points: str | None = None) -> DataFrame:
    """Pairs with ``l_edges`` and ``r_edges`` get ``inter`` and ``touch``, for ``"distance"`` also ``dd`` and ``dm`` (squares of
    degrees and of local metres), for ``"touch"`` that alone; ``l_edges`` and ``r_edges`` go.

    ``within``, for distances only: pairs that are farther apart in metres may be left out, those whose boxes are so unmeasured.
    ``points`` names a point of each side: ``l_gap`` is the way from the left one to the right outline, ``r_gap`` the other way."""
    rest = [f for f in pairs.schema.fields if f.name not in ("l_edges", "r_edges")]
    names = [f.name for f in rest]
    more = T.StructType.fromDDL(FIELDS[what] + (", l_gap double, r_gap double" if points else "")).fields

    def some(batch):
        if within is None:
            return batch, compare(batch.column("l_edges"), batch.column("r_edges"), what)
        gap = box_gap2(Edges.of(batch.column("l_edges")), Edges.of(batch.column("r_edges")))
        batch = batch.filter(pa.array(gap <= within * within * SLACK))
        found = compare(batch.column("l_edges"), batch.column("r_edges"), what, ("dm",))
        # Degrees are measured only where metres are few enough.
        go = found["touch"] | (found["inter"] > 0) | (found["dm"] <= within * within * SLACK)
        batch = batch.filter(pa.array(go))
        a, b = Edges.of(batch.column("l_edges")), Edges.of(batch.column("r_edges"))
        (ax0, ay0, *_), (bx0, by0, *_) = a.box(), b.box()
        o = np.minimum(ax0, bx0), np.minimum(ay0, by0)
        dd = side_by_side(a.moved(*o), b.moved(*o), {"dd": GAP["dd"]})["dd"]
        found = {k: v[go] for k, v in found.items()}
        return batch, {"inter": found["inter"], "touch": found["touch"], "dd": dd, "dm": found["dm"]}

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            batch, found = some(batch)
            if points:
                for k, at, to in (("l_gap", "l", "r_edges"), ("r_gap", "r", "l_edges")):
                    c = batch.column(f"{at}_{points}")
                    found[k] = point_gap(Edges.of(batch.column(to)), *[c.field(v).to_numpy(zero_copy_only=False) for v in "xy"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(v) for v in found.values()]], names=[*names, *found])

    return pairs.mapInArrow(run, T.StructType([*rest, *more]))
