"""Points against areas in blocks: a row is one area and up to ``BLOCK`` points that lie close together, counted in numpy.

A block is dropped by its box, counted whole where no edge comes near it, and tested point by point elsewhere, so the work
grows with the blocks along the outlines, not with the points inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import LAT_PER_METER, LNG_PER_METER
from ..llm.common import small_batches
from .spatial import _level, _size

BLOCK = 512  #: points of a block
FINE = 4  #: times that a cell is halved each way; its points are sorted along the curve through the parts
ROOM = 1 << 18  # point and edge pairs held at once

_KEY = ["lv", "cx", "cy"]


def point_blocks(points: DataFrame, levels: DataFrame) -> DataFrame:
    """Points (``x, y``) of each cell of the given levels in blocks: level, cell, box, ``px`` and ``py``.

    The shuffle is a rebalance, so the points of a crowded cell can go to many tasks.
    """
    # ``levels`` has at most LEVELS rows, so the broadcast is bounded by construction.
    p = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").join(F.broadcast(levels))
    s = _size(F.col("lv"))
    cell = [F.floor(F.col(c) / s) for c in "xy"]
    part = [F.floor(F.col(c) / (s / (1 << FINE))).bitwiseAND((1 << FINE) - 1) for c in "xy"]
    curve = sum((F.shiftleft(F.shiftright(v, i).bitwiseAND(1), 2 * i + k) for i in range(FINE) for k, v in enumerate(part)), F.lit(0))
    p = p.select(F.col("lv").cast("long"), cell[0].alias("cx"), cell[1].alias("cy"), curve.alias("at"), "x", "y").withColumn("quarter", F.shiftright("at", 2 * FINE - 2))
    p = p.hint("rebalance", *_KEY, "quarter").sortWithinPartitions(*_KEY, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (*_KEY, "quarter")])
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            new = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            ends = np.r_[new[1:], len(x)]
            # Longer runs are cut into blocks.
            cuts = [np.arange(a, e, BLOCK) for a, e in zip(new, ends)]
            at = np.concatenate(cuts)
            off = pa.array(np.r_[at, len(x)].astype(np.int32))
            least, most = np.minimum.reduceat, np.maximum.reduceat
            cols = [pa.array(k[at]) for k in key[:3]] + [pa.array(v) for v in (least(x, at), least(y, at), most(x, at), most(y, at))]
            cols += [pa.ListArray.from_arrays(off, pa.array(v)) for v in (x, y)]
            yield pa.RecordBatch.from_arrays(cols, names=[*_KEY, "bx0", "by0", "bx1", "by1", "px", "py"])

    return small_batches(p).mapInArrow(run, "lv long, cx long, cy long, bx0 double, by0 double, bx1 double, by1 double, px array<double>, py array<double>")


def _meetings(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Each area (``id, edges``, its box) beside each block of points that its box meets."""
    box = ("xmin", "ymin", "xmax", "ymax")
    a = areas.select("id", "edges", *box).withColumn("lv", _level(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))).cast("long"))
    blocks = point_blocks(points, a.select("lv").distinct())
    s = _size(F.col("lv"))
    for c, lo, hi in (("cx", "xmin", "xmax"), ("cy", "ymin", "ymax")):
        a = a.withColumn(c, F.explode(F.sequence(F.floor(F.col(lo) / s), F.floor(F.col(hi) / s))))
    meet = (F.col("bx0") <= F.col("xmax")) & (F.col("xmin") <= F.col("bx1")) & (F.col("by0") <= F.col("ymax")) & (F.col("ymin") <= F.col("by1"))
    return blocks.join(a, _KEY).where(meet).select("id", "edges", *box, "bx0", "by0", "bx1", "by1", "px", "py")


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the runs that start at ``first`` and are ``n`` long."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _odd(x1, y1, x2, y2, x, y):
    """A ray to the right of the point crosses the edge: the test of ``spatial.inside_expr``."""
    with np.errstate(all="ignore"):
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def inside_of(batch: pa.RecordBatch, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The points of each row that lie in its area: (row, x, y, n). With ``whole`` a block that no edge comes near is one entry."""
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    px, edges = batch.column("px"), batch.column("edges")
    x, y = px.flatten().to_numpy(), batch.column("py").flatten().to_numpy()
    p_off, e_off = (np.asarray(c.offsets.to_numpy(), np.int64) for c in (px, edges))
    p_off, e_off = p_off - p_off[0], e_off - e_off[0]
    flat = edges.flatten()
    x1, y1, x2, y2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
    rows = np.arange(len(batch))
    n_p, n_e = np.diff(p_off), np.diff(e_off)
    # An edge matters to a block only where it is not wholly above, below or left of it; an edge wholly to the right counts for all or none of a point's height.
    e_row = np.repeat(rows, n_e)
    bx0, by0, bx1, by1 = (get(c)[e_row] for c in ("bx0", "by0", "bx1", "by1"))
    high, low, right = np.maximum(y1, y2), np.minimum(y1, y2), np.maximum(x1, x2)
    # One ulp of the crossing's place is far below this.
    slack = 1e-9 * (1.0 + np.abs(x1) + np.abs(x2))
    matter = (high > by0) & (low <= by1) & (right + slack >= bx0)
    near = matter & ((low > by0) | (high <= by1) | (np.minimum(x1, x2) - slack <= bx1))
    box = [get(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    held = (box[0] <= get("bx0")) & (box[1] <= get("by0")) & (box[2] >= get("bx1")) & (box[3] >= get("by1"))
    alone = held & (np.bincount(e_row[near], minlength=len(rows)) == 0) if whole else np.zeros(len(rows), bool)
    # Of a block that is alone, one point stands for all.
    n_t = np.where(alone, np.minimum(n_p, 1), n_p)
    keep_e = np.flatnonzero(matter)
    e_at = np.searchsorted(e_row[keep_e], np.arange(len(rows) + 1))
    k1, l1, k2, l2 = x1[keep_e], y1[keep_e], x2[keep_e], y2[keep_e]
    out: list[list[np.ndarray]] = [[], [], [], []]
    cost = np.cumsum(n_t * np.maximum(1, np.diff(e_at)))
    a = 0
    while a < len(rows):
        e = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + ROOM, "right")))
        t = _ranges(p_off[a:e], n_t[a:e])
        t_row = np.repeat(rows[a:e], n_t[a:e])
        tx, ty = x[t], y[t]
        boxed = (tx >= box[0][t_row]) & (tx <= box[2][t_row]) & (ty >= box[1][t_row]) & (ty <= box[3][t_row])
        t_row, tx, ty = t_row[boxed], tx[boxed], ty[boxed]
        m = np.diff(e_at)[t_row]
        j = _ranges(e_at[t_row], m)
        hit = _odd(k1[j], l1[j], k2[j], l2[j], np.repeat(tx, m), np.repeat(ty, m))
        odd = np.bincount(np.repeat(np.arange(len(t_row)), m)[hit], minlength=len(t_row)) % 2 == 1
        t_row = t_row[odd]
        for o, v in zip(out, (t_row, tx[odd], ty[odd], np.where(alone[t_row], n_p[t_row], 1))):
            o.append(v)
        a = e
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def count_inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """``(id, n)``: how many of the points (``x, y``) lie in each area (``id, edges``, box) that holds any."""
    kind = areas.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                row, _, _, n = inside_of(b, True)
                total = np.bincount(row.astype(np.int64), n, len(b)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(total)], names=["id", "n"])

    return _meetings(points, areas).mapInArrow(run, f"id {kind}, n long").where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))


def _steps(v: np.ndarray, mid: np.ndarray, per_metre: float) -> np.ndarray:
    """The steps of ``cells.pixel_index`` for pixels of a metre."""
    gap = np.ceil(np.abs(v - mid) / (1.0 * per_metre) - 0.5).astype(np.int64)
    return np.where(v > mid, gap, -gap)


def count_pixels(points: DataFrame, areas: DataFrame, rows: int, cols: int) -> DataFrame:
    """``(id, row, col, heat)``: the points in each area per pixel of the grid around the area's box."""
    kind = areas.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            at, x, y, _ = inside_of(b, False)
            at = at.astype(np.int64)
            x0, y0, x1, y1 = (b.column(c).to_numpy(zero_copy_only=False)[at] for c in ("xmin", "ymin", "xmax", "ymax"))
            r, c = _steps(y, (y0 + y1) / 2, LAT_PER_METER) + rows // 2, _steps(x, (x0 + x1) / 2, LNG_PER_METER) + cols // 2
            ok = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
            spot, n = np.unique((at[ok] * rows + r[ok]) * cols + c[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(spot // (rows * cols))), pa.array(spot // cols % rows), pa.array(spot % cols), pa.array(n.astype(np.int64))], names=["id", "row", "col", "n"])

    d = _meetings(points, areas)
    # A block beyond the grid has no pixel.
    mid = {c: (F.col(f"{c}min") + F.col(f"{c}max")) / 2 for c in "xy"}
    for c, n, per in (("x", cols, LNG_PER_METER), ("y", rows, LAT_PER_METER)):
        reach = (n // 2 + 2) * per
        d = d.where((F.col(f"b{c}1") >= mid[c] - reach) & (F.col(f"b{c}0") <= mid[c] + reach))
    return d.mapInArrow(run, f"id {kind}, row long, col long, n long").groupBy("id", "row", "col").agg(F.sum("n").alias("heat"))
