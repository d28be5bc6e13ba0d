"""Convex hulls and the smallest rotated rectangle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _monotone_chain(xy: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of points, no repeated end."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    low, up = half(p), half(p[::-1])
    return np.array(low[:-1] + up[:-1])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hull_flat(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([_monotone_chain(np.column_stack([x, y])).ravel() for x, y in zip(xs, ys)])


def hull_of(pts: Column) -> Column:
    """Hull of one row's points, counter-clockwise and open."""
    flat = _hull_flat(F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"]))
    return F.transform(
        F.array(flat),
        lambda f: F.transform(
            F.sequence(F.lit(0), F.floor(F.size(f) / 2).cast("int") - 1),
            lambda i: F.struct(F.get(f, i * 2).alias("x"), F.get(f, i * 2 + 1).alias("y")),
        ),
    )[0]


def hull(points: DataFrame, key: str, part: int = 4096) -> DataFrame:
    """``(key, pts)``: hull of the points (key, x, y) of every key.

    The hull of a set is the hull of its parts' hulls, for any parts: the points of a key are dealt by hash into parts
    of about ``part`` points, whatever their places, and what the hulls leave is dealt again until every key is one part.
    A key whose hull itself has more corners than that ends when a round takes no more points away.
    """
    p = points.select(key, "x", "y").distinct()
    left = None
    while True:
        p = cut_lineage(p)
        sizes = p.groupBy(key).agg(F.count("*").alias("_n"))
        most, n = sizes.agg(F.max("_n"), F.sum("_n")).first()
        d = p.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("_n") / part)))
        if most is None or most <= part or n == left:
            return p.groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("p")).select(key, hull_of(F.col("p")).alias("pts"))
        left = n
        hulls = d.groupBy(key, "_part").agg(F.collect_list(F.struct("x", "y")).alias("p")).select(key, hull_of(F.col("p")).alias("p"))
        p = hulls.select(key, F.explode("p").alias("v")).select(key, "v.x", "v.y")


def rotated_rect_area(hull_pts: Column) -> Column:
    """Area of the smallest rectangle, at any angle, around the hull; row-local."""
    n = F.size(hull_pts)

    def at_edge(p, i):
        q = F.get(hull_pts, (i + 1) % n)
        ux, uy = q["x"] - p["x"], q["y"] - p["y"]
        along = F.transform(hull_pts, lambda v: (v["x"] - p["x"]) * ux + (v["y"] - p["y"]) * uy)
        across = F.transform(hull_pts, lambda v: (v["y"] - p["y"]) * ux - (v["x"] - p["x"]) * uy)
        return (F.array_max(along) - F.array_min(along)) * (F.array_max(across) - F.array_min(across)) / (ux * ux + uy * uy)

    return F.array_min(F.transform(hull_pts, at_edge))
