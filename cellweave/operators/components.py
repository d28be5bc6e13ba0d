"""Connected components as a DataFrame fixpoint with reliable checkpoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

FEW = 1 << 20  #: edges that one task solves: some 100 MB of it


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that edges u-v lead to; each round hooks roots to smaller ones and halves all paths."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _solved(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of few edges, in one task: no rounds, each of which is several jobs that the driver plans and keeps."""
    kind = edges.schema["u"].dataType

    def run(batches):
        some = [b for b in batches if len(b)]
        if not some:
            return
        t = pa.Table.from_batches(some)
        both = pa.concat_arrays([*t["u"].chunks, *t["v"].chunks])
        nodes = both.unique().sort()
        at = nodes.to_numpy(zero_copy_only=False)
        place = np.searchsorted(at, both.to_numpy(zero_copy_only=False))
        found = nodes.take(pa.array(least_reachable(place[: len(t)], place[len(t) :], len(nodes))))
        for a in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([nodes[a : a + (1 << 16)], found[a : a + (1 << 16)]], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``(node, component)`` for edges ``(u, v)``; the component is its smallest node.

    Alternating large-star and small-star steps: the number of rounds grows with the
    logarithm of the component size, and every step is a ``min`` aggregate plus a join, so
    a hub is reduced on the map side and its join is an ordinary skewed join. Isolated
    nodes do not appear. At most ``few`` edges between integers are solved in one task instead.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    if isinstance(e.schema["u"].dataType, T.IntegralType) and e.count() <= few:
        return cut_lineage(_solved(e))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        small = j.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("p"))
        e = cut_lineage(small.select(F.col("p.a").alias("u"), F.col("p.b").alias("v")).where("u <> v").distinct())
        # A star forest: every node has one target and no target points further.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
