"""Contraction by the sequential rule, traced outlines and running sums against plain versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import geometry as G
from cellweave.learn import metrics
from cellweave.operators import outline as L
from cellweave.operators import overlay as O
from cellweave.operators import places
from cellweave.operators.ranges import running


def in_order(cells, max_size=None, share=None, later=False, boxed=False):
    """{piece: cells} after the sequential rule, for {piece: set of (ix, iy)}."""
    shape = {p: set(c) for p, c in cells.items()}
    first = {p: box(c) for p, c in cells.items()}
    order = sorted(cells, key=lambda p: (len(cells[p]), p))
    turn = {p: i for i, p in enumerate(order)}
    for p in order:
        mine = shape[p]
        if max_size is not None and len(mine) > max_size:
            continue
        sides = sum(n not in mine for c in mine for n in near(c))
        k = {q: sum(n in s for c in mine for n in near(c)) for q, s in shape.items() if q != p}
        a = box(mine)
        found = [q for q in k if k[q] and (not later or turn[q] > turn[p]) and (share is None or k[q] / sides > share)]
        if boxed:
            found = [q for q in found if first[q][0] <= a[1] + 1 and a[0] <= first[q][1] + 1 and first[q][2] <= a[3] + 1 and a[2] <= first[q][3] + 1]
        if found:
            q = min(found, key=lambda q: (-k[q], turn[q] if later else q))
            shape[q] |= shape.pop(p)
    return {p: frozenset(s) for p, s in shape.items()}


def near(c):
    return (c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)


def box(cells):
    return min(x for x, _ in cells), max(x for x, _ in cells), min(y for _, y in cells), max(y for _, y in cells)


def table(spark, cells, group=1):
    return spark.createDataFrame([(group, p, x, y) for p, s in cells.items() for x, y in s], "id long, piece long, ix long, iy long")


def after(df):
    got = collections.defaultdict(set)
    for r in df.collect():
        got[r.merged.piece].add((r.ix, r.iy))
    return {p: frozenset(s) for p, s in got.items()}


def test_a_chain_merges_one_after_the_other(spark):
    chain = {i: {(5 * i + x, y) for x in range(5) for y in range(6)} for i in range(10)}
    got = after(O.merge_small(table(spark, chain), ["id"], ["piece"], 35))
    assert sorted(map(len, got.values())) == [30, 90, 90, 90] and got == in_order(chain, 35, boxed=True)


def test_rounds_equal_the_sequence(spark):
    rng = np.random.default_rng(1)
    size, cells = 11, collections.defaultdict(set)
    seeds = rng.integers(0, size, (13, 2))
    for x in range(size):
        for y in range(size):
            if rng.random() > 0.05:
                cells[int(np.argmin(np.abs(seeds - [x, y]).sum(1)))].add((x, y))
    df = table(spark, cells).unionByName(table(spark, {0: {(0, 0)}, 1: {(1, 0)}}, 2)).coalesce(2)
    both = O.merge_small(df, ["id"], ["piece"], 12).collect()
    got = collections.defaultdict(set)
    for r in both:
        got[r.id, r.merged.piece].add((r.ix, r.iy))
    assert {p: frozenset(s) for (g, p), s in got.items() if g == 1} == in_order(cells, 12, boxed=True) and len([g for g, _ in got if g == 2]) == 1
    by = collections.defaultdict(dict)
    for p, s in cells.items():
        by[p % 3][p] = s
    got = after(O.merge_by_parent(df.where("id = 1"), ["id"], ["piece"], [F.col("pid.piece") % 3], 0.3))
    want = {}
    for s in by.values():
        want |= in_order(s, share=0.3, later=True)
    assert got == want
    assert O.merge_small(df.limit(0), ["id"], ["piece"], 12).count() == 0


@pytest.mark.parametrize("share", [0.45, 0.8])
def test_outlines_cover_their_cells(spark, share):
    rng = np.random.default_rng(int(10 * share))
    size = 10
    cells = [(k, x, y) for k in (1, 2) for x in range(size) for y in range(size) if rng.random() < share]
    df = spark.createDataFrame(cells, "id long, ix long, iy long")
    parts = O.run_cells(O.parts(df, ["id"]))
    text = L.as_polygons(parts, ["id"], "part", 1.0)
    rings = {r.id: r.rings for r in text.select("id", G.parse_polygon(F.col("polygon")).alias("rings")).collect()}
    n_parts = {r.id: r.n for r in parts.groupBy("id").agg(F.max("part").alias("n")).collect()}
    for k in (1, 2):
        have = {(x, y) for i, x, y in cells if i == k}
        edges = [(a, b) for r in rings[k] for a, b in zip(r.pts, r.pts[1:] + r.pts[:1])]
        assert all((a.x == b.x) != (a.y == b.y) for a, b in edges)
        inside = {(x, y) for x in range(-1, size + 1) for y in range(-1, size + 1) if sum(a.x == b.x and a.x > x + 0.5 and min(a.y, b.y) < y + 0.5 < max(a.y, b.y) for a, b in edges) % 2}
        assert inside == have and max(r.part for r in rings[k]) == n_parts[k]
        shoelace = lambda p: sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:] + p[:1])) / 2
        assert all((shoelace(r.pts) > 0) == (r.ring == 0) for r in rings[k])
        assert sum(shoelace(r.pts) for r in rings[k]) == len(have)


def test_outline_of_one_long_ring(spark):
    comb = [(1, x, y) for x in range(60) for y in range(4) if y == 0 or x % 2 == 0]
    r = L.outlines(spark.createDataFrame(comb, "id long, ix long, iy long").withColumn("part", F.lit(1)), ["id"], "part", 1.0).first().rings
    # Four corners a tooth, but the first has no left foot, and three of the base.
    assert len(r) == 1 and len(r[0].pts) == 4 * 30 - 1 + 3


def test_running_sums_keep_null_keys(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(50)] + [("a", i, 2) for i in range(50)], "k string, o long, v long")
    got = sorted((r.k or "", r.o, r.s) for r in running(df, ["k"], ["o"], {"s": "v"}).collect())
    assert got == sorted([("", i, i + 1) for i in range(50)] + [("a", i, 2 * i + 2) for i in range(50)])
    assert sorted(r.s for r in running(df, [], ["k", "o"], {"s": "v"}).collect())[-1] == 150


def test_null_keys_of_auc_and_nested_rows(spark):
    rows = [(g, s, int(s > 0.5)) for g in ("a", None) for s in (0.1, 0.4, 0.6, 0.9)]
    got = metrics.auc(spark.createDataFrame(rows, "g string, p double, label int"), "g").collect()
    assert len(got) == 2 and {r.g for r in got} == {"a", None} and all(r.auc == 1 for r in got)
    nested = places.nest_by(spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v long"), "k", ["v"], 1)
    assert sorted((r.k or "", r.chunk, [x.v for x in r["items"]]) for r in nested.collect()) == [("", 0, [1]), ("", 1, [2]), ("a", 0, [3])]
