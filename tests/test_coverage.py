"""Coverages as words and runs, parts and rings by groups, thinning in batches: each against a plain version."""

import random

from pyspark.sql import functions as F

from cellweave.functions import rings as P
from cellweave.operators import outline as L
from cellweave.operators import overlay as O
from cellweave.operators import runs as W
from cellweave.operators import spatial as S
from cellweave.operators.contract import contract
from cellweave.session import spread, stage


def plain_thin(pts, most, passes):
    for _ in range(passes):
        if len(pts) < most:
            return pts
        flat = lambda i: abs((pts[i + 1][0] - pts[i - 1][0]) * (pts[i][1] - pts[i - 1][1]) - (pts[i + 1][1] - pts[i - 1][1]) * (pts[i][0] - pts[i - 1][0])) <= 0
        pts = [p for i, p in enumerate(pts) if i % 2 == 0 or i == len(pts) - 1 or not flat(i)]
    return pts


def test_thinning_of_a_batch(spark):
    rng = random.Random(5)
    rows = [(0, None), (1, []), (2, [(1.0, 1.0)] * 50)]
    rows += [(k, [(float(i), rng.choice([0.0, 0.0, 0.0, 1.0])) for i in range(rng.randrange(60))]) for k in range(3, 40)]
    d = spark.createDataFrame(rows, "id long, p array<struct<x: double, y: double>>").coalesce(1)
    got = {r.id: r.q and [tuple(p) for p in r.q] for r in d.select("id", P.thin_outline(F.col("p"), 9).alias("q")).collect()}
    assert got == {k: p and plain_thin(p, 9, 12) for k, p in rows}
    plan = d.select(P.thin_outline(F.col("p"), 9).alias("q"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_rows_of_one_split_are_dealt_to_all_cores(spark):
    n = spark.conf.get("spark.cellweave.partitions")
    spark.conf.unset("spark.cellweave.partitions")
    try:
        d = spread(spark.range(1000).coalesce(1))
        assert d.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.cellweave.partitions", n)


def cells_of(rng, width, height, share, x=0, y=0):
    return {(x + i, y + j) for i in range(width) for j in range(height) if rng.random() < share}


def as_runs(cells):
    """Runs of single rows, cut where a word of 64 cells ends."""
    out = []
    for x, y in sorted(cells, key=lambda c: (c[1], c[0])):
        if out and out[-1][0] == y and out[-1][2] == x - 1 and x % 64:
            out[-1][2] = x
        else:
            out.append([y, x, x])
    return out


def shapes_of_cells():
    rng = random.Random(8)
    got = {k: cells_of(rng, rng.randrange(1, 90), rng.randrange(1, 12), rng.choice([0.5, 0.7, 0.95]), rng.randrange(-70, 70), rng.randrange(-5, 5)) for k in range(40)}
    got[40] = {(x, y) for x in range(60, 70) for y in range(4)} - {(63, 1), (64, 2)}
    return {k: c for k, c in got.items() if c}


def test_parts_and_rings_are_the_same_in_batches_and_in_rounds(spark):
    shapes = shapes_of_cells()
    rows = [(k, *r) for k, c in shapes.items() for r in as_runs(c)]
    d = stage(spark.createDataFrame(rows, "id long, iy long, x0 long, x1 long"), "test-runs")
    own = lambda p: {(r.id, r.part, r.iy, x) for r in p.collect() for x in range(r.x0, r.x1 + 1)}
    batches, rounds = O.parts_of_runs(d, ["id"]), O.parts_of_runs(d, ["id"], room=3)
    assert "MapInArrow" in batches._jdf.queryExecution().executedPlan().toString()
    assert own(batches) == own(rounds)
    assert {(k, x, y) for k, c in shapes.items() for x, y in c} == {(k, x, y) for k, _, y, x in own(batches)}
    runs = stage(batches, "test-parts")
    keys = ["id", "part"]
    ring = lambda room: {(r.id, r.part, r.ring.y, r.ring.x, r.ring.d, r.step, r.sx, r.sy, r.ex, r.ey) for r in L.rings_of_runs(runs, keys, room).collect()}
    assert ring(1 << 14) == ring(2)


def test_opening_of_words(spark):
    shapes = shapes_of_cells()
    rows = [(k, *r) for k, c in shapes.items() for r in as_runs(c)]
    runs = spark.createDataFrame(rows, "id long, iy long, x0 long, x1 long")
    words = O.union_words(W.run_words(runs), "id")
    back = {(r.id, x, r.iy) for r in W.word_runs(words).collect() for x in range(r.x0, r.x1 + 1)}
    assert back == {(k, x, y) for k, c in shapes.items() for x, y in c}
    got = {(r.id, x, r.iy) for r in W.word_runs(O.open_words(words, ["id"])).collect() for x in range(r.x0, r.x1 + 1)}
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    core = {k: {(x, y) for x, y in c if all((x + i, y + j) in c for i, j in near)} for k, c in shapes.items()}
    assert got == {(k, x + i, y + j) for k, c in core.items() for x, y in c for i, j in near}
    # Cells met twice are opened away, as they are cell by cell.
    assert O.open_words(words.unionByName(words), ["id"]).isEmpty()


def test_coverage_of_a_shape_as_words(spark):
    text = ["POLYGON ((0 0, 130 0, 130 9, 0 9), (3 2, 3 5, 90 5, 90 2))", "POLYGON ((-70 -3, -1 -3, -60 8))"]
    s = S.shapes(spark.createDataFrame(list(enumerate(text)), "id long, polygon string"), "id", "polygon")
    flat = lambda d: sorted((r.id, x, r.iy) for r in d.collect() for x in range(r.x0, r.x1 + 1))
    assert flat(W.word_runs(O.polyfill_words(s, 1.0))) == flat(O.polyfill_runs(s, 1.0)) != []


def test_runs_that_touch_are_counted_as_their_cells_are(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(3), y, x, x + rng.randrange(9)) for k in (1, 2) for y in range(60, 70) for x in (rng.randrange(-20, 20) for _ in range(4))]  # some overlap
    d = spark.createDataFrame(rows, "id long, piece long, iy long, x0 long, x1 long")
    cells = [(k, p, x, y) for k, p, y, a, b in rows for x in range(a, b + 1)]
    want = {}
    for k, p, x, y in cells:
        for k2, q, x2, y2 in cells:
            if k == k2 and (x2, y2) in ((x + 1, y), (x, y + 1)):
                want[k, p, q] = want.get((k, p, q), 0) + 1
    assert {(r.id, r.a_piece, r.b_piece): r.k for r in O.touching(d, ["id"], ["piece"]).collect()} == want
    assert {(r.id, r.a_piece, r.b_piece): r.k for r in O.touching(O.run_cells(d), ["id"], ["piece"]).collect()} == want
    n = {k: sum(c[0] == k for c in cells) for k in (1, 2)}
    sides = {k: 4 * n[k] - 2 * sum(v for p, v in want.items() if p[0] == k) for k in n}
    assert {r.id: (r.n, round(r.perimeter)) for r in O.measure(d, ["id"], 1.0).collect()} == {k: (n[k], sides[k]) for k in n}


def test_runs_are_cut_and_merged_as_their_cells_are(spark):
    shapes = shapes_of_cells()
    d = spark.createDataFrame([(k, x, y) for k, c in shapes.items() for x, y in c], "id long, ix long, iy long")
    runs = stage(O.parts(d, ["id"]), "test-parts")
    pieces = stage(O.cut_by_parent(runs, ["id", "part"], 3, 30), "test-pieces")
    cells = stage(O.cut_by_parent(O.run_cells(runs), ["id", "part"], 3, 30), "test-cells")
    flat = lambda t: sorted(tuple(str(r[c]) for c in sorted(t.columns) if c not in ("x0", "x1", "ix")) + (x,) for r in t.collect() for x in ([r.ix] if "ix" in t.columns else range(r.x0, r.x1 + 1)))
    assert "x0" in pieces.columns and flat(pieces) == flat(cells)
    of = (["id", "part"], ["px", "py", "piece"], 35)
    assert flat(O.merge_small(pieces, *of)) == flat(O.merge_small(cells, *of))


def test_pieces_of_small_keys_are_merged_without_rounds(spark):
    nodes = [(g, (p,), 3 + (p * 5 + g) % 4, 12, 3 * p, 3 * p + 2, 0, 1) for g in (1, 2) for p in range(5)]
    edges = [(g, (p + i,), (p + 1 - i,), 1 + (p + g) % 3) for g in (1, 2) for p in range(4) for i in (0, 1)]
    nodes = spark.createDataFrame(nodes, "id long, pid struct<piece: long>, n long, sides long, x0 long, x1 long, y0 long, y1 long")
    edges = spark.createDataFrame(edges, "id long, a struct<piece: long>, b struct<piece: long>, k long")
    small, rounds = (contract(nodes, edges, ["id"], max_size=6, boxed=True, room=room) for room in (1 << 14, 0))
    assert "MapInArrow" in small._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r.id, r.pid.piece): r.owner.piece for r in t.collect()} for t in (small, rounds))
    assert got == want and any(p != o for (_, p), o in got.items())
