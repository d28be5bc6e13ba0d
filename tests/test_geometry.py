"""Hand-made shapes and brute-force checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import cells as C
from cellweave.functions import geometry as G
from cellweave.functions import rings as P
from cellweave.functions import text as T
from cellweave.operators import hulls
from cellweave.operators import overlay as O
from cellweave.operators import snapshots as N
from cellweave.operators import spatial as S
from cellweave.session import each


def shapes(spark, rows):
    return S.shapes(spark.createDataFrame(rows, "id long, w string"), "id", "w")


def square(x, y, side, hole=None):
    def ring(a, b, s):
        return f"({a} {b}, {a + s} {b}, {a + s} {b + s}, {a} {b + s}, {a} {b})"

    return f"POLYGON ({ring(x, y, side)}{', ' + ring(*hole) if hole else ''})"


def one(df):
    return df.first()


def test_intersection_of_squares(spark):
    a, b = shapes(spark, [(1, square(0, 0, 2))]), shapes(spark, [(2, square(1, 1, 2))])
    r = one(S.intersecting(a, b))
    assert r.inter == pytest.approx(1.0)
    assert r.inter / (r.l_area + r.r_area - r.inter) == pytest.approx(1 / 7)


def test_hole_with_itself_and_touching(spark):
    a = shapes(spark, [(1, square(0, 0, 4, (1, 1, 2))), (2, square(4, 0, 4)), (3, square(20, 0, 1)), (4, square(1.5, 1.5, 0.5))])
    r = {(x.l_id, x.r_id): x.inter for x in S.intersecting(a, a).collect()}
    assert r[(1, 1)] == pytest.approx(12.0)
    assert r[(1, 2)] == 0.0  # a common side counts as meeting
    assert (1, 3) not in r
    assert (1, 4) not in r  # inside the hole
    d = {(x.l_id, x.r_id): x for x in S.pair_distance(S.candidates(a, a, pad_m=5e6, extra=("area",), self_join="lt"), a, a).collect()}
    assert d[(1, 2)].dist_degree == 0.0
    assert d[(2, 3)].dist_degree == pytest.approx(12.0)
    assert d[(1, 4)].dist_degree == pytest.approx(0.5)


def test_pairs_are_never_shuffled(spark, capsys):
    a = shapes(spark, [(i, square(i, 0, 1.5)) for i in range(5)])
    S.intersecting(a, a, "lt").explain()
    S.pair_distance(S.candidates(a, a, pad_m=1e5, extra=("area", "edges"), self_join="lt"), a, a).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(role" in plan and "hashpartitioning(l_id" not in plan and "hashpartitioning(r_id" not in plan


def test_semi_and_anti_join_settle_dense_places_first(spark):
    left = shapes(spark, [(1, square(0, 0, 1)), (2, square(0.2, 0.2, 1, (0.3, 0.3, 0.6))), (3, square(0.55, 0.55, 0.1)), (4, square(9, 9, 1))])
    right = shapes(spark, [(i, square(0.6 + i / 1000, 0.6, 0.01)) for i in range(20)] + [(50, square(0.2, 0.2, 0.01)), (51, square(30, 30, 1))])
    assert sorted(r.id for r in S.spatial_semi(left, right).collect()) == [1, 2, 3]
    assert [r.id for r in S.spatial_anti(left, right).collect()] == [4]


def test_touching_region_wins_over_none(spark):
    a = shapes(spark, [(1, square(0, 0, 1)), (2, square(50, 50, 1))])
    g = shapes(spark, [(7, square(1, 0, 1))])
    r = {x.id: x.r_id for x in S.assign_max_overlap(a, g, []).collect()}
    assert r == {1: 7, 2: None}


def star(rng, cx, cy):
    n = rng.randint(5, 11)
    pts = []
    for i in range(n):
        t = 2 * math.pi * i / n
        r = rng.uniform(0.2, 1.0)
        pts.append((cx + r * math.cos(t), cy + r * math.sin(t)))
    return pts


def inside(pts, x, y):
    c = False
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            c = not c
    return c


def test_intersection_against_raster(spark):
    rng = random.Random(3)
    left = {i: star(rng, 0, 0) for i in range(6)}
    right = {i: star(rng, rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for i in range(6)}

    def wkt(p):
        return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in p + p[:1]) + "))"

    a, b = shapes(spark, [(i, wkt(p)) for i, p in left.items()]), shapes(spark, [(i, wkt(p)) for i, p in right.items()])
    got = {(r.l_id, r.r_id): r.inter for r in S.intersecting(a, b).collect()}
    step = 0.02
    grid = [(-1 + step * (i + 0.5), -1 + step * (j + 0.5)) for i in range(100) for j in range(100)]
    for i, p in left.items():
        pin = [g for g in grid if inside(p, *g)]
        for j, q in right.items():
            want = sum(inside(q, *g) for g in pin) * step * step
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=0.03)


def test_sizes_from_metres_to_the_globe_meet(spark):
    """Boxes of very different size meet in exactly one cell of the ladder."""
    rng = random.Random(5)
    rows = [(i, square(rng.uniform(-60, 60), rng.uniform(-60, 60), 10 ** rng.uniform(-4, 1.9))) for i in range(150)]
    s = shapes(spark, rows)
    got = [(r.l_id, r.r_id) for r in S.candidates(s, s).collect()]
    box = {r.id: r for r in s.collect()}
    want = {(i, j) for i, a in box.items() for j, b in box.items()
            if a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax}
    assert len(got) == len(set(got)) and set(got) == want


def test_globe_area(spark):
    s = shapes(spark, [(1, "POLYGON ((-180 -90, 180 -90, 180 90, -180 90, -180 -90))")])
    assert one(s.select(G.geodesic_area(F.col("edges")).alias("a"))).a == pytest.approx(5.1006562e14, rel=1e-7)


def test_bad_text_is_left_out(spark):
    rows = [(1, "POLYGON((-118.36 33.82,-118.37 33.82,-118.37 33.83,-118.36 33.82))"), (2, "POLYGON ((0 0, 1 1))"), (3, "nothing"), (4, None),
            (5, "POLYGON ((0 0, 1 x, 1 1, 0 0))"), (6, "MULTIPOLYGON (((0 0,1 0,1 1,0 0)), ((5 5,6 5,6 6,5 5),(5.5 5.2,5.6 5.2,5.6 5.3,5.5 5.2)))")]
    s = {r.id: r for r in shapes(spark, rows).collect()}
    assert sorted(s) == [1, 6]
    assert s[6].area == pytest.approx(0.5 + 0.5 - 0.005)


def test_geohash_and_tiles(spark):
    d = spark.createDataFrame([("wtw1vmy7",)], "c string").select(C.geohash_bbox(F.col("c")).alias("b"))
    d = d.select("b", C.geohash((F.col("b.s") + F.col("b.n")) / 2, (F.col("b.w") + F.col("b.e")) / 2, 8).alias("again"))
    assert one(d).again == "wtw1vmy7"
    n = spark.createDataFrame([("00000000",), ("zzzzzzzz",), ("wtw1vmy7",)], "c string").select("c", F.size(C.geohash_neighbors(F.col("c"), 8)).alias("n"))
    assert {r.c: r.n for r in n.collect()} == {"00000000": 5, "zzzzzzzz": 5, "wtw1vmy7": 8}
    t = spark.createDataFrame([(184594, 99826), (184594, 99827), (184595, 99826)], "x long, y long").select("x", "y", C.tile_center(F.col("x"), F.col("y"), 18).alias("c"))
    t = t.select("x", "y", C.tile(F.col("c.x") + 1e-7, F.col("c.y") - 1e-7, 18).alias("t"), C.tile_unpack(C.tile_pack(F.col("x"), F.col("y"), 18)).alias("u"))
    for r in t.collect():
        assert (r.t.x, r.t.y) == (r.x, r.y) == (r.u.x, r.u.y) and r.u.zoom == 18


@pytest.mark.parametrize("given, want", [
    ("八一", "81"), ("十三", "13"), ("一百二十三", "123"), ("三千零五号", "3005号"), ("第二十五弄三号", "第25弄3号"), ("两万五千", "25000"),
    ("一亿", "100000000"), ("百货", "百货"), ("零点", "零点"), ("", ""), ("中山路八一大厦十二层", "中山路81大厦12层"),
])
def test_numerals(spark, given, want):
    assert one(spark.createDataFrame([(given,)], "t string").select(T.cn_digits(F.col("t")).alias("r"))).r == want


def test_words_and_widths(spark):
    d = spark.createDataFrame([("Ａ１　b，c dd-Ｚ单 a街道",)], "t string")
    assert one(d.select(T.keep_words(F.col("t")).alias("r"))).r == "dda街道"
    assert one(d.select(T.half_width(F.col("t")).alias("r"))).r == "A1b,cdd-Z单a街道"


@pytest.mark.parametrize("line, want", [
    ([1, 2, 3, 4, 1, 2, 5], [1, 2, 3, 4, 1]), ([1, 2, 3, 4, 1, 2], [1, 2, 3, 4, 1]), ([9, 1, 2, 3, 1], [1, 2, 3, 1]), ([1, 2, 3, 4, 5, 6, 7, 8, 6, 5, 1, 2], [1, 2, 3, 4, 5, 6, 7, 8, 1]),
    ([1, 2, 3, 1], [1, 2, 3]),
])
def test_repeated_points(spark, line, want):
    d = spark.createDataFrame([(";".join(f"{v},{v}" for v in line),)], "t string")
    got = one(d.select(P.dedup_ring(G.parse_points(F.col("t"))).alias("p"))).p
    assert [int(p.x) for p in got] == want


def test_thinning_keeps_the_shape(spark):
    pts = [(math.cos(t / 1000 * 2 * math.pi), math.sin(t / 1000 * 2 * math.pi)) for t in range(1000)]
    line = ";".join(f"{x!r},{y!r}" for x, y in pts)
    d = spark.createDataFrame([(line,)], "t string").select(G.parse_points(F.col("t")).alias("p"))
    d = each(d, [], F.array(P.densify(F.col("p"), 300.0)), "p")
    d = each(d, ["p"], F.array(P.thin_outline(F.col("p"), 500)), "q")
    r = one(d.select(F.size("p").alias("a"), F.size("q").alias("b"), G.signed_area(F.col("p")).alias("x"), G.signed_area(F.col("q")).alias("y")))
    assert r.b < r.a and r.y == pytest.approx(r.x, rel=1e-4)


def test_hull_against_all_lines(spark):
    rng = random.Random(11)
    pts = [(k, rng.uniform(0, 1), rng.uniform(0, 1)) for k in (1, 2) for _ in range(300)]
    h = {r.k: [(p.x, p.y) for p in r.pts] for r in hulls.hull(spark.createDataFrame(pts, "k long, x double, y double"), "k", part=40).collect()}
    for k in (1, 2):
        for (x1, y1), (x2, y2) in zip(h[k], h[k][1:] + h[k][:1]):
            assert all((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= -1e-12 for kk, x, y in pts if kk == k)


def test_hull_with_a_far_outlier_and_on_a_circle(spark):
    rng = random.Random(12)
    far = [(1, rng.random(), rng.random()) for _ in range(2000)] + [(1, 1e9, 0.5)]
    ring = [(2, math.cos(i), math.sin(i)) for i in range(200)]
    h = {r.k: [(p.x, p.y) for p in r.pts] for r in hulls.hull(spark.createDataFrame(far + ring, "k long, x double, y double"), "k", part=50).collect()}
    assert len(h[2]) == 200 and (1e9, 0.5) in h[1] and len(h[1]) < 100


def test_identical_pieces_keep_the_smaller_id(spark):
    rows = [(i, square(0, 0, 1)) for i in range(40)] + [(100, square(0.1, 0.1, 0.2)), (101, square(5, 5, 1)), (102, square(5, 5, 1.01))]
    left = [r.id for r in N.drop_covered(shapes(spark, rows)).select("id").collect()]
    assert sorted(left) == [0, 101]


def test_parts_of_a_comb(spark):
    """Two combs, one per key, with teeth joined only at the base."""
    cells = [(k, x, y) for k in (1, 2) for x in range(0, 21, 2) for y in range(1, 9)] + [(1, x, 0) for x in range(21)]
    d = spark.createDataFrame(cells, "id long, ix long, iy long")
    n = {r.id: r.n for r in O.parts(d, ["id"]).groupBy("id").agg(F.countDistinct("part").alias("n")).collect()}
    assert n == {1: 1, 2: 11}


def test_gcj_out_and_back(spark):
    d = spark.createDataFrame([(116.4, 39.9), (121.5, 31.2), (2.35, 48.85)], "lng double, lat double").withColumn("g", G.to_gcj(F.col("lng"), F.col("lat")))
    d = d.withColumn("b", G.from_gcj(F.col("g.x"), F.col("g.y")))
    for r in d.collect():
        assert r.b.x == pytest.approx(r.lng, abs=1e-8) and r.b.y == pytest.approx(r.lat, abs=1e-8)
        assert (r.g.x != r.lng) == (r.lng > 72)
