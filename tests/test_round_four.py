"""Whole tables scored, places counted by tile, pairs measured by tile: each against a plain version."""

import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellweave.operators import components, points
from cellweave.operators import groups as R
from cellweave.operators import spatial as S
from cellweave.operators.components import connected_components


def test_two_columns_are_scored_for_every_document(spark, tmp_path):
    texts = {k: f"{'abc' if k % 2 else 'xyz'} {k % 12} " * 4 for k in range(36)} | {36: None, 37: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 36, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = entry.queries()["score_two_columns"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        for name, top, every in ((r.sender_scene_name, r.sender_scene_pro, r.sender_scene_pro_list), (r.recipient_scene_name, r.recipient_scene_pro, r.recipient_scene_pro_list)):
            assert name and len(every) == r.n_classes == 12 and max(every) == top and abs(sum(every) - 1) < 0.01


def test_few_edges_are_solved_like_many(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(-5, 2000), (2000, 2000), (None, 3), (-5, 3000)]
    d = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    want = {(r.node, r.component) for r in connected_components(d, few=0).collect()}
    got = connected_components(d).collect()
    assert {(r.node, r.component) for r in got} == want and len(got) == len(want) > 500
    assert not connected_components(d.where("u = v")).collect()


def test_few_edges_need_no_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "cut_lineage", lambda df, f=components.cut_lineage: rounds.append(1) or f(df))
    connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")).count()
    assert len(rounds) <= 2


def square(x, y, r, hole=False):
    ring = lambda d: "(" + ", ".join(f"{x + a * d} {y + b * d}" for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))) + ")"
    return f"POLYGON ({ring(r)}{', ' + ring(r / 2) if hole else ''})"


def plain_inside(x, y, edges):
    return sum((e.y1 > y) != (e.y2 > y) and x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1 for e in edges) % 2 == 1


def test_points_are_counted_as_one_by_one(spark):
    rng = random.Random(8)
    areas = [(k, square(116 + rng.random() * 0.02, 40 + rng.random() * 0.02, rng.choice([0.0002, 0.002, 0.006]), k % 3 == 0)) for k in range(25)]
    areas += [(3, square(116.01, 40.01, 0.004)), (90, "POLYGON ((116 40, 116.02 40.001, 116.001 40.018, 116 40))"), (91, square(120, 45, 0.01))]
    pts = [(116 + rng.random() * 0.02, 40 + rng.random() * 0.02) for _ in range(3000)] + [(116.01, 40.01)] * 700 + [(None, 40.0)]
    d, a = spark.createDataFrame(pts, "x double, y double"), S.shapes(spark.createDataFrame(areas, "id long, polygon string"), "id", "polygon")
    shapes = a.select("id", "edges", "xmin", "ymin", "xmax", "ymax").collect()
    want, pixels = {}, {}
    for s in shapes:
        for x, y in pts[:-1]:
            if plain_inside(x, y, s.edges):
                want[s.id] = want.get(s.id, 0) + 1
                at = [200 + (1 if v > m else -1) * math.ceil(abs(v - m) / per - 0.5) for v, m, per in ((y, (s.ymin + s.ymax) / 2, points.LAT_PER_METER), (x, (s.xmin + s.xmax) / 2, points.LNG_PER_METER))]
                if all(0 <= v < 400 for v in at):
                    pixels[(s.id, *at)] = pixels.get((s.id, *at), 0) + 1
    got = [(r.id, r.heat) for r in R.piece_heat(d, a).collect()]
    assert sorted(got) == sorted((s.id, want.get(s.id, 0)) for s in shapes) and max(want.values()) > 700
    assert {(r.id, r.row, r.col): r.heat for r in R.pixel_heat(d, a, 400, 400).collect()} == pixels


def test_points_meet_areas_in_blocks(spark):
    d = spark.range(20000).selectExpr("116 + id % 141 / 14100D AS x", "40 + id % 139 / 13900D AS y")
    a = S.shapes(spark.createDataFrame([(1, square(116.005, 40.005, 0.005))], "id long, polygon string"), "id", "polygon")
    met = points._meetings(d, a)
    assert met.count() < 1000 < met.selectExpr("sum(size(px)) AS n").first().n


def test_pairs_beyond_reach_are_left_out_where_they_are_measured(spark):
    rng = random.Random(11)
    areas = [(k, square(116 + rng.random() * 0.03, 40 + rng.random() * 0.03, rng.choice([0.0003, 0.001, 0.003]), k % 4 == 0)) for k in range(70)]
    a = S.shapes(spark.createDataFrame(areas, "id long, polygon string"), "id", "polygon")
    pairs = S.candidates(a, a, pad_m=600.0, extra=("area", "edges"), self_join="lt")
    every = {tuple(r) for r in S.pair_distance(pairs, a, a).where("dist_meter <= 600").collect()}
    assert {tuple(r) for r in S.pair_distance(pairs, a, a, within=600.0).collect()} == every and len(every) > 100
    assert S.measured_pairs(pairs, "distance", within=600.0).count() < S.measured_pairs(pairs, "distance").count()


def test_ways_from_points_to_outlines(spark):
    rng = random.Random(12)
    areas = [(k, square(116 + rng.random() * 0.03, 40 + rng.random() * 0.03, 0.002, k % 2 == 0)) for k in range(20)]
    a = S.shapes(spark.createDataFrame(areas, "id long, polygon string"), "id", "polygon").withColumn("c", S.G.xy(F.col("xmax"), F.col("ymin") - 0.0004))
    shapes = {r.id: r for r in a.collect()}

    def gap(c, edges):
        kx, ky = math.cos(math.radians(c.y)) * S.G.METRES_PER_DEGREE, S.G.METRES_PER_DEGREE
        out = []
        for e in edges:
            dx, dy, qx, qy = (e.x2 - e.x1) * kx, (e.y2 - e.y1) * ky, (c.x - e.x1) * kx, (c.y - e.y1) * ky
            u = min(1.0, max(0.0, (qx * dx + qy * dy) / (dx * dx + dy * dy)))
            out.append(math.hypot(qx - u * dx, qy - u * dy))
        return 0.0 if plain_inside(c.x, c.y, edges) else min(out)

    rows = S.pair_distance(S.candidates(a, a, pad_m=1000.0, extra=("area", "edges", "c"), self_join="lt"), a, a, 1000.0, "c").collect()
    assert len(rows) > 20 and {True, False} == {r.l_gap == 0 for r in rows}
    for r in rows:
        assert abs(r.l_gap - gap(r.l_c, shapes[r.r_id].edges)) < 1e-6 and abs(r.r_gap - gap(r.r_c, shapes[r.l_id].edges)) < 1e-6
