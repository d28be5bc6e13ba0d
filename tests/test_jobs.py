"""Selection, components, settlement, files and learning on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions.text import cn_digits
from cellweave.learn import metrics as M
from cellweave.operators import fuzzy, ledger, places
from cellweave.operators import groups as R
from cellweave.operators import selection as E
from cellweave.operators import snapshots as N
from cellweave.operators.components import connected_components
from cellweave.session import fresh_path
from cellweave.sources import files as I
from cellweave.sources import outlines as L


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(300 + rng.randrange(150), 300 + rng.randrange(150)) for _ in range(120)] + [(1000, 1000 + i) for i in range(1, 400)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for e in edges if e[0] != e[1] for a in e}


@pytest.fixture(scope="module")
def flows(spark):
    rng = random.Random(4)
    rows = []
    for city in (1, 2, 3):
        n = 3000 if city == 1 else 200
        for i in range(n):
            rows.append((city, i, rng.randrange(50), rng.uniform(0, 5), float(rng.randrange(1, 50)), rng.randrange(1, 5), int(rng.random() < 0.4), int(rng.random() < 0.5)))
    # A city whose base rows gain nothing, and one that cannot reach the band.
    rows += [(4, i, 0, 1.0, 0.0, 2, 1, 0) for i in range(10)] + [(5, i, 0, 1.0, 5.0, 4, 0, 0) for i in range(10)] + [(5, 10, 0, 1.0, 500.0, 1, 1, 0)]
    d = spark.createDataFrame(rows, "city_id long, poi_id long, aoi_id long, cost double, gain double, navi_cls long, base_set long, candidate_set long")
    return d.withColumn("base_gain", F.col("gain"))


@pytest.mark.parametrize("variant", ["circle", "distance"])
def test_selection_holds_all_limits(spark, flows, variant):
    s = E.select_flows(flows, "city_id", variant).persist()
    assert s.count() == flows.count()
    a = {r.city_id: r for r in E.audit_selection(s, "city_id", variant).collect()}
    by_city = {r.city_id: r for r in s.groupBy("city_id").agg(F.min("is_selected").alias("lo"), F.max("is_selected").alias("hi")).collect()}
    for city, r in by_city.items():
        if r.lo == -1:
            assert r.hi == -1
        else:
            assert a[city].feasible
    assert by_city[1].lo == 0
    assert by_city[4].hi == -1
    assert by_city[5].hi == -1
    ok = s.where("is_selected >= 0")
    assert ok.where("flow_class = 1 AND is_selected = 0").count() == 0
    assert ok.where("flow_class = -1 AND is_selected = 1").count() == 0


def test_selection_is_near_the_bound(spark, flows):
    """Within a few percent of a Lagrangian lower bound for the large city."""
    rows = E.classify_flows(flows.where("city_id = 1"), "circle").collect()
    base = [r for r in rows if r.base_set == 1]
    need = 1.005 * sum(r.gain for r in base)
    lo, hi = round(0.95 * len(base)), round(1.10 * len(base))
    fixed = [r for r in rows if r.flow_class == 1]
    free = [r for r in rows if r.flow_class == 0]
    g0, n0, c0 = sum(r.gain for r in fixed), len(fixed), sum(r.cost for r in fixed)
    best = 0.0
    for i in range(60):
        lam = i * 0.005
        for mu in [j * 0.1 - 3 for j in range(60)]:
            v = sum(min(0.0, r.cost - lam * r.gain - mu) for r in free) + lam * (need - g0) + mu * ((lo - n0) if mu > 0 else (hi - n0))
            best = max(best, v)
    s = E.select_flows(flows.where("city_id = 1"), "city_id", "circle")
    cost = s.where("is_selected = 1").agg(F.sum("cost")).first()[0]
    assert c0 + best <= cost * (1 + 1e-9)
    assert cost <= (c0 + best) * 1.10


def _flow_rows(spark, rows):
    """(city, cost, gain, cost0, gain0, base) rows whose class is free."""
    data = [(c, i, float(a), float(g), float(a0), float(g0), float(g), 2, b, 1) for i, (c, a, g, a0, g0, b) in enumerate(rows)]
    return spark.createDataFrame(data, "city_id long, aoi_id long, cost double, gain double, cost0 double, gain0 double, base_gain double, navi_cls int, base_set int, candidate_set int")


def test_selection_of_equal_rows_and_with_an_outlier(spark):
    """Limits that need half of equal rows, and one enormous row beside ordinary ones."""
    equal = [(1, 1, 2, 0, 0, int(i < 100)) for i in range(200)]
    rng = random.Random(5)
    far = [(2, rng.random(), rng.random(), 0, 0, i % 2) for i in range(400)] + [(2, 1e6, 1e6, 0, 0, 0)]
    d = _flow_rows(spark, equal + far)
    a = {r.city_id: r for r in E.audit_selection(E.select_flows(d, "city_id").persist(), "city_id", "circle").collect()}
    assert a[1].feasible and a[2].feasible
    assert a[1].n == 101 and a[2].cost < 1e6


def test_selection_with_arms_against_all_subsets(spark):
    rng = random.Random(6)
    rows = [(c, rng.randint(1, 20), rng.randint(0, 20), rng.randint(0, 5), rng.randint(0, 3), int(rng.random() < 0.5)) for c in range(8) for _ in range(10)]
    d = _flow_rows(spark, rows)
    s = E.select_flows(d, "city_id", arm0=("cost0", "gain0")).persist()
    kept = {r.city_id: r for r in E.audit_selection(s, "city_id", "circle", arm0=("cost0", "gain0")).collect()}
    lims = {r.city_id: r for r in E.limits(d, "city_id", "circle").collect()}
    bounds = {r.city_id: r for r in s.select("city_id", "is_selected", "bound", "gap").collect()}
    for c in range(8):
        mine, lim, least = [r for r in rows if r[0] == c], lims[c], None
        for mask in range(1 << len(mine)):
            on = [mask >> i & 1 for i in range(len(mine))]
            cost = sum(r[1] if o else r[3] for r, o in zip(mine, on))
            gain = sum(r[2] if o else r[4] for r, o in zip(mine, on))
            if gain >= lim.min_gain and lim.min_n <= sum(on) <= lim.max_n and (least is None or cost < least):
                least = cost
        if bounds[c].is_selected == -1:
            # The relaxation with gain alone is infeasible too.
            top = sorted((r[2] - r[4] for r in mine), reverse=True)
            most = max((sum(top[:k]) for k in range(max(0, lim.min_n), min(len(top), lim.max_n) + 1)), default=None)
            assert least is None and (lim.base_gain == 0 or most is None or most + sum(r[4] for r in mine) < lim.min_gain * (1 + 1e-9))
        else:
            assert kept[c].feasible and bounds[c].bound <= least + 1e-6
            assert least <= kept[c].cost + 1e-9 and abs(kept[c].cost - bounds[c].bound - bounds[c].gap) < 1e-6


def test_settlement_example(spark):
    d = spark.createDataFrame([("a", 3000.0, 2000.0, 500.0, 1500.0), ("b", 1000.0, 2000.0, 500.0, 1400.0)], "month string, x double, y double, y1 double, y2 double")
    a, b = ledger.settle(d).orderBy("month").collect()
    assert round(a.a_cost, 2) == 666.67 and round(a.net, 2) == -833.33 and a.status == "receive" and a.valid
    assert not b.valid


def test_kth_and_argmax(spark):
    d = spark.createDataFrame([("a", v) for v in (5, 5, 4, 3, 3)] + [("b", 1)], "k string, v int")
    assert {r.k: r.v for r in R.kth_largest(d, "k", "v", 2).collect()} == {"a": 5}
    assert {r.k: r.v for r in R.kth_largest(d, "k", "v", 3).collect()} == {"a": 4}
    assert {r.k: r.v for r in R.argmax(d, "k", [F.col("v")], ["k", "v"]).collect()} == {"a": 5, "b": 1}


def test_fuzzy_against_all_pairs(spark):
    rng = random.Random(8)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(120)}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    d = spark.createDataFrame([("k", n) for n in names for _ in range(2)], "k string, n string")
    got = {(r.a, r.b) for r in fuzzy.fuzzy_pairs(d, "k", "n").collect()}
    assert got == {(a, b) for a in names for b in names if a < b and lev(a, b) == 1}
    two = {(r.a, r.b): r.distance for r in fuzzy.fuzzy_pairs(d, "k", "n", 2).collect()}
    assert two == {(a, b): lev(a, b) for a in names for b in names if a < b and lev(a, b) <= 2}


def test_change_log_partitions_the_keys(spark):
    old = spark.createDataFrame([(i, 1, f"p{i}") for i in range(10)], "id long, code long, polygon string")
    new = spark.createDataFrame([(i, 1, f"p{i}" if i % 2 else None) for i in range(5, 15)], "id long, code long, polygon string")
    log = {r.id: (r.change_type, r.polygon) for r in N.change_log(old, new, "id", "polygon").collect()}
    assert log[0] == (2, "p0") and log[12][0] == 1 and log[6] == (3, "p6") and 7 not in log


def test_nested_chunks_bound_a_hot_key(spark):
    d = spark.range(5000).select(F.when(F.col("id") < 4500, 1).otherwise(2).cast("long").alias("period"), "id")
    n = places.nest_by(d, "period", ["id"], per_row=500).collect()
    assert sum(len(r["items"]) for r in n) == 5000
    assert max(len(r["items"]) for r in n) < 700


def test_geojson_document(spark):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"adcode": "1", "NAME": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[283.7, 5], [284, 5], [284, 6], [283.7, 5]]]]}},
        {"type": "Feature", "properties": {"adcode": "2", "name": "y"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}},
        {"type": "Feature", "properties": {"adcode": "3", "name": "z"}, "geometry": {"type": "Point", "coordinates": [7, 8]}}]}
    path = fresh_path(spark, "doc")
    spark.createDataFrame([(json.dumps(doc, indent=1),)], "value string").write.text(path)
    f = I.read_geojson(spark, path, drop_codes=("3",))
    assert {(r.code, r.name) for r in f.collect()} == {("1", "x"), ("2", "y")}
    r = L.ingest_geojson(f, "code", "geometry").orderBy("id", "ring").collect()
    assert [(x.id, x.type, x.kind, len(x.pts)) for x in r] == [("1", "MultiPolygon", "poly", 4), ("1", "MultiPolygon", "poly", 4), ("2", "LineString", "line", 2)]
    assert r[1].pts[0].x == pytest.approx(-76.3)


def test_free_text_points(spark):
    d = spark.createDataFrame([(1, "POINT (1 2)\nPOINT (3 4)"), (2, "5,6;7,8"), (3, '{"type":"Point","coordinates":[9,10]}')], "id long, t string")
    got = {(r.id, p.x, p.y) for r in L.ingest_text(d, "id", "t", "point").collect() for p in r.pts}
    assert got == {(1, 1, 2), (1, 3, 4), (2, 5, 6), (2, 7, 8), (3, 9, 10)}


def test_auc_with_ties_and_one_class(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), ("b", 1, 0.4)], "m string, label int, p double")
    r = {x.m: x.auc for x in M.auc(d, "m").collect()}
    assert r["a"] == pytest.approx(3.5 / 4) and r["b"] is None


def test_numerals_beyond_64_bits(spark):
    d = spark.createDataFrame([("一亿亿亿",), ("一亿亿亿亿亿亿",), ("三百二十五号",), (None,)], "t string")
    got = [r[0] for r in d.select(cn_digits(F.col("t"))).collect()]
    assert got == ["1" + "0" * 24, "一亿亿亿亿亿亿", "325号", None]
