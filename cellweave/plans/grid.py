"""Cells of points: geohash, tiles, pixels, coordinate shifts; active cells and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geometry as G
from ..operators import groups as R
from ..operators import spatial as S
from . import fixtures as X

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


PING = f"p AS ({X.for_oracle(X.PING_SQL)})"
VALID = "is_dau = 1 AND user_id > 0 AND lng > 0 AND lat > 0"
BLOCK_CTES = ", ".join([f"b AS ({X.for_oracle(X.BLOCK_SQL)})", X.edges_cte("be", "b"), X.box_cte("bb", "be")])
REGION_CTES = ", ".join([f"g AS ({X.for_oracle(X.REGION_SQL)})", X.region_edges_cte("ge", "g"), X.box_cte("gb", "ge")])
AREA_CTES = ", ".join([f"a AS ({X.for_oracle(X.AREA_SQL)})", X.edges_cte("ae", "a"), X.box_cte("ab", "ae")])


def gh_sql(lon: str, lat: str, precision: int) -> str:
    """Geohash text from quantised integers, in list functions."""
    lb = (5 * precision + 1) // 2
    tb = 5 * precision - lb
    return (
        f"array_to_string(list_transform(range(0, {precision}), lambda i: substr('{C.BASE32}', 1 + CAST(list_sum(list_transform(range(0, 5), "
        f"lambda j: (((CASE WHEN (5 * i + j) % 2 = 0 THEN {lon} >> ({lb - 1} - (5 * i + j) // 2) ELSE {lat} >> ({tb - 1} - (5 * i + j) // 2) END) & 1) << (4 - j)))) AS BIGINT), 1)), '')"
    )


def gh_ints_sql(lng: str, lat: str, precision: int) -> str:
    lb = (5 * precision + 1) // 2
    tb = 5 * precision - lb
    return f"CAST(floor(({lng} + 180) / 360e0 * {1 << lb}) AS BIGINT) AS qx, CAST(floor(({lat} + 90) / 180e0 * {1 << tb}) AS BIGINT) AS qy"


def valid_pings(spark, sf):
    return R.valid_activity(X.pings(spark, sf))


@query
def valid_activity(spark, sf):
    return valid_pings(spark, sf).select("id", "user_id", G.rnd(F.col("lng"), 7).alias("lng"), G.rnd(F.col("lat"), 7).alias("lat"))


ORACLE["valid_activity"] = f"WITH {PING} SELECT id, user_id, {X.r_sql('lng', 7)} AS lng, {X.r_sql('lat', 7)} AS lat FROM p WHERE {VALID}"


@query
def geohash_encode(spark, sf):
    p = X.pings(spark, sf)
    return p.select("id", *[C.geohash(F.col("lat"), F.col("lng"), n).alias(f"gh{n}") for n in (5, 6, 8)])


ORACLE["geohash_encode"] = "WITH " + PING + "".join(
    f", q{n} AS (SELECT id, {gh_ints_sql('lng', 'lat', n)} FROM p)" for n in (5, 6, 8)
) + " SELECT q5.id, " + ", ".join(f"{gh_sql(f'q{n}.qx', f'q{n}.qy', n)} AS gh{n}" for n in (5, 6, 8)) + " FROM q5 JOIN q6 ON q6.id = q5.id JOIN q8 ON q8.id = q5.id"


@query
def active_cells(spark, sf):
    """Geohash-6 cells with at least 7 valid events."""
    return R.active_cells(valid_pings(spark, sf), 6, 7)


ACTIVE = f"""q AS (SELECT {gh_ints_sql('lng', 'lat', 6)} FROM p WHERE {VALID}),
act AS (SELECT qx, qy, count(*) AS events FROM q GROUP BY qx, qy HAVING count(*) >= 7)"""
ORACLE["active_cells"] = f"WITH {PING}, {ACTIVE} SELECT {gh_sql('qx', 'qy', 6)} AS cell, events FROM act"


@query
def geohash_bbox(spark, sf):
    """Box, centre and half sizes of every cell that has an event."""
    c = X.pings(spark, sf).select(C.geohash(F.col("lat"), F.col("lng"), 7).alias("cell")).distinct()
    b = c.select("cell", C.geohash_bbox(F.col("cell")).alias("b"))
    return b.select(
        "cell", *[G.rnd(F.col(f"b.{k}"), 9).alias(k) for k in "wsen"],
        G.rnd((F.col("b.s") + F.col("b.n")) / 2, 9).alias("lat"), G.rnd((F.col("b.w") + F.col("b.e")) / 2, 9).alias("lng"),
        G.rnd((F.col("b.n") - F.col("b.s")) / 2, 9).alias("dlat"), G.rnd((F.col("b.e") - F.col("b.w")) / 2, 9).alias("dlng"),
    )


_LB, _TB = 1 << 18, 1 << 17
ORACLE["geohash_bbox"] = f"""
WITH {PING}, q AS (SELECT DISTINCT {gh_ints_sql('lng', 'lat', 7)} FROM p),
b AS (SELECT {gh_sql('qx', 'qy', 7)} AS cell, qx * 360e0 / {_LB} - 180 AS w, qy * 180e0 / {_TB} - 90 AS s, (qx + 1) * 360e0 / {_LB} - 180 AS e, (qy + 1) * 180e0 / {_TB} - 90 AS n FROM q)
SELECT cell, {', '.join(X.r_sql(k, 9) + ' AS ' + k for k in 'wsen')}, {X.r_sql('(s + n) / 2', 9)} AS lat, {X.r_sql('(w + e) / 2', 9)} AS lng,
  {X.r_sql('(n - s) / 2', 9)} AS dlat, {X.r_sql('(e - w) / 2', 9)} AS dlng FROM b"""


@query
def geohash_neighbors(spark, sf):
    c = X.pings(spark, sf).select(C.geohash(F.col("lat"), F.col("lng"), 6).alias("cell")).distinct()
    return c.select("cell", F.explode(C.geohash_neighbors(F.col("cell"), 6)).alias("neighbor"))


ORACLE["geohash_neighbors"] = f"""
WITH {PING}, q AS (SELECT DISTINCT {gh_ints_sql('lng', 'lat', 6)} FROM p),
n AS (SELECT qx, qy, qx + dx AS nx, qy + dy AS ny FROM q, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE dx <> 0 OR dy <> 0)
SELECT {gh_sql('qx', 'qy', 6)} AS cell, {gh_sql('nx', 'ny', 6)} AS neighbor FROM n"""


@query
def tile_xy(spark, sf):
    p = X.pings(spark, sf).select("id", C.tile(F.col("lng"), F.col("lat"), 18).alias("t"))
    return p.select("id", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), C.tile_pack(F.col("t.x"), F.col("t.y"), 18).alias("key"))


TILE = "CAST(floor((lng + 180) / 360 * 262144) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 262144) AS BIGINT) AS ty"
ORACLE["tile_xy"] = f"WITH {PING}, t AS (SELECT id, {TILE} FROM p) SELECT id, tx, ty, 18 * 72057594037927936 + tx * 268435456 + ty AS key FROM t"


@query
def tile_inverse(spark, sf):
    t = X.pings(spark, sf).select(C.tile(F.col("lng"), F.col("lat"), 18).alias("t")).select("t.x", "t.y").distinct()
    t = t.select(F.col("x").alias("tx"), F.col("y").alias("ty"), C.tile_center(F.col("x"), F.col("y"), 18).alias("c"))
    return t.select("tx", "ty", G.rnd(F.col("c.x"), 8).alias("lng"), G.rnd(F.col("c.y"), 8).alias("lat"))


ORACLE["tile_inverse"] = f"""
WITH {PING}, t AS (SELECT DISTINCT {TILE} FROM p)
SELECT tx, ty, {X.r_sql('tx / 262144e0 * 360 - 180', 8)} AS lng, {X.r_sql('degrees(atan((exp(pi() * (1 - 2e0 * ty / 262144)) - exp(-pi() * (1 - 2e0 * ty / 262144))) / 2))', 8)} AS lat FROM t"""


@query
def cell_parent(spark, sf):
    """Events per tile at zoom 17, 18 and 19: three levels of one pyramid."""
    p = X.pings(spark, sf).select(C.tile(F.col("lng"), F.col("lat"), 19).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    lv = F.explode(F.array(*[
        F.struct(F.lit(19 - up).cast("long").alias("zoom"), C.tile_parent(F.col("t.x"), F.col("t.y"), up).alias("p")) for up in (0, 1, 2)
    ])).alias("lv")
    r = p.select("n", lv).groupBy("lv.zoom", "lv.p.x", "lv.p.y").agg(F.sum("n").alias("events"))
    return r.select("zoom", F.col("x").alias("tx"), F.col("y").alias("ty"), "events")


ORACLE["cell_parent"] = f"""
WITH {PING}, t AS (SELECT {TILE.replace('262144', '524288')} FROM p)
SELECT CAST(z AS BIGINT) AS zoom, tx >> (19 - z) AS tx, ty >> (19 - z) AS ty, count(*) AS events
FROM t, (VALUES (17), (18), (19)) v(z) GROUP BY 1, 2, 3"""


@query
def pixel_heat(spark, sf):
    """Valid events per 1 m pixel of the block they lie in, 400 x 400 around its centre."""
    pts = valid_pings(spark, sf).select("id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    b = S.shapes(X.blocks(spark, sf), "id", "polygon")
    return R.pixel_heat(pts, b, 400, 400).withColumnRenamed("id", "block_id")


def inside_sql(pts: str, edges: str, boxes: str, name: str = "pin") -> str:
    """CTE ``name`` (pid, id): points inside shapes by brute force."""
    return f"""{name} AS (SELECT p.id AS pid, e.id FROM {pts} p JOIN {boxes} b ON p.x BETWEEN b.xmin AND b.xmax AND p.y BETWEEN b.ymin AND b.ymax JOIN {edges} e ON e.id = b.id
  GROUP BY p.id, e.id HAVING sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)"""


PTS = f"pt AS (SELECT id, lng AS x, lat AS y FROM p WHERE {VALID})"
ORACLE["pixel_heat"] = f"""
WITH {PING}, {BLOCK_CTES}, {PTS}, {inside_sql('pt', 'be', 'bb')},
px AS (SELECT i.id, (xmin + xmax) / 2 AS mx, (ymin + ymax) / 2 AS my, x, y FROM pin i JOIN pt ON pt.id = i.pid JOIN bb ON bb.id = i.id),
ix AS (SELECT id, 200 + CASE WHEN y > my THEN 1 ELSE -1 END * CAST(ceil(abs(y - my) / 8.993203677616966e-06 - 0.5e0) AS BIGINT) AS r,
  200 + CASE WHEN x > mx THEN 1 ELSE -1 END * CAST(ceil(abs(x - mx) / 1.1700193970443768e-05 - 0.5e0) AS BIGINT) AS c FROM px)
SELECT id AS block_id, r AS "row", c AS col, count(*) AS heat FROM ix WHERE r BETWEEN 0 AND 399 AND c BETWEEN 0 AND 399 GROUP BY 1, 2, 3"""


@query
def pixel_to_lnglat(spark, sf):
    """Coordinates of one pixel per event inside its region's grid; (-1, -1) outside."""
    b = X.pings(spark, sf).select("id", (F.col("id") % 500 - 20).alias("row"), (F.col("user_id") % 500 - 20).alias("col"), "lng", "lat")
    box = (F.col("lng") - 0.01, F.col("lat") - 0.01, F.col("lng") + 0.01, F.col("lat") + 0.01)
    r = b.select("id", C.pixel_to_lnglat(F.col("row"), F.col("col"), box, 400, 400).alias("c"))
    return r.select("id", G.rnd(F.col("c.x"), 8).alias("lng"), G.rnd(F.col("c.y"), 8).alias("lat"))


ORACLE["pixel_to_lnglat"] = f"""
WITH {PING}, i AS (SELECT id, id % 500 - 20 AS r, user_id % 500 - 20 AS c, ((lng - 0.01e0) + (lng + 0.01e0)) / 2 AS mx, ((lat - 0.01e0) + (lat + 0.01e0)) / 2 AS my FROM p)
SELECT id, {X.r_sql('CASE WHEN r BETWEEN 0 AND 399 AND c BETWEEN 0 AND 399 THEN mx - (200 - c) * 1.1700193970443768e-05 ELSE -1e0 END', 8)} AS lng,
  {X.r_sql('CASE WHEN r BETWEEN 0 AND 399 AND c BETWEEN 0 AND 399 THEN my - (200 - r) * 8.993203677616966e-06 ELSE -1e0 END', 8)} AS lat FROM i"""


@query
def gcj_shift(spark, sf):
    """Shift to GCJ-02 and the error of shifting back, in millimetres (rounded to whole ones)."""
    p = X.pings(spark, sf).select("id", "lng", "lat", G.to_gcj(F.col("lng"), F.col("lat")).alias("g"))
    p = p.withColumn("back", G.from_gcj(F.col("g.x"), F.col("g.y")))
    off = G.haversine(F.col("lng"), F.col("lat"), F.col("back.x"), F.col("back.y")) * 1000
    return p.select("id", G.rnd(F.col("g.x"), 7).alias("gcj_lng"), G.rnd(F.col("g.y"), 7).alias("gcj_lat"), G.rnd(off, 0).alias("back_mm"))


_RIP = "(20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3"
ORACLE["gcj_shift"] = f"""
WITH {PING}, o AS (SELECT id, lng, lat, lng - 105 AS x, lat - 35 AS y, radians(lat) AS rad FROM p),
d AS (SELECT *, -100 + 2 * x + 3 * y + 0.2e0 * y * y + 0.1e0 * x * y + 0.2e0 * sqrt(abs(x)) + {_RIP}
    + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3 AS dlat,
  300 + x + 2 * y + 0.1e0 * x * x + 0.1e0 * x * y + 0.1e0 * sqrt(abs(x)) + {_RIP}
    + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS dlng,
  1 - 0.00669342162296594323e0 * sin(rad) * sin(rad) AS m FROM o)
SELECT id, {X.r_sql('lng + dlng * 180 / (6378245e0 / sqrt(m) * cos(rad) * pi())', 7)} AS gcj_lng,
  {X.r_sql('lat + dlat * 180 / ((6378245e0 * (1 - 0.00669342162296594323e0)) / (m * sqrt(m)) * pi())', 7)} AS gcj_lat, 0e0 AS back_mm FROM d"""


@query
def great_circle(spark, sf):
    """Distance of every event from the middle of the map, in metres."""
    p = X.pings(spark, sf)
    return p.select("id", G.rnd(G.haversine(F.col("lng"), F.col("lat"), F.lit(116.25), F.lit(39.95)), 2).alias("metres"))


ORACLE["great_circle"] = f"""
WITH {PING} SELECT id, {X.r_sql('2 * 6378137e0 * asin(sqrt(power(sin(radians(39.95e0 - lat) / 2), 2) + cos(radians(39.95e0)) * cos(radians(lat)) * power(sin(radians(116.25e0 - lng) / 2), 2)))', 2)} AS metres FROM p"""


@query
def norm_lon(spark, sf):
    """Longitudes shifted by whole turns come back; swapped pairs are put right."""
    p = X.pings(spark, sf).withColumn("raw", F.col("lng") + ((F.col("id") % 5) - 2) * 360.0 + (F.col("id") % 3) * 60.0)
    s = R.swap_if(p.withColumn("swapped", F.col("id") % 4 == 0).select(
        "id", "swapped", F.when(F.col("swapped"), F.col("lat")).otherwise(F.col("raw")).alias("lng"),
        F.when(F.col("swapped"), F.col("raw")).otherwise(F.col("lat")).alias("lat")), "swapped")
    return s.select("id", G.rnd(G.norm_lon(F.col("lng")), 7).alias("lng"), G.rnd(F.col("lat"), 7).alias("lat"))


ORACLE["norm_lon"] = f"""
WITH {PING}, q AS (SELECT id, lat, lng + (id % 3) * 60e0 AS v FROM p)
SELECT id, {X.r_sql('CASE WHEN v > 180 THEN v - 360 ELSE v END', 7)} AS lng, {X.r_sql('lat', 7)} AS lat FROM q"""


def active_shapes(spark, sf):
    """Active cells as shapes; ids are the quantised pair in one long."""
    act = R.active_cells(valid_pings(spark, sf), 6, 7)
    return S.stage(R.cells_as_shapes(act, "cell"), "active")


@query
def semi_active(spark, sf):
    """Blocks (water left out) that meet at least one active cell, with their region."""
    b = R.not_category(X.blocks(spark, sf), "category", ["水系"])
    b = S.shapes(b, "id", "polygon", ["category"])
    g = S.shapes(X.regions(spark, sf), "id", "polygon", ["name", "level", "parentcode"])
    kept = S.stage(S.spatial_semi(b, active_shapes(spark, sf)), "active-blocks")
    r = S.assign_max_overlap(kept, g, ["name", "level", "parentcode"])
    return r.select(
        F.col("id").alias("blockid"), F.col("category").alias("detailed_category"), F.coalesce("r_id", F.lit(-1)).alias("code"),
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("parentcode", F.lit(-1)).alias("parentcode"),
    )


_CELL_BOX = f"""{ACTIVE}, cr AS (SELECT qy * 65536 + qx AS id, qx * 360e0 / 32768 - 180 AS w, qy * 180e0 / 32768 - 90 AS s, (qx + 1) * 360e0 / 32768 - 180 AS e, (qy + 1) * 180e0 / 32768 - 90 AS n FROM act),
ce AS (SELECT id, 0 AS ring, pos, CASE WHEN pos IN (1, 2) THEN e ELSE w END AS x1, CASE WHEN pos IN (2, 3) THEN n ELSE s END AS y1,
  CASE WHEN pos IN (0, 1) THEN e ELSE w END AS x2, CASE WHEN pos IN (1, 2) THEN n ELSE s END AS y2 FROM cr, (VALUES (0), (1), (2), (3)) v(pos)), {X.box_cte('cb', 'ce')}"""
ORACLE["semi_active"] = f"""
WITH {PING}, {BLOCK_CTES}, {REGION_CTES}, {_CELL_BOX}, {X.overlap_ctes('be', 'bb', 'ce', 'cb', name='ca')},
kept AS (SELECT b.id, b.category FROM b WHERE category <> '水系' AND id IN (SELECT l_id FROM ca WHERE {X.MEETS})),
{X.overlap_ctes('be', 'bb', 'ge', 'gb', 'l.id IN (SELECT id FROM kept)')},
best AS (SELECT l_id, r_id FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY inter DESC, r_id) AS rn FROM hit WHERE {X.MEETS}) t WHERE rn = 1)
SELECT k.id AS blockid, k.category AS detailed_category, coalesce(g.id, -1) AS code, coalesce(g.name, '') AS name, coalesce(g.level, -1) AS level, coalesce(g.parentcode, -1) AS parentcode
FROM kept k LEFT JOIN best ON best.l_id = k.id LEFT JOIN g ON g.id = best.r_id"""


@query
def anti_free(spark, sf):
    """Blocks that no area touches."""
    b = S.shapes(X.blocks(spark, sf), "id", "polygon", ["category"])
    a = S.shapes(X.areas(spark, sf), "id", "polygon")
    return S.spatial_anti(b, a).select(F.col("id").alias("blockid"), "category")


ORACLE["anti_free"] = f"""
WITH {BLOCK_CTES}, {AREA_CTES}, {X.overlap_ctes('be', 'bb', 'ae', 'ab')}
SELECT id AS blockid, category FROM b WHERE id NOT IN (SELECT l_id FROM hit WHERE {X.MEETS})"""


@query
def piece_heat(spark, sf):
    """Valid events inside each block; blocks without any have heat 0."""
    pts = valid_pings(spark, sf).select("id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return R.piece_heat(pts, S.shapes(X.blocks(spark, sf), "id", "polygon")).select(F.col("id").alias("block_id"), "heat")


ORACLE["piece_heat"] = f"""
WITH {PING}, {BLOCK_CTES}, {PTS}, {inside_sql('pt', 'be', 'bb')}, h AS (SELECT id, count(*) AS n FROM pin GROUP BY id)
SELECT b.id AS block_id, coalesce(n, 0) AS heat FROM b LEFT JOIN h ON h.id = b.id"""
