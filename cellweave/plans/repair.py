"""Outline ingest and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geometry as G
from ..functions import rings as P
from ..operators import hulls
from ..operators import spatial as S
from ..session import each, spread
from ..sources import outlines as I
from . import fixtures as X
from .areas import AREA_CTES, area_shapes

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Test paths around a block: (dx, dy, shift in degrees, kept by dedup_ring, kept by drop_spikes).
PATHS = {
    "dup": [(-1, -1, 0, 1, 1), (-1, -1, 1e-7, 1, 1), (1, -1, 0, 1, 1), (1, 1, 0, 1, 1), (1, 1, 1e-7, 1, 1), (1, 1, 2e-7, 1, 1), (-1, 1, 0, 1, 1), (-1, -1, 0, 0, 1)],
    "spike": [(-1, -1, 0, 1, 1), (1, -1, 0, 1, 1), (1, 0, 0, 1, 1), (2, 0, 0, 1, 0), (1, 0, 0, 0, 0), (1, 1, 0, 1, 1), (-1, 1, 0, 1, 1), (-1, -1, 0, 0, 1)],
    "loop": [(-1, -1, 0, 1, 1), (1, -1, 0, 1, 1), (1, 0, 0, 1, 1), (1.0009765625, 0, 0, 1, 0), (1.0009765625, 0.0009765625, 0, 1, 0), (1, 0, 0, 0, 0), (1, 1, 0, 1, 1), (-1, 1, 0, 1, 1), (-1, -1, 0, 0, 1)],
    "open": [(-1, -1, 0, 1, 1), (1, -1, 0, 1, 1), (1, 1, 0, 1, 1), (-1, 1, 0, 1, 1)],
    "over": [(-1, -1, 0, 1, 1), (1, -1, 0, 1, 1), (1, 1, 0, 1, 1), (-1, 1, 0, 1, 1), (-1, -0.75, 0, 1, 1), (-1.5, -0.75, 0, 1, 1)],
    "inner": [(-1.5, -1, 0, 0, 1), (-1, -1, 0, 1, 1), (1, -1, 0, 1, 1), (1, 1, 0, 1, 1), (-1, 1, 0, 1, 1), (-1, -1, 0, 1, 1)],
}
NAMES = list(PATHS)
PATH_SQL = "SELECT id, cx, cy, r, CASE id % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + f" END AS path FROM ({X.BLOCK_SQL}) b"


def paths(spark, sf):
    """id, path name and points."""
    d = spread(X.run(spark, sf, PATH_SQL))
    cases = None
    for n, pts in PATHS.items():
        arr = F.array(*[G.xy(F.col("cx") + F.col("r") * float(x) + float(o), F.col("cy") + F.col("r") * float(y)) for x, y, o, _, _ in pts])
        cases = F.when(F.col("path") == n, arr) if cases is None else cases.when(F.col("path") == n, arr)
    # Text and back, as the jobs receive it.
    return d.select("id", "path", G.points_to_text(cases).alias("line")).select("id", "path", G.parse_points(F.col("line")).alias("pts"))


_ROWS = ", ".join(f"('{n}', {i}, {len(p)}, {float(x)}e0, {float(y)}e0, {o:.8f}e0, {k1}, {k2})" for n, p in PATHS.items() for i, (x, y, o, k1, k2) in enumerate(p))
PTS = f"""b AS ({X.for_oracle(PATH_SQL)}), pt AS (SELECT id, b.path, pos, n, cx + r * dx + o AS x, cy + r * dy AS y, k1, k2 FROM b JOIN (VALUES {_ROWS}) v(path, pos, n, dx, dy, o, k1, k2) ON v.path = b.path)"""


def _rows(df, col="pts"):
    return each(df, ["id"], F.col(col), "p", pos="pos").select("id", F.col("pos").cast("long").alias("pos"), G.rnd(F.col("p.x"), 9).alias("x"), G.rnd(F.col("p.y"), 9).alias("y"))


def _kept_sql(cond: str, with_cte: str = PTS) -> str:
    return f"""WITH {with_cte} SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, {X.r_sql('x', 9)} AS x, {X.r_sql('y', 9)} AS y FROM pt WHERE {cond}"""


@query
def near_dup_points(spark, sf):
    return _rows(paths(spark, sf).withColumn("pts", P.thin_near(F.col("pts"), 5)))


ORACLE["near_dup_points"] = f"""WITH {PTS}, l AS (SELECT *, lag(round(x, 5)) OVER w AS px, lag(round(y, 5)) OVER w AS py FROM pt WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, {X.r_sql('x', 9)} AS x, {X.r_sql('y', 9)} AS y FROM l WHERE pos = 0 OR pos = n - 1 OR px <> round(x, 5) OR py <> round(y, 5)"""


@query
def dedup_ring(spark, sf):
    return _rows(paths(spark, sf).withColumn("pts", P.dedup_ring(F.col("pts"))))


ORACLE["dedup_ring"] = _kept_sql("k1 = 1")


@query
def drop_spikes(spark, sf):
    return _rows(paths(spark, sf).withColumn("pts", P.drop_spikes(F.col("pts"))))


# The path that comes back to an inner point loses its way in: the first point.
ORACLE["drop_spikes"] = _kept_sql("k2 = 1 AND NOT (path = 'inner' AND pos = 0)")


@query
def close_ring(spark, sf):
    return _rows(paths(spark, sf).withColumn("pts", P.close_ring(F.col("pts"))))


ORACLE["close_ring"] = f"""WITH {PTS}, e AS (SELECT id, path, pos, x, y FROM pt WHERE NOT (path = 'inner' AND pos = 0)
  UNION ALL SELECT id, path, n, x, y FROM pt WHERE (pos = 0 AND path IN ('open', 'over')) OR (pos = 1 AND path = 'inner'))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, {X.r_sql('x', 9)} AS x, {X.r_sql('y', 9)} AS y FROM e"""


@query
def densify(spark, sf):
    """Edges split every 100 m."""
    return _rows(paths(spark, sf).withColumn("pts", P.densify(F.col("pts"), 100.0)))


HAV = "2 * 6378137e0 * asin(sqrt(power(sin(radians(y - ny) / 2), 2) + cos(radians(y)) * cos(radians(ny)) * power(sin(radians(x - nx) / 2), 2)))"
LEGS = f"{PTS}, l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pt WINDOW w AS (PARTITION BY id ORDER BY pos))"
ORACLE["densify"] = f"""WITH {LEGS}, k AS (SELECT *, CASE WHEN nx IS NULL THEN 1 ELSE greatest(1, CAST(ceil({HAV} / 100) AS BIGINT)) END AS k FROM l), j AS (SELECT *, unnest(range(0, k)) AS j FROM k)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, j) - 1 AS pos, {X.r_sql('CASE WHEN j = 0 THEN x ELSE x - round((x - nx) * j / k, 12) END', 9)} AS x,
  {X.r_sql('CASE WHEN j = 0 THEN y ELSE y - round((y - ny) * j / k, 12) END', 9)} AS y FROM j"""


@query
def line_length(spark, sf):
    d = paths(spark, sf).select("id", P.line_length(F.col("pts")).alias("m"), P.running_length(F.col("pts")).alias("run"))
    return d.select("id", G.rnd(F.col("m"), 2).alias("metres"), G.rnd(F.get("run", F.lit(2)), 2).alias("at_third"))


ORACLE["line_length"] = f"""WITH {LEGS}, m AS (SELECT id, pos, coalesce({HAV}, 0e0) AS d FROM l)
SELECT id, {X.r_sql('sum(d)', 2)} AS metres, {X.r_sql('sum(CASE WHEN pos < 2 THEN d ELSE 0e0 END)', 2)} AS at_third FROM m GROUP BY id"""


@query
def thin_outline(spark, sf):
    """Outlines filled up to over 500 points and thinned again: points before and after."""
    d = paths(spark, sf).select("id", P.densify(F.col("pts"), 2.0).alias("full"))
    d = d.select("id", F.size("full").cast("long").alias("n_full"), P.thin_outline(F.col("full")).alias("thin"))
    return d.select("id", "n_full", F.size("thin").cast("long").alias("n_thin"))


@query
def invalid_flag(spark, sf):
    """Outlines with a proper crossing of their own edges; some are twisted on purpose."""
    d = X.run(spark, sf, X.BLOCK_SQL)
    order = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    twist = [(-1, -1), (1, 1), (1, -1), (-1, 1)]

    def arr(c):
        return F.array(*[G.xy(F.col("cx") + F.col("r") * x, F.col("cy") + F.col("r") * y) for x, y in c])

    d = d.select("id", F.when(F.col("id") % 7 == 0, arr(twist)).otherwise(arr(order)).alias("pts"))
    return d.select("id", P.self_crossing(F.col("pts")).alias("invalid"))


ORACLE["invalid_flag"] = f"WITH b AS ({X.for_oracle(X.BLOCK_SQL)}) SELECT id, id % 7 = 0 AS invalid FROM b"

AREA_PTS = f"a AS ({X.for_oracle(X.AREA_SQL)}), {X.edges_cte('ae', 'a', ', s.shape')}"


@query
def wkt_roundtrip(spark, sf):
    """Text to outline and back: closed rings, 6 decimals."""
    d = each(X.areas(spark, sf), ["id"], F.array(G.parse_polygon(F.col("polygon"))), "rings")
    return d.select(F.col("id").alias("aoi_id"), G.rings_to_wkt(F.col("rings")).alias("wkt"))


ORACLE["wkt_roundtrip"] = f"""WITH {AREA_PTS}, p AS (SELECT id, ring, string_agg(printf('%.6f', x1) || ' ' || printf('%.6f', y1), ', ' ORDER BY pos) AS t,
  any_value(CASE WHEN pos = 0 THEN printf('%.6f', x1) || ' ' || printf('%.6f', y1) END) AS f FROM ae GROUP BY id, ring)
SELECT id AS aoi_id, 'POLYGON (' || string_agg('(' || t || ', ' || f || ')', ', ' ORDER BY ring) || ')' AS wkt FROM p GROUP BY id"""


@query
def good_rows(spark, sf):
    """Ingest with quarantine: some outlines lose a coordinate, a bracket or points."""
    d = X.areas(spark, sf).select("id", F.when(F.col("id") % 9 == 0, F.regexp_replace("polygon", r"POLYGON \(\(\S+", "POLYGON ((x"))
                                  .when(F.col("id") % 9 == 1, F.regexp_replace("polygon", "POLYGON", "POLYGO"))
                                  .when(F.col("id") % 9 == 2, F.regexp_replace("polygon", r",.*", "))")).otherwise(F.col("polygon")).alias("polygon"))
    good, bad = I.split_valid(d, "id", "polygon")
    return good.select(F.col("id").alias("aoi_id"), F.lit("good").alias("status"), F.size("rings").cast("long").alias("n_rings")).unionByName(
        bad.select(F.col("id").alias("aoi_id"), F.lit("bad").alias("status"), F.lit(0).cast("long").alias("n_rings")))


ORACLE["good_rows"] = f"""WITH a AS ({X.for_oracle(X.AREA_SQL)}) SELECT id AS aoi_id, CASE WHEN id % 9 <= 2 THEN 'bad' ELSE 'good' END AS status,
  CAST(CASE WHEN id % 9 <= 2 THEN 0 WHEN shape = 'hole' THEN 2 ELSE 1 END AS BIGINT) AS n_rings FROM a"""


def _multi(spark, sf):
    """Areas as two-part outlines: the shape and a smaller square beside it."""
    d = X.run(spark, sf, X.AREA_SQL)
    one = F.regexp_replace(X.outline_wkt(), "POLYGON ", "")
    two = F.regexp_replace(X.outline_wkt("cx + 4 * r", "cy", "r * 0.5D", "'square'"), "POLYGON ", "")
    return d.select("id", "shape", F.concat(F.lit("MULTIPOLYGON ("), one, F.lit(", "), two, F.lit(")")).alias("polygon"))


@query
def explode_parts(spark, sf):
    """Parts and rings as rows of their own, with their areas."""
    r = I.explode_rings(_multi(spark, sf), "id", "polygon")
    return r.select(F.col("id").alias("aoi_id"), F.col("part").cast("long").alias("part"), F.col("ring").cast("long").alias("ring"), G.rnd(F.abs(G.signed_area(F.col("pts"))) * 1e10, 2).alias("area_e10"))


ORACLE["explode_parts"] = f"""WITH a AS ({X.for_oracle(X.AREA_SQL)}), r AS (
  SELECT id, 1 AS part, 0 AS ring, CASE shape WHEN 'tri' THEN 2 WHEN 'L' THEN 3 ELSE 4 END * r * r AS ar FROM a
  UNION ALL SELECT id, 1, 1, r * r FROM a WHERE shape = 'hole' UNION ALL SELECT id, 2, 0, r * r FROM a)
SELECT id AS aoi_id, CAST(part AS BIGINT) AS part, CAST(ring AS BIGINT) AS ring, {X.r_sql('ar * 1e10', 2)} AS area_e10 FROM r"""


@query
def largest_part(spark, sf):
    """The larger part of every two-part outline, without its holes."""
    d = each(_multi(spark, sf), ["id"], F.array(G.parse_polygon(F.col("polygon"))), "rings")
    top = d.select("id", I.largest_part(F.col("rings")).alias("rings"))
    s = S.with_edges(top.select("id", F.col("rings"), I.drop_holes(F.col("rings")).alias("shell")).select("id", F.col("shell").alias("rings"), F.size("rings").cast("long").alias("n_rings")))
    return s.select(F.col("id").alias("aoi_id"), "n_rings", G.rnd(F.col("area") * 1e10, 2).alias("shell_e10"))


ORACLE["largest_part"] = f"""WITH a AS ({X.for_oracle(X.AREA_SQL)})
SELECT id AS aoi_id, CAST(CASE WHEN shape = 'hole' THEN 2 ELSE 1 END AS BIGINT) AS n_rings, {X.r_sql("CASE shape WHEN 'tri' THEN 2 WHEN 'L' THEN 3 ELSE 4 END * r * r * 1e10", 2)} AS shell_e10 FROM a"""


@query
def simple_only(spark, sf):
    """Outlines with a single part and no hole."""
    d = X.areas(spark, sf).unionByName(_multi(spark, sf).select((-F.col("id") - 1).alias("id"), "polygon"))
    good, _ = I.split_valid(d, "id", "polygon")
    return good.where(I.is_simple(F.col("rings"))).select(F.col("id").alias("aoi_id"))


ORACLE["simple_only"] = f"WITH a AS ({X.for_oracle(X.AREA_SQL)}) SELECT id AS aoi_id FROM a WHERE shape <> 'hole'"


@query
def sliver(spark, sf):
    """Sliver and compactness flags of blocks stretched by their id."""
    d = X.run(spark, sf, X.BLOCK_SQL).withColumn("w", F.col("r") / (F.col("id") % 40 + 1)).withColumn("h", F.col("r") * 0.5)
    a, p = F.col("w") * F.col("h"), (F.col("w") + F.col("h")) * 2
    return d.select("id", G.is_sliver(a, p, F.col("category")).alias("sliver"), G.is_compact(a, p).alias("compact"))


ORACLE["sliver"] = f"""WITH b AS ({X.for_oracle(X.BLOCK_SQL)}), d AS (SELECT id, category, r / (id % 40 + 1) * (r * 0.5e0) AS a, (r / (id % 40 + 1) + r * 0.5e0) * 2 AS p FROM b), e AS (SELECT *, p / a * (p / 20) AS t FROM d)
SELECT id, category NOT IN ('居住', '办公', '商业') AND t > 2 AND (a * 1e10 < 500 OR (t > 20e0 / 9 AND a * 1e10 <= 5000) OR (t > 10 AND a * 1e10 <= 100000)) AS sliver,
  NOT (t > 10 OR a * 1e10 < 1000) AS compact FROM e"""


@query
def bbox_rect(spark, sf):
    """Box of each area as an outline, from two diagonal corners; overall padded box appended as id -1."""
    s = area_shapes(spark, sf)
    r = s.select("id", P.rectangle(G.xy(F.col("xmax"), F.col("ymin")), G.xy(F.col("xmin"), F.col("ymax"))).alias("pts"))
    view = I.view_box(s, 0.05).select(F.lit(-1).cast("long").alias("id"), P.rectangle(G.xy(F.col("xmin"), F.col("ymin")), G.xy(F.col("xmax"), F.col("ymax"))).alias("pts"))
    return r.unionByName(view).select(F.col("id").alias("aoi_id"), G.points_to_text(F.transform("pts", lambda p: G.xy(F.round(p["x"], 6), F.round(p["y"], 6)))).alias("ring"))


_C = "CAST(round({}, 6) AS VARCHAR)"
ORACLE["bbox_rect"] = f"""WITH {AREA_CTES}, v AS (SELECT id, xmin, ymin, xmax, ymax FROM ab UNION ALL
  SELECT -1, min(xmin) - (max(xmax) - min(xmin)) * 0.05e0, min(ymin) - (max(ymax) - min(ymin)) * 0.05e0, max(xmax) + (max(xmax) - min(xmin)) * 0.05e0, max(ymax) + (max(ymax) - min(ymin)) * 0.05e0 FROM ab)
SELECT id AS aoi_id, {_C.format('xmin')} || ',' || {_C.format('ymin')} || ';' || {_C.format('xmin')} || ',' || {_C.format('ymax')} || ';' || {_C.format('xmax')} || ',' || {_C.format('ymax')} || ';' || {_C.format('xmax')} || ',' || {_C.format('ymin')} AS ring FROM v"""


@query
def hull(spark, sf):
    """Hull of the corners of all cells a user was seen in, and its size."""
    c = X.pings(spark, sf).select("user_id", C.geohash(F.col("lat"), F.col("lng"), 7).alias("cell")).distinct().select("user_id", C.geohash_bbox(F.col("cell")).alias("b"))
    pts = c.select("user_id", F.explode(P.rectangle(G.xy(F.col("b.w"), F.col("b.s")), G.xy(F.col("b.e"), F.col("b.n")))).alias("p")).select("user_id", "p.x", "p.y")
    h = hulls.hull(pts, "user_id")
    return h.select("user_id", F.size("pts").cast("long").alias("n_points"), G.rnd(G.signed_area(F.col("pts")) * 1e10, 1).alias("area_e10"))


@query
def rot_rect(spark, sf):
    """Share of the smallest rotated rectangle that each area fills."""
    s = area_shapes(spark, sf)
    pts = F.transform("edges", lambda e: G.xy(e["x1"], e["y1"]))
    s = s.select("id", "area", hulls.hull_of(pts).alias("hull")).withColumn("rect", hulls.rotated_rect_area(F.col("hull")))
    return s.select(F.col("id").alias("aoi_id"), G.rnd(F.when(F.col("rect") > 0, F.col("area") / F.col("rect")).otherwise(-1.0), 4).alias("ratio"))


# Known figures: squares fill their box, triangles half of it, L-shapes three quarters, holed squares three quarters.
ORACLE["rot_rect"] = f"""WITH a AS ({X.for_oracle(X.AREA_SQL)}) SELECT id AS aoi_id, CASE shape WHEN 'square' THEN 1e0 WHEN 'tri' THEN 0.5e0 ELSE 0.75e0 END AS ratio FROM a"""


@query
def coords_text(spark, sf):
    """Point text of five kinds to outlines and back."""
    d = paths(spark, sf).select("id", G.points_to_text(F.col("pts")).alias("t"))
    kind = F.element_at(F.array(*[F.lit(k) for k in I.KINDS]), (F.col("id") % 5 + 1).cast("int"))
    r = I.ingest_coords(d.withColumn("kind", kind), "id", "t", "kind")
    return r.select("id", "kind", F.size("pts").cast("long").alias("n"), F.md5(F.col("text")).alias("h"))


_N = {"polygon": "k", "linestring": "n", "point": "1", "linearring": "k", "multipoint": "n"}
ORACLE["coords_text"] = f"""WITH {PTS}, q AS (SELECT *, CASE id % 5 WHEN 0 THEN 'polygon' WHEN 1 THEN 'linestring' WHEN 2 THEN 'point' WHEN 3 THEN 'linearring' ELSE 'multipoint' END AS kind FROM pt),
c AS (SELECT id, pos, x, y, kind FROM q WHERE kind <> 'point' OR pos = 0 UNION ALL SELECT id, n, x, y, kind FROM q WHERE pos = 0 AND kind IN ('polygon', 'linearring') AND path IN ('open', 'over', 'inner'))
SELECT id, any_value(kind) AS kind, count(*) AS n, md5(string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR), ';' ORDER BY pos)) AS h FROM c GROUP BY id"""


@query
def mixed_text_points(spark, sf):
    """Points, lines and polygons out of free text: WKT, bare pairs or GeoJSON in one column."""
    d = X.run(spark, sf, X.BLOCK_SQL)
    ring = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    pairs = [(F.col("cx") + F.col("r") * x, F.col("cy") + F.col("r") * y) for x, y in ring]
    wkt = F.concat(F.lit("POLYGON (("), F.array_join(F.array(*[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in pairs]), ", "), F.lit("))"))
    bare = F.array_join(F.array(*[F.concat_ws(",", x.cast("string"), y.cast("string")) for x, y in pairs]), ";")
    gj = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[['),
                  F.array_join(F.array(*[F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")) for x, y in pairs]), ","), F.lit("]]}}"))
    t = F.when(F.col("id") % 3 == 0, wkt).when(F.col("id") % 3 == 1, bare).otherwise(gj)
    # Every other row carries longitudes one turn too far.
    r = I.ingest_text(d.select("id", t.alias("t")), "id", "t", "poly")
    return r.select("id", "kind", F.size("pts").cast("long").alias("n"), G.rnd(F.col("pts")[2]["x"], 7).alias("x3"), G.rnd(F.col("pts")[2]["y"], 7).alias("y3"))


ORACLE["mixed_text_points"] = f"""WITH b AS ({X.for_oracle(X.BLOCK_SQL)}) SELECT id, 'poly' AS kind, CAST(5 AS BIGINT) AS n, {X.r_sql('cx + r', 7)} AS x3, {X.r_sql('cy + r', 7)} AS y3 FROM b"""
