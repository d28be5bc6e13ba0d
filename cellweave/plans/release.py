"""The versioned release: snapshots of blocks and of areas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..operators import groups as R
from ..operators import outline as L
from ..operators import overlay as O
from ..operators import snapshots as N
from ..operators import spatial as S
from ..session import stage
from ..sources import catalog as C
from . import blocks as B
from . import fixtures as X
from .blocks import CELL, _cells_sql, _runs_sql

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


CODE = "CAST(100 + floor((cx - 116e0) / 0.1e0) + 5 * floor((cy - 39.7e0) / 0.1e0) AS BIGINT)"
# Two stored days, today's candidates, and a second, smaller copy of some of them.
RELEASE_SQL = f"""
SELECT id AS shadow_id, cx + moved AS cx, cy, r, shape, category, heat, dt, {CODE} AS code,
  CASE WHEN shape = 'L' THEN 3 ELSE 4 END * r * r * 1e10 AS area
FROM (
  SELECT id, cx, cy, r, shape, category, 0e0 AS moved, CAST(id % 7 AS BIGINT) AS heat, '20240101' AS dt FROM ({X.BLOCK_SQL}) b WHERE id % 10 <> 0
  UNION ALL SELECT id, cx, cy, r, shape, category, 0e0, CAST(id % 7 AS BIGINT), '20231231' FROM ({X.BLOCK_SQL}) b WHERE id % 3 = 0
  UNION ALL SELECT id, cx, cy, r, shape, category, CASE WHEN id % 10 = 2 THEN 0.001e0 ELSE 0e0 END, CAST(id % 6 AS BIGINT), '20240102' FROM ({X.BLOCK_SQL}) b WHERE id % 10 <> 1
  UNION ALL SELECT id, cx, cy, r / 2, shape, category, 0e0, CAST(5 AS BIGINT), '20240102' FROM ({X.BLOCK_SQL}) b WHERE id % 13 = 0
) t
"""
AREA_DAY_SQL = f"""
SELECT id, cx, cy, CASE WHEN day = 2 AND id % 20 = 2 THEN r + 0.0003e0 ELSE r END AS r, shape, day, {CODE} AS code
FROM ({X.AREA_SQL}) a, (VALUES (1), (2)) v(day) WHERE id % 20 <> day - 1
"""
TODAY = "20240102"
REL = f"rel AS ({X.for_oracle(RELEASE_SQL)})"


def release(spark, sf):
    d = X.run(spark, sf, RELEASE_SQL)
    return d.select("shadow_id", X.outline_wkt().alias("polygon"), "area", "heat", "category", "code", "dt")


def old_new(spark, sf):
    r = release(spark, sf)
    by = [F.col("area"), F.col("heat")]
    old = N.latest_by(N.previous_partition(r, "dt", TODAY), "shadow_id", by)
    new = N.latest_by(R.min_heat(r.where(F.col("dt") == TODAY), 3), "shadow_id", by)
    return old, new


def area_day(spark, sf, day):
    d = X.run(spark, sf, AREA_DAY_SQL).where(F.col("day") == day)
    return d.select("id", "code", X.outline_wkt().alias("polygon"))


@query
def latest_previous(spark, sf):
    p = N.previous_partition(release(spark, sf), "dt", TODAY)
    return p.select("shadow_id", "category", "heat", "dt", G.rnd(F.col("area"), 2).alias("area"))


ORACLE["latest_previous"] = f"""WITH {REL} SELECT shadow_id, category, heat, dt, {X.r_sql('area', 2)} AS area FROM rel WHERE dt = (SELECT max(dt) FROM rel WHERE dt < '{TODAY}')"""


@query
def dedup_latest(spark, sf):
    """One row per id and day, the largest."""
    d = N.latest_by(release(spark, sf).where(F.col("dt") == TODAY), "shadow_id", [F.col("area"), F.col("heat")])
    return d.select("shadow_id", "category", "heat", "code", G.rnd(F.col("area"), 2).alias("area"))


def _dedup_sql(where: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shadow_id ORDER BY area DESC, heat DESC) AS nums FROM rel WHERE {where}) t WHERE nums = 1"


ORACLE["dedup_latest"] = f"""WITH {REL} SELECT shadow_id, category, heat, code, {X.r_sql('area', 2)} AS area FROM ({_dedup_sql("dt = '" + TODAY + "'")}) d"""
OLD_NEW = f"""{REL}, o AS ({_dedup_sql("dt = (SELECT max(dt) FROM rel WHERE dt < '" + TODAY + "')")}), n AS ({_dedup_sql("dt = '" + TODAY + "' AND heat >= 3")})"""


@query
def release_full_outer(spark, sf):
    m = N.merge_snapshots(*old_new(spark, sf), "shadow_id")
    return m.select("shadow_id", "category", "heat", "code", "dt", "origin", G.rnd(F.col("area"), 2).alias("area"))


ORACLE["release_full_outer"] = f"""WITH {OLD_NEW}
SELECT coalesce(o.shadow_id, n.shadow_id) AS shadow_id, coalesce(o.category, n.category) AS category, coalesce(o.heat, n.heat) AS heat, coalesce(o.code, n.code) AS code,
  coalesce(o.dt, n.dt) AS dt, CAST(CASE WHEN o.shadow_id IS NULL THEN 1 WHEN n.shadow_id IS NULL THEN 2 ELSE 3 END AS BIGINT) AS origin, {X.r_sql('coalesce(o.area, n.area)', 2)} AS area
FROM o FULL OUTER JOIN n ON o.shadow_id = n.shadow_id"""


@query
def change_log(spark, sf):
    """Areas added (1), removed (2) or changed (3) between two days, with the outline still known."""
    log = N.change_log(area_day(spark, sf, 1), area_day(spark, sf, 2), "id", "polygon")
    s = S.shapes(log, "id", "polygon", ["code", "change_type"])
    return s.select(F.col("id").alias("aoi_id"), "code", "change_type", G.rnd(F.col("area") * 1e10, 2).alias("area_e10"))


ADAY = f"ad AS ({X.for_oracle(AREA_DAY_SQL)})"
LOG = f"""{ADAY}, cl AS (SELECT coalesce(b.id, a.id) AS id, coalesce(b.code, a.code) AS code, coalesce(b.cx, a.cx) AS cx, coalesce(b.cy, a.cy) AS cy, coalesce(b.r, a.r) AS r, coalesce(b.shape, a.shape) AS shape,
  CAST(CASE WHEN a.id IS NULL THEN 1 WHEN b.id IS NULL THEN 2 ELSE 3 END AS BIGINT) AS change_type
  FROM (SELECT * FROM ad WHERE day = 1) a FULL OUTER JOIN (SELECT * FROM ad WHERE day = 2) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.r <> b.r)"""
ORACLE["change_log"] = f"""WITH {LOG}, {X.edges_cte('cle', 'cl')}, {X.box_cte('clb', 'cle')}
SELECT cl.id AS aoi_id, code, change_type, {X.r_sql('area * 1e10', 2)} AS area_e10 FROM cl JOIN clb ON clb.id = cl.id"""


@query
def novelty(spark, sf):
    """Largest overlap of every new piece with the old release, and whether it is accepted."""
    old, new = old_new(spark, sf)
    fresh = new.join(old, "shadow_id", "left_anti")
    r = N.max_overlap_ratio(S.shapes(fresh, "shadow_id", "polygon"), S.shapes(old, "shadow_id", "polygon"))
    return r.select(F.col("id").alias("shadow_id"), G.rnd(F.col("ratio"), 5).alias("ratio"), (F.round("ratio", 9) < 0.1).alias("accepted"))


NOVEL = f"""{OLD_NEW}, fr AS (SELECT shadow_id AS id, cx, cy, r, shape FROM n WHERE shadow_id NOT IN (SELECT shadow_id FROM o)), ol AS (SELECT shadow_id AS id, cx, cy, r, shape FROM o),
{X.edges_cte('fe', 'fr')}, {X.box_cte('fb', 'fe')}, {X.edges_cte('oe', 'ol')}, {X.box_cte('ob', 'oe')}, {X.overlap_ctes('fe', 'fb', 'oe', 'ob')},
nr AS (SELECT fr.id, coalesce(max(CASE WHEN {X.MEETS} THEN inter / l_area END), 0e0) AS ratio FROM fr LEFT JOIN hit ON hit.l_id = fr.id GROUP BY fr.id)"""
ORACLE["novelty"] = f"WITH {NOVEL} SELECT id AS shadow_id, {X.r_sql('ratio', 5)} AS ratio, round(ratio, 9) < 0.1e0 AS accepted FROM nr"


@query
def covered_drop(spark, sf):
    """Areas left after dropping those contained in, or over 95 % covered by, another."""
    return N.drop_covered(S.shapes(X.areas(spark, sf), "id", "polygon")).select(F.col("id").alias("aoi_id"))


ORACLE["covered_drop"] = f"""
WITH a AS ({X.for_oracle(X.AREA_SQL)}), {X.edges_cte('ae', 'a')}, {X.box_cte('ab', 'ae')}, {X.overlap_ctes('ae', 'ab', 'ae', 'ab', 'l.id <> r.id')}
SELECT id AS aoi_id FROM a WHERE id NOT IN (SELECT l_id FROM hit WHERE {X.MEETS} AND inter / l_area > 0.95e0 AND NOT (inter / r_area > 0.95e0 AND l_id < r_id))"""


def changed_areas(spark, sf):
    log = N.change_log(area_day(spark, sf, 1), area_day(spark, sf, 2), "id", "polygon").where("change_type IN (1, 3)")
    return S.shapes(log, "id", "polygon", ["code"])


@query
def trim_changed(spark, sf):
    """Old pieces with over 10 % under a changed area of the same region: cells of the largest part left."""
    old, _ = old_new(spark, sf)
    p = S.shapes(old, "shadow_id", "polygon", ["code"])
    t = N.trim_changed(p, changed_areas(spark, sf), CELL)
    return t.groupBy(F.col("id").alias("shadow_id")).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))


TRIM = f"""{OLD_NEW}, {LOG}, ol AS (SELECT shadow_id AS id, cx, cy, r, shape, code FROM o), ca AS (SELECT * FROM cl WHERE change_type IN (1, 3)),
{X.edges_cte('oe', 'ol')}, {X.box_cte('ob', 'oe')}, {X.edges_cte('ce', 'ca')}, {X.box_cte('cb', 'ce')}, {X.overlap_ctes('oe', 'ob', 'ce', 'cb')},
tp AS (SELECT l_id, r_id FROM hit JOIN ol ON ol.id = l_id JOIN ca ON ca.id = r_id WHERE ol.code = ca.code AND inter / l_area > 0.1e0),
tb AS (SELECT * FROM ob WHERE id IN (SELECT l_id FROM tp)), {_cells_sql('mine', 'tb', 'oe')}, {_cells_sql('cuts', 'cb', 'ce')},
rest AS (SELECT m.* FROM mine m WHERE NOT EXISTS (SELECT 1 FROM tp JOIN cuts c ON c.id = tp.r_id WHERE tp.l_id = m.id AND c.ix = m.ix AND c.iy = m.iy)),
{_runs_sql('rest', 'id', 'tr')}, sz AS (SELECT id, label, sum(x1 - x0 + 1) AS n FROM tr GROUP BY 1, 2)"""
ORACLE["trim_changed"] = f"WITH RECURSIVE {TRIM} SELECT id AS shadow_id, CAST(max(n) AS BIGINT) AS n FROM sz GROUP BY 1"


def trimmed_outlines(pieces, changed):
    """(id, polygon) of the pieces that lost cells to changed areas."""
    runs = N.trim_changed(pieces, changed, CELL).withColumn("part", F.lit(1))
    return L.as_polygons(runs, ["id"], "part", CELL)


@query
def trim_outlines(spark, sf):
    """Old pieces cut by changed areas, as polygon text and read back from it: points, area, outline, square metres."""
    old, _ = old_new(spark, sf)
    t = trimmed_outlines(S.shapes(old, "shadow_id", "polygon", ["code"]), changed_areas(spark, sf))
    return B.measured(t, ["id"]).withColumnRenamed("id", "shadow_id").drop("polygon")


LARGEST = f"""{TRIM}, big AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM sz) t WHERE r = 1),
kept AS (SELECT t.id, iy, unnest(range(x0, x1 + 1)) AS ix FROM tr t JOIN big b ON b.id = t.id AND b.label = t.label)"""
ORACLE["trim_outlines"] = f"""WITH RECURSIVE {LARGEST}, {B.outline_sql('kept', 'id', 'ln')}
SELECT id AS shadow_id, n_points, area_e10, perimeter, area_m2 FROM ln"""


@query
def release_days(spark, sf):
    """Cut outlines released as a table by day: created if absent, one day written twice, read back by name and range of days."""
    old, _ = old_new(spark, sf)
    t = trimmed_outlines(S.shapes(old, "shadow_id", "polygon", ["code"]), changed_areas(spark, sf))
    t = stage(B.measured(t, ["id"]).withColumnRenamed("id", "shadow_id"), "outlines")
    name = f"release_{uuid.uuid4().hex}"
    schema = T.StructType([f for f in t.schema.fields if f.name in ("shadow_id", "polygon", "n_points", "area_m2")])
    for _ in range(2):
        C.ensure_table(spark, name, schema)
    for dt, keep in (("20240101", F.lit(True)), ("20240102", F.lit(True)), ("20240101", F.col("shadow_id") % 2 == 0)):
        C.write_day(t.where(keep), name, dt)
    d = C.read_days(spark, name, "20240101", "20240102")
    m2 = G.rnd(G.geodesic_area(G.edges_of(G.parse_polygon(F.col("polygon")))), 2)
    return d.select("dt", "shadow_id", "n_points", "area_m2", (m2 == F.col("area_m2")).alias("same"))


ORACLE["release_days"] = f"""WITH RECURSIVE {LARGEST}, {B.outline_sql('kept', 'id', 'ln')}
SELECT dt, id AS shadow_id, n_points, area_m2, TRUE AS same FROM ln, (VALUES ('20240101'), ('20240102')) v(dt) WHERE dt = '20240102' OR id % 2 = 0"""


@query
def release_next(spark, sf):
    """Today's release: old pieces and accepted new ones, changed areas cut out, area in cells of 0.00041 degrees."""
    old, new = old_new(spark, sf)
    o = S.shapes(old, "shadow_id", "polygon", ["code", "category"])
    fresh = S.shapes(new.join(old, "shadow_id", "left_anti"), "shadow_id", "polygon", ["code", "category"])
    every = stage(o.unionByName(N.keep_novel(fresh, o)), "release")
    cut = N.trim_changed(every, changed_areas(spark, sf), CELL)
    cut = cut.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("nc"))
    whole = O.polyfill_runs(every, CELL).groupBy("id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n0"))
    r = every.join(whole, "id").join(cut, "id", "left")
    return r.select(F.col("id").alias("shadow_id"), "code", "category", F.coalesce("nc", "n0").alias("n"), F.col("nc").isNotNull().alias("trimmed"))


@query
def changed_shape(spark, sf):
    """Whether an edited outline (moved, or left alone) differs from the original by IoU < 0.99."""
    d = X.run(spark, sf, X.BLOCK_SQL)
    edit = F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, 0.001).otherwise(0.000001)

    def text(dx):
        r = F.col("r")
        c = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
        pts = F.array(*[G.xy(F.col("cx") + r * x + dx, F.col("cy") + r * y) for x, y in c])
        few = F.slice(pts, 1, 3)
        return G.points_to_text(F.when(F.col("id") % 9 == 4, few).otherwise(pts))

    d = d.select("id", text(F.lit(0.0)).alias("polygon_str"), text(edit).alias("fix_polygon_str"))
    c = N.changed_shape(d, "id", "polygon_str", "fix_polygon_str")
    return c.select("id", G.rnd(F.coalesce("iou", F.lit(-1.0)), 5).alias("iou"), "changed")


ORACLE["changed_shape"] = f"""
WITH b AS ({X.for_oracle(X.BLOCK_SQL)}), s AS (SELECT id, 2 * r AS w, CASE id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.001e0 ELSE 0.000001e0 END AS dx FROM b),
i AS (SELECT id, CASE WHEN id % 9 = 4 THEN NULL ELSE (w - dx) * w / (2 * w * w - (w - dx) * w) END AS iou FROM s)
SELECT id, {X.r_sql('coalesce(iou, -1e0)', 5)} AS iou, coalesce(iou < 0.99e0, FALSE) AS changed FROM i"""
