"""Outlines from text: WKT, point lists, GeoJSON, free text; validity and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import each

KINDS = ["polygon", "linestring", "point", "linearring", "multipoint"]
NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
# GeoJSON geometries differ in the depth of their coordinates, so these are kept as text first.
_GEOMETRY = "struct<type: string, coordinates: string>"
_WRAPPED = f"struct<type: string, coordinates: string, geometry: {_GEOMETRY}, geometries: array<{_GEOMETRY}>, features: array<struct<geometry: {_GEOMETRY}>>>"


def split_valid(df: DataFrame, id_col: str, wkt_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid outline (``rings``), and the others with their text."""
    d = df.withColumn("_r", F.array(G.parse_polygon(F.col(wkt_col))))
    keep = F.filter("_r", lambda r: G.is_valid_rings(F.col(wkt_col), r))
    good = each(d, df.columns, keep, "rings").drop(wkt_col)
    ok = G.is_valid_rings(F.col(wkt_col), F.col("_r")[0])
    return good, d.where(~F.coalesce(ok, F.lit(False))).drop("_r")


def explode_rings(df: DataFrame, id_col: str, wkt_col: str) -> DataFrame:
    """One row per ring: ``id, part, ring, pts``."""
    r = each(df, [F.col(id_col).alias("id")], G.parse_polygon(F.col(wkt_col)), "r")
    return r.select("id", "r.part", "r.ring", "r.pts")


def _part_area(rings: Column, part: Column) -> Column:
    own = F.filter(rings, lambda r: r["part"] == part)
    return F.aggregate(own, F.lit(0.0), lambda s, r: s + F.abs(G.signed_area(r["pts"])) * F.when(r["ring"] == 0, 1.0).otherwise(-1.0))


def largest_part(rings: Column) -> Column:
    """Rings of the part with the largest area (ties: the first), renumbered as part 1."""
    numbers = F.sequence(F.lit(1), F.array_max(F.transform(rings, lambda r: r["part"])))
    sized = F.transform(numbers, lambda i: F.struct(_part_area(rings, i).alias("a"), (-i).alias("neg")))
    best = -F.array_max(sized)["neg"]
    return F.transform(F.filter(rings, lambda r: r["part"] == best), lambda r: F.struct(F.lit(1).alias("part"), r["ring"], r["pts"]))


def drop_holes(rings: Column) -> Column:
    return F.filter(rings, lambda r: r["ring"] == 0)


def is_simple(rings: Column) -> Column:
    """One part, no hole."""
    return F.size(rings) == 1


def view_box(shapes: DataFrame, pad: float) -> DataFrame:
    """Overall box, grown on every side by a share of its size."""
    b = shapes.agg(F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1"))
    w, h = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    return b.select((F.col("x0") - w).alias("xmin"), (F.col("y0") - h).alias("ymin"), (F.col("x1") + w).alias("xmax"), (F.col("y1") + h).alias("ymax"))


def ingest_coords(df: DataFrame, id_col: str, col: str, kind_col: str) -> DataFrame:
    """Point text by kind: polygons and rings are closed, a point is the first pair. Adds ``pts`` and ``text``."""
    d = each(df, [F.col(id_col).alias("id"), F.col(kind_col).alias("kind")], F.array(G.parse_points(F.col(col))), "p")
    pts = F.when(F.col("kind").isin("polygon", "linearring"), G.close_points(F.col("p"))).when(F.col("kind") == "point", F.slice("p", 1, 1)).otherwise(F.col("p"))
    return d.select("id", "kind", pts.alias("pts")).withColumn("text", G.points_to_text(F.col("pts")))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda v: v.try_cast("double"))


def _pairs(text: Column) -> Column:
    """Consecutive numbers paired to points, longitudes normalised."""
    def pair(n):
        return F.when(F.size(n) >= 2, F.transform(
            F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1),
            lambda i: G.xy(G.norm_lon(F.get(n, i * 2)), F.get(n, i * 2 + 1)),
        )).otherwise(F.array().cast("array<struct<x: double, y: double>>"))

    return F.transform(F.array(_numbers(text)), pair)[0]


def geojson_geometries(col: Column) -> Column:
    """All geometries of a GeoJSON text as array<struct<type, coordinates>>; empty when it is not GeoJSON."""
    def collect(o):
        bare = F.when(o["coordinates"].isNotNull(), F.array(F.struct(o["type"].alias("type"), o["coordinates"].alias("coordinates"))))
        one = F.when(o["geometry"].isNotNull(), F.array(o["geometry"]))
        many = F.transform(o["features"], lambda f: f["geometry"])
        return F.coalesce(many, o["geometries"], one, bare, F.array().cast(f"array<{_GEOMETRY}>"))

    return F.transform(F.array(F.from_json(col, _WRAPPED)), collect)[0]


def ingest_geojson(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """``id, geom, type, kind, ring, pts``: one row per point set, line or ring of the six types.

    Rings with fewer than 3 points and lines with fewer than 2 are dropped.
    """
    g = each(df, [F.col(id_col).alias("id")], geojson_geometries(F.col(col)), "g", pos="geom")
    # Lines and rings are the innermost lists of positions.
    flat = F.regexp_extract_all(F.col("g.coordinates"), F.lit(r"(\[\s*\[\s*[^\[\]]+\](?:\s*,\s*\[[^\[\]]+\])*\s*\])"), F.lit(1))
    lists = F.when(F.col("g.type").isin("Point", "MultiPoint"), F.array("g.coordinates")).otherwise(flat)
    r = each(g, ["id", "geom", F.col("g.type").alias("type")], lists, "c", pos="ring")
    kind = F.when(F.col("type").endswith("Point"), "point").when(F.col("type").endswith("LineString"), "line").otherwise("poly")
    r = r.select("id", "geom", "type", kind.alias("kind"), "ring", _pairs(F.col("c")).alias("pts"))
    least = F.when(F.col("kind") == "poly", 3).when(F.col("kind") == "line", 2).otherwise(1)
    return r.where(F.size("pts") >= least)


def ingest_text(df: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    """Free text to ``id, kind, pts``: GeoJSON by its own types, otherwise every bracketed group
    (or the whole text) read as number pairs of the given kind ('point', 'line' or 'poly')."""
    is_json = F.size(geojson_geometries(F.col(col))) > 0
    least = {"point": 1, "line": 2, "poly": 3}[kind]
    plain = df.where(~is_json).select(F.col(id_col).alias("id"), F.col(col).alias("t"))
    groups = F.regexp_extract_all("t", F.lit(r"\(([^()]*)\)"), F.lit(1))
    plain = each(plain, ["id"], F.when(F.size(groups) > 0, groups).otherwise(F.array("t")), "c")
    plain = plain.select("id", F.lit(kind).alias("kind"), _pairs(F.col("c")).alias("pts")).where(F.size("pts") >= least)
    return plain.unionByName(ingest_geojson(df.where(is_json), id_col, col).select("id", "kind", "pts"))
