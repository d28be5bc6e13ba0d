"""Column functions over polygon columns.

A polygon is ``rings: array<struct<part, ring, pts: array<struct<x, y>>>>`` with open
rings (no repeated end point), ring 0 being the shell of its part. ``edges_of`` turns it
into ``array<struct<x1, y1, x2, y2>>`` running with the interior on the left, so that
holes subtract by themselves. Every measure here is local to the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0
# Metres per degree on the sphere above.
METRES_PER_DEGREE = 111319.49079327358
# Degrees per metre used for the pixel grid.
LAT_PER_METER = 8.993203677616966e-06
LNG_PER_METER = 1.1700193970443768e-05
# Ellipsoid of WGS84.
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014


def rnd(c: Column, digits: int) -> Column:
    """Round; negative zero becomes zero."""
    r = F.round(c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edge(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


# In nested lambdas an expression is written out wherever it is used, so intermediate values
# are bound by one more ``transform`` instead of being repeated.


def _points(text: Column, between: str, within: str) -> Column:
    words = F.transform(F.split(text, between), lambda p: F.split(F.trim(p), within))
    return F.transform(
        words,
        lambda w: F.struct(
            F.get(w, F.lit(0)).try_cast("double").alias("x"), F.get(w, F.lit(1)).try_cast("double").alias("y")
        ),
    )


def _tight(wkt: Column) -> Column:
    """Single blanks, and none around commas and brackets, so that plain splits suffice."""
    return F.regexp_replace(F.regexp_replace(F.trim(wkt), r"\s+", " "), r" ?([,()]) ?", "$1")


def parse_points(text: Column) -> Column:
    """``x,y;x,y`` text to an array of points."""
    return _points(text, ";", ",")


def parse_linestring(wkt: Column) -> Column:
    return _points(F.regexp_extract(_tight(wkt), r"\(([^()]*)\)", 1), ",", " ")


def open_ring(pts: Column) -> Column:
    """Drop the last point when it repeats the first one."""
    n = F.size(pts)
    return F.when((n > 1) & (F.get(pts, F.lit(0)) == F.get(pts, n - 1)), F.slice(pts, 1, n - 1)).otherwise(pts)


def close_points(pts: Column) -> Column:
    n = F.size(pts)
    return F.when((n > 0) & (F.get(pts, F.lit(0)) != F.get(pts, n - 1)), F.concat(pts, F.slice(pts, 1, 1))).otherwise(pts)


def parse_polygon(wkt: Column) -> Column:
    """POLYGON and MULTIPOLYGON text to ``rings``."""
    body = F.regexp_replace(_tight(wkt), r"^[^(]*\(+|\)+$", "")
    body = F.replace(F.replace(body, F.lit(")),(("), F.lit("#")), F.lit("),("), F.lit(";"))

    def rings_of(part, i):
        return F.transform(
            F.split(part, ";"),
            lambda r, j: F.struct((i + 1).cast("int").alias("part"), j.cast("int").alias("ring"), _points(r, ",", " ").alias("pts")),
        )

    return F.transform(
        F.flatten(F.transform(F.split(body, "#"), rings_of)),
        lambda r: F.struct(r["part"], r["ring"], open_ring(r["pts"]).alias("pts")),
    )


def single_ring(pts: Column) -> Column:
    """A simple polygon from one array of points."""
    return F.transform(F.array(pts), lambda p: F.struct(F.lit(1).alias("part"), F.lit(0).alias("ring"), open_ring(p).alias("pts")))


def is_valid_rings(wkt: Column, rings: Column) -> Column:
    """Polygon text whose coordinates all parse and whose rings have at least 3 points."""
    return (
        F.coalesce(wkt.rlike(r"^\s*(MULTI)?POLYGON\s*\("), F.lit(False))
        & F.forall(rings, lambda r: (F.size(r["pts"]) >= 3) & F.forall(r["pts"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    )


def _ring_pairs(pts: Column) -> Column:
    nxt = F.concat(F.slice(pts, 2, F.greatest(F.size(pts), F.lit(1))), F.slice(pts, 1, 1))
    return F.zip_with(pts, nxt, lambda a, b: _edge(a["x"], a["y"], b["x"], b["y"]))


def signed_area(pts: Column) -> Column:
    """Shoelace area of an open ring, positive when counter-clockwise."""
    o = F.get(pts, F.lit(0))
    return F.aggregate(
        _ring_pairs(pts),
        F.lit(0.0),
        lambda s, e: s + (e["x1"] - o["x"]) * (e["y2"] - o["y"]) - (e["x2"] - o["x"]) * (e["y1"] - o["y"]),
    ) / 2


def edges_of(rings: Column) -> Column:
    def one(r):
        raw = _ring_pairs(r["pts"])
        keep = (signed_area(r["pts"]) >= 0) == (r["ring"] == 0)
        return F.when(keep, raw).otherwise(F.transform(raw, lambda e: _edge(e["x2"], e["y2"], e["x1"], e["y1"])))

    return F.flatten(F.transform(rings, one))


def _fold(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + term(e))


def _cross(e: Column, o: Column) -> Column:
    return (e["x1"] - o["x1"]) * (e["y2"] - o["y1"]) - (e["x2"] - o["x1"]) * (e["y1"] - o["y1"])


def area(edges: Column) -> Column:
    """Planar area in squared degrees."""
    o = F.get(edges, F.lit(0))
    return _fold(edges, lambda e: _cross(e, o)) / 2


def perimeter(edges: Column) -> Column:
    return _fold(edges, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def centroid(edges: Column) -> Column:
    """Area centroid as struct<x, y>."""
    o = F.get(edges, F.lit(0))
    a6 = _fold(edges, lambda e: _cross(e, o)) * 3
    mx = _fold(edges, lambda e: ((e["x1"] - o["x1"]) + (e["x2"] - o["x1"])) * _cross(e, o))
    my = _fold(edges, lambda e: ((e["y1"] - o["y1"]) + (e["y2"] - o["y1"])) * _cross(e, o))
    return xy(o["x1"] + mx / a6, o["y1"] + my / a6)


def geodesic_area(edges: Column) -> Column:
    """Area on the ellipsoid in square metres; edges are straight in (longitude, authalic latitude)."""
    e1 = WGS84_E2 ** 0.5

    def q(lat):
        s = F.sin(F.radians(lat))
        return (1 - WGS84_E2) * (s / (1 - WGS84_E2 * s * s) + F.atanh(s * e1) / e1)

    total = _fold(edges, lambda e: (F.radians(e["x2"]) - F.radians(e["x1"])) * (q(e["y1"]) + q(e["y2"])))
    return F.abs(total) * (WGS84_A * WGS84_A / 4)


def bbox(edges: Column) -> Column:
    xs = F.transform(edges, lambda e: e["x1"])
    ys = F.transform(edges, lambda e: e["y1"])
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")
    )


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng1 - lng2) / 2), 2
    )
    return F.asin(F.sqrt(a)) * (2 * EARTH_RADIUS_M)


def points_to_text(pts: Column, digits: int | None = None, between: str = ";", within: str = ",") -> Column:
    def num(c):
        return (F.round(c, digits) if digits is not None else c).cast("string")

    return F.array_join(F.transform(pts, lambda p: F.concat(num(p["x"]), F.lit(within), num(p["y"]))), between)


def rings_to_wkt(rings: Column, digits: int = 6) -> Column:
    """WKT with closed rings; MULTIPOLYGON when there is more than one part."""

    def num(c):
        return F.round(c, digits).cast(f"decimal(20,{digits})").cast("string")

    def ring_text(r):
        pts = F.concat(r["pts"], F.slice(r["pts"], 1, 1))
        return F.concat(
            F.lit("("), F.array_join(F.transform(pts, lambda p: F.concat(num(p["x"]), F.lit(" "), num(p["y"]))), ", "), F.lit(")")
        )

    n_parts = F.array_max(F.transform(rings, lambda r: r["part"]))

    def part_text(i):
        return F.concat(
            F.lit("("), F.array_join(F.transform(F.filter(rings, lambda r: r["part"] == i), ring_text), ", "), F.lit(")")
        )

    parts = F.array_join(F.transform(F.sequence(F.lit(1), n_parts), part_text), ", ")
    return F.when(n_parts > 1, F.concat(F.lit("MULTIPOLYGON ("), parts, F.lit(")"))).otherwise(F.concat(F.lit("POLYGON "), parts))


def norm_lon(c: Column) -> Column:
    """Longitude into (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - c, F.lit(360.0))


def is_sliver(area_deg2: Column, perimeter_deg: Column, category: Column) -> Column:
    """Small or pencil-shaped remainders; three categories are always spared."""
    a10 = area_deg2 * 1e10
    thin = perimeter_deg / area_deg2 * (perimeter_deg / 20)
    small = (a10 < 500) | ((thin > 20.0 / 9.0) & (a10 <= 5000)) | ((thin > 10) & (a10 <= 100000))
    spared = F.coalesce(category.isin("居住", "办公", "商业"), F.lit(False))
    return ~spared & small & (thin > 2)


def is_compact(area_deg2: Column, perimeter_deg: Column) -> Column:
    return ~((perimeter_deg / area_deg2 * (perimeter_deg / 20) > 10) | (area_deg2 * 1e10 < 1000))


def to_gcj(lng: Column, lat: Column) -> Column:
    """WGS84 point to the shifted GCJ-02 grid, by the published formula. struct<x, y>."""
    # Krasovsky ellipsoid.
    a, ee = 6378245.0, 0.00669342162296594323
    x, y = lng - 105.0, lat - 35.0
    pi = F.lit(3.141592653589793)
    ripple = (F.sin(x * 6 * pi) * 20.0 + F.sin(x * 2 * pi) * 20.0) * 2.0 / 3.0
    dlat = (
        x * 2.0 - 100.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.2 + ripple
        + (F.sin(y * pi) * 20.0 + F.sin(y / 3.0 * pi) * 40.0) * 2.0 / 3.0
        + (F.sin(y / 12.0 * pi) * 160.0 + F.sin(y * pi / 30.0) * 320.0) * 2.0 / 3.0
    )
    dlng = (
        x + 300.0 + y * 2.0 + x * x * 0.1 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.1 + ripple
        + (F.sin(x * pi) * 20.0 + F.sin(x / 3.0 * pi) * 40.0) * 2.0 / 3.0
        + (F.sin(x / 12.0 * pi) * 150.0 + F.sin(x / 30.0 * pi) * 300.0) * 2.0 / 3.0
    )
    rad = lat / 180.0 * pi
    m = 1 - F.sin(rad) * F.sin(rad) * ee
    sm = F.sqrt(m)
    out_lat = lat + dlat * 180.0 / ((a * (1 - ee)) / (m * sm) * pi)
    out_lng = lng + dlng * 180.0 / (F.lit(a) / sm * F.cos(rad) * pi)
    outside = (lng < 72.004) | (lng > 137.8347) | (lat < 0.8293) | (lat > 55.8271)
    return xy(F.when(outside, lng).otherwise(out_lng), F.when(outside, lat).otherwise(out_lat))


def from_gcj(lng: Column, lat: Column, rounds: int = 3) -> Column:
    """Inverse shift by fixed-point iteration. Each round is a column of its own (see ``unshift``)."""
    gx, gy = lng, lat
    step = F.transform(F.array(xy(lng, lat)), lambda p: xy(p["x"], p["y"]))
    for _ in range(rounds):
        step = F.transform(
            step,
            lambda p: F.transform(
                F.array(to_gcj(p["x"], p["y"])), lambda g: xy(p["x"] + (gx - g["x"]), p["y"] + (gy - g["y"]))
            )[0],
        )
    return step[0]
