"""Cell ids of points: geohash, map tiles, pixel grids. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import LAT_PER_METER, LNG_PER_METER, xy

# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _bits(precision: int) -> tuple[int, int]:
    lon = (5 * precision + 1) // 2
    return lon, 5 * precision - lon


def _quantise(v: Column, low: float, span: float, bits: int) -> Column:
    q = F.floor((v - low) / span * float(1 << bits))
    return F.least(F.greatest(q, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def geohash_ints(lat: Column, lng: Column, precision: int) -> tuple[Column, Column]:
    """Quantised (longitude, latitude) pair of the cell."""
    lon_bits, lat_bits = _bits(precision)
    wrapped = F.pmod(lng + 180.0, F.lit(360.0))
    return _quantise(wrapped, 0.0, 360.0, lon_bits), _quantise(lat, -90.0, 180.0, lat_bits)


def geohash_from_ints(lon: Column, lat: Column, precision: int) -> Column:
    lon_bits, lat_bits = _bits(precision)
    chars = []
    for i in range(precision):
        value = None
        for j in range(5):
            k = 5 * i + j
            src, top = (lon, lon_bits) if k % 2 == 0 else (lat, lat_bits)
            bit = F.shiftright(src, top - 1 - k // 2).bitwiseAND(F.lit(1))
            term = F.shiftleft(bit, 4 - j)
            value = term if value is None else value + term
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lat: Column, lng: Column, precision: int = 12) -> Column:
    return geohash_from_ints(*geohash_ints(lat, lng, precision), precision)


def geohash_decode_ints(code: Column) -> Column:
    """struct<lon, lat, lon_bits, lat_bits> of a geohash of any length."""
    zero = F.struct(F.lit(0).cast("long").alias("lon"), F.lit(0).cast("long").alias("lat"))

    def bit(t, n, to):
        return F.shiftleft(F.shiftright(t, n).bitwiseAND(F.lit(1)), to).cast("long")

    def step(acc, i):
        t = F.instr(F.lit(BASE32), F.substring(code, i, F.lit(1))) - 1
        even = i % 2 == 1  # characters count from 1
        three = bit(t, 4, 2) + bit(t, 2, 1) + bit(t, 0, 0)
        two = bit(t, 3, 1) + bit(t, 1, 0)
        return F.struct(
            F.when(even, F.shiftleft(acc["lon"], 3) + three).otherwise(F.shiftleft(acc["lon"], 2) + two).alias("lon"),
            F.when(even, F.shiftleft(acc["lat"], 2) + two).otherwise(F.shiftleft(acc["lat"], 3) + three).alias("lat"),
        )

    n = F.length(code)
    lon_bits = F.floor((n * 5 + 1) / 2).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), n), zero, step,
        lambda a: F.struct(a["lon"], a["lat"], lon_bits.alias("lon_bits"), (n * 5 - lon_bits).alias("lat_bits")),
    )


def geohash_bbox(code: Column) -> Column:
    """struct<w, s, e, n>. Decode into a column first when several fields are needed."""
    return F.transform(
        F.array(geohash_decode_ints(code)),
        lambda d: F.struct(
            (d["lon"] * 360.0 / F.pow(F.lit(2.0), d["lon_bits"]) - 180.0).alias("w"),
            (d["lat"] * 180.0 / F.pow(F.lit(2.0), d["lat_bits"]) - 90.0).alias("s"),
            ((d["lon"] + 1) * 360.0 / F.pow(F.lit(2.0), d["lon_bits"]) - 180.0).alias("e"),
            ((d["lat"] + 1) * 180.0 / F.pow(F.lit(2.0), d["lat_bits"]) - 90.0).alias("n"),
        ),
    )[0]


def geohash_neighbors(code: Column, precision: int) -> Column:
    """The up to 8 neighbours; longitudes wrap, none beyond the poles."""
    lon_bits, lat_bits = _bits(precision)
    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]

    def near(d):
        out = []
        for dx, dy in around:
            lon = F.pmod(d["lon"] + dx, F.lit(1 << lon_bits)).cast("long")
            lat = d["lat"] + dy
            ok = (lat >= 0) & (lat < (1 << lat_bits))
            out.append(F.when(ok, geohash_from_ints(lon, lat, precision)))
        return F.filter(F.array(*out), lambda c: c.isNotNull())

    return F.transform(F.array(geohash_decode_ints(code)), near)[0]


def tile(lng: Column, lat: Column, zoom: int = 18) -> Column:
    """Web-mercator tile struct<x, y> of a point."""
    n = float(1 << zoom)
    tx = (lng + 180.0) / 360.0 * n
    ty = (F.lit(1.0) - F.log(F.tan(F.radians(lat)) + F.lit(1.0) / F.cos(F.radians(lat))) / F.pi()) / 2.0 * n
    return F.struct(F.floor(tx).cast("long").alias("x"), F.floor(ty).cast("long").alias("y"))


def tile_center(x: Column, y: Column, zoom: int = 18) -> Column:
    """Upper left corner of a tile as struct<x: lng, y: lat>, the inverse of ``tile``."""
    n = float(1 << zoom)
    return xy(x / n * 360.0 - 180.0, F.atan(F.sinh(F.pi() * (F.lit(1.0) - y * 2.0 / n))) * 180.0 / F.pi())


def tile_pack(x: Column, y: Column, zoom: Column | int) -> Column:
    """Zoom, x and y in one long: the join key of a tile."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.shiftleft(z.cast("long"), 56).bitwiseOR(F.shiftleft(x.cast("long"), 28)).bitwiseOR(y.cast("long"))


def tile_unpack(key: Column) -> Column:
    low = F.lit((1 << 28) - 1)
    return F.struct(
        F.shiftright(key, 56).alias("zoom"), F.shiftright(key, 28).bitwiseAND(low).alias("x"), key.bitwiseAND(low).alias("y")
    )


def tile_parent(x: Column, y: Column, up: int = 1) -> Column:
    return F.struct(F.shiftright(x, up).alias("x"), F.shiftright(y, up).alias("y"))


def tile_text(x: Column, y: Column, zoom: int) -> Column:
    """String form of a tile id."""
    return F.concat_ws("/", F.lit(str(zoom)), x.cast("string"), y.cast("string"))


def _steps(v: Column, mid: Column, per_metre: float, pixel: float) -> Column:
    gap = F.ceil(F.abs(v - mid) / (pixel * per_metre) - 0.5).cast("long")
    return F.when(v > mid, gap).otherwise(-gap)


def pixel_index(lng: Column, lat: Column, box, rows: int, cols: int, pixel: float = 1.0) -> Column:
    """struct<row, col> in a rows x cols grid centred on the box; null outside."""
    xmin, ymin, xmax, ymax = box
    r = _steps(lat, (ymin + ymax) / 2, LAT_PER_METER, pixel) + rows // 2
    c = _steps(lng, (xmin + xmax) / 2, LNG_PER_METER, pixel) + cols // 2
    inside = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
    return F.when(inside, F.struct(r.alias("row"), c.alias("col")))


def pixel_to_lnglat(row: Column, col: Column, box, rows: int, cols: int) -> Column:
    """Coordinates of a pixel as struct<x, y>, (-1, -1) outside the grid."""
    xmin, ymin, xmax, ymax = box
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    x = (xmin + xmax) / 2 - (F.lit(cols // 2) - col) * LNG_PER_METER
    y = (ymin + ymax) / 2 - (F.lit(rows // 2) - row) * LAT_PER_METER
    return xy(F.when(inside, x).otherwise(-1.0), F.when(inside, y).otherwise(-1.0))
