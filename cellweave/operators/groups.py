"""Filters, grouped counts and arg-max operators shared by the daily jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import geometry as G
from . import points as P
from . import spatial as S


def valid_activity(df: DataFrame) -> DataFrame:
    return df.where("is_dau = 1 AND user_id > 0 AND lng > 0 AND lat > 0")


def not_category(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    return df.where(~F.col(col).isin(names))


def min_heat(df: DataFrame, heat: int = 3) -> DataFrame:
    return df.where(F.col("heat") >= heat)


def finished_orders(df: DataFrame) -> DataFrame:
    return df.where("business_type = 1 AND waybill_status = 50")


def in_set(df: DataFrame, col: str, dim: DataFrame) -> DataFrame:
    return df.join(dim.select(col).distinct(), col, "left_semi")


def swap_if(df: DataFrame, flag: str) -> DataFrame:
    """Exchange lng and lat where the flag is set."""
    return df.select(
        *[c for c in df.columns if c not in ("lng", "lat", flag)],
        F.when(F.col(flag), F.col("lat")).otherwise(F.col("lng")).alias("lng"),
        F.when(F.col(flag), F.col("lng")).otherwise(F.col("lat")).alias("lat"),
    )


def active_cells(points: DataFrame, precision: int = 6, min_events: int = 7) -> DataFrame:
    """Cells with enough events. The quantised pair is the group key: two integers, not text."""
    lon, lat = C.geohash_ints(F.col("lat"), F.col("lng"), precision)
    n = points.select(lon.alias("qx"), lat.alias("qy")).groupBy("qx", "qy").agg(F.count("*").alias("events"))
    return n.where(F.col("events") >= min_events).select(C.geohash_from_ints(F.col("qx"), F.col("qy"), precision).alias("cell"), "events")


def cells_as_shapes(cells: DataFrame, col: str) -> DataFrame:
    """Geohash cells as rectangles with the shape columns; the id is the quantised pair."""
    d = cells.select(C.geohash_decode_ints(F.col(col)).alias("d"), C.geohash_bbox(F.col(col)).alias("b"))
    ring = F.array(
        G.xy(F.col("b.w"), F.col("b.s")), G.xy(F.col("b.e"), F.col("b.s")), G.xy(F.col("b.e"), F.col("b.n")), G.xy(F.col("b.w"), F.col("b.n"))
    )
    return S.with_edges(d.select((F.col("d.lat") * F.pow(F.lit(2.0), F.col("d.lon_bits") + 1).cast("long") + F.col("d.lon")).alias("id"), G.single_ring(ring).alias("rings")))


def pixel_heat(points: DataFrame, pieces: DataFrame, rows: int, cols: int) -> DataFrame:
    """Points (x, y) per pixel of the grid around the box of the piece they lie in."""
    return P.count_pixels(points, pieces, rows, cols)


def piece_heat(points: DataFrame, pieces: DataFrame) -> DataFrame:
    return pieces.select("id").join(P.count_inside(points, pieces), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("heat"))


def argmax(df: DataFrame, key: str, by: list[Column], cols: list[str]) -> DataFrame:
    """One row per key, the greatest by ``by``. An aggregate, so a hot key is reduced on the map side."""
    rest = [c for c in cols if c != key]
    m = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])).alias("m"))
    return m.select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def kth_largest(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k-th largest value per key, equal values counted each; keys of fewer values have none.

    A filter on the row number lets Spark keep only k rows of a key in each task before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).desc()))
    return df.where(F.col(value).isNotNull()).select(key, value, place.alias("_place")).where(F.col("_place") == k).drop("_place")


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def salt(id_col: Column, n: int) -> Column:
    """A spreading number in 0..n-1 kept next to the key, never inside it."""
    return F.pmod(F.xxhash64(id_col), F.lit(n))


def stack(train: DataFrame, valid: DataFrame, split_col: str = "split") -> DataFrame:
    return train.withColumn(split_col, F.lit("train")).unionByName(valid.withColumn(split_col, F.lit("valid")))


def lookup(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their dimension values, and the rows whose key is missing."""
    return df.join(dim, key), df.join(dim.select(key), key, "left_anti")
