"""Readers and writers: tables by day, delimited text, GeoJSON, packed links, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..session import each


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", dt: str | None = None, lo: str | None = None, hi: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """A stored table (parquet or ORC folder) with day and column pruning."""
    d = spark.read.format(fmt).load(path)
    if dt is not None:
        d = d.where(F.col("dt") == dt)
    if lo is not None:
        d = d.where(F.col("dt").between(lo, hi))
    return d.select(*cols) if cols else d


def overwrite_partition(df: DataFrame, path: str, dt: str, fmt: str = "parquet", schema: T.StructType | None = None) -> None:
    """Replace one day of a stored table; other days stay. Columns are cast to the schema."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    w = df.withColumn("dt", F.lit(dt)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.format(fmt).partitionBy("dt").save(path)


def copy_table(spark: SparkSession, src: DataFrame, path: str, cols: list[str]) -> DataFrame:
    src.select(*cols).write.parquet(path)
    return spark.read.parquet(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", defaults: dict | None = None) -> DataFrame:
    """Delimited text with a header; columns the files do not have are added with their defaults."""
    d = spark.read.csv(path, sep=sep, header=True, schema=schema, mode="PERMISSIVE", enforceSchema=False, quote="")
    for name, value in (defaults or {}).items():
        d = d.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in d.columns else F.lit(value))
    return d


def read_training_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Numbers separated by comma or tab; header lines and malformed rows are told by their values."""
    n = len(schema.fields)
    w = spark.read.text(path).select(F.split(F.col("value"), "[,\t]").alias("w")).where(F.size("w") == n)
    d = w.select(*[F.get("w", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])
    return d.dropna()


def read_wide(spark: SparkSession, path: str, width: int, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """Wide tab-separated text by position: only the named fields are converted."""
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    d = spark.read.csv(path, sep="\t", schema=schema, quote="")
    return d.select(*[F.col(f"_{i}").try_cast(t).alias(name) for name, (i, t) in fields.items()])


_FEATURE = "struct<type: string, properties: map<string, string>, geometry: string>"


def read_geojson(spark: SparkSession, path: str, code: str = "adcode", drop_codes: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """One row per feature: code, name, geometry (text). Features with a dropped code are left out.

    A file is one collection, or with ``lines`` one collection per line, which large inputs
    should be: only then can a file be split between tasks.
    """
    doc = spark.read.text(path, wholetext=not lines)
    f = each(doc, [], F.from_json("value", f"struct<features: array<{_FEATURE}>>")["features"], "f")
    r = f.select(F.col("f.properties")[code].alias("code"), F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["NAME"]).alias("name"), F.col("f.geometry").alias("geometry"))
    return r.where(~F.col("code").isin(*drop_codes)) if drop_codes else r


def explode_links(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Packed road links ``id&_&LINESTRING&_&json`` joined by ``&#&`` to rows ``link_id, wkt, attrs``."""
    link = each(df, keep, F.transform(F.split(col, "&#&"), lambda v: F.split(v, "&_&")), "w")
    return link.select(
        *keep, F.get("w", F.lit(0)).try_cast("long").alias("link_id"), F.get("w", F.lit(1)).alias("wkt"),
        F.from_json(F.get("w", F.lit(2)), "map<string, string>").alias("attrs"),
    )


# Road classes that count as high.
HIGH_WAYS = ["motorway", "motorway_link", "primary", "primary_link", "secondary", "secondary_link", "trunk", "trunk_link"]


def link_boxes(links: DataFrame) -> DataFrame:
    """Links with the box columns of a shape table."""
    d = links.withColumn("_p", G.parse_linestring(F.col("wkt")))
    xs, ys = F.transform("_p", lambda p: p["x"]), F.transform("_p", lambda p: p["y"])
    return d.select(*links.columns, F.col("link_id").alias("id"), F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def link_text(attrs: Column) -> Column:
    """Class, name, one-way and divider of a link as one text."""
    def at(k, default):
        return F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit(default))

    return F.concat_ws(" ", at("highway", ""), at("name", ""), at("oneway", "no"), at("divider", "no"))


def append_fixes(df: DataFrame, path: str, batch: int) -> None:
    """Append corrections (aoi_id, aoi_name, polygon_str, fix_polygon_str) with their batch number; every file has its header."""
    df.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").csv(path, sep="\t", header=True, quote="")


def apply_fixes(df: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Set ``fix_polygon_str`` and ``fix`` = 1 for corrected rows; the text of the latest batch wins per key
    (the greater text within one batch)."""
    f = fixes.groupBy(key).agg(F.max_by("fix_polygon_str", F.struct("batch", "fix_polygon_str")).alias("_new"))
    j = df.join(f, key, "left")
    done = F.col("_new").isNotNull()
    return j.select(
        *[c for c in df.columns if c not in ("fix", "fix_polygon_str")],
        F.when(done, F.col("_new")).otherwise(F.col("fix_polygon_str")).alias("fix_polygon_str"), F.when(done, 1).otherwise(F.col("fix")).cast("long").alias("fix"),
    )


def days_back(today: Column, n: int) -> Column:
    """The last n days, newest first, as yyyyMMdd text."""
    d = F.to_date(today, "yyyyMMdd")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.date_sub(d, i), "yyyyMMdd"))


def shift_day(c: Column, days: int) -> Column:
    return F.date_format(F.date_sub(F.to_date(c, "yyyyMMdd"), days), "yyyyMMdd")
