"""Places of periods: projection, label slots, counts, audits, nested export."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_of
from ..session import fresh_path
from .groups import argmax
from .ranges import running

TIERS = ["capital", "secondary", "city", "town"]


def tier_rank(c: Column) -> Column:
    out = F.lit(len(TIERS) - 1)
    for i, t in enumerate(TIERS[:-1]):
        out = F.when(c == t, i).otherwise(out)
    return out.cast("long")


def project_places(df: DataFrame, k: float = math.cos(math.radians(35.0)), scale: float = 9.0) -> DataFrame:
    """Add map position ``px, py`` and the label without its bracket."""
    return df.withColumn("px", F.col("lng") * k * scale).withColumn("py", -F.col("lat") * scale).withColumn("label", label_of(F.col("display")))


def label_slots(df: DataFrame, cell_px: int = 32) -> DataFrame:
    """Mark the best-ranked place (ties: smallest id) of every map cell and period as shown.

    The winners come from an aggregate, so a crowded cell is reduced before it is shuffled.
    """
    d = df.withColumn("cell", F.struct("period", F.floor(F.col("px") / cell_px).alias("x"), F.floor(F.col("py") / cell_px).alias("y")))
    d = d.withColumn("rk", tier_rank(F.col("tier")))
    top = argmax(d, "cell", [-F.col("rk"), -F.col("id")], ["cell", "id"]).select("id", F.lit(True).alias("_s"))
    return d.join(top, "id", "left").withColumn("shown", F.coalesce("_s", F.lit(False))).drop("_s", "cell", "rk")


def count_places(df: DataFrame) -> DataFrame:
    return df.rollup("period").agg(F.count("*").alias("n")).select(F.coalesce("period", F.lit(-1)).alias("period"), "n")


def duplicate_places(df: DataFrame, coords: list[str], name: str) -> DataFrame:
    a = df.groupBy("period", *coords).agg(F.count("*").alias("n")).where("n > 1")
    b = df.groupBy("period", name).agg(F.count("*").alias("n")).where("n > 1")
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in coords])
    return a.select("period", F.lit("coordinates").alias("kind"), text.alias("value"), "n").unionByName(
        b.select("period", F.lit("name").alias("kind"), F.col(name).alias("value"), "n"))


def nest_by(df: DataFrame, key: str, item_cols: list[str], per_row: int = 10000) -> DataFrame:
    """Nested rows ``(key, chunk, items)``: chunk 0 holds the first ``per_row`` items of a key, chunk 1 the next, and so on.

    Items are in order within and across chunks, and no task holds a whole hot key.
    """
    d = running(df.select(key, *item_cols, F.lit(1).cast("long").alias("_one")), [key], item_cols, {"_place": "_one"})
    d = d.withColumn("chunk", F.floor((F.col("_place") - 1) / per_row))
    return d.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct(*item_cols))).alias("items"))


def nested_round_trip(df: DataFrame, key: str, item_cols: list[str]) -> DataFrame:
    """Write the nested rows as JSON to the shared folder and read them back."""
    nested = nest_by(df, key, item_cols)
    path = fresh_path(df.sparkSession, "nested")
    nested.write.json(path)
    return df.sparkSession.read.schema(nested.schema).json(path)
