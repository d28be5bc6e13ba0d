"""Named tables of the session's catalog, partitioned by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.replace("`", "").split("."))


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None, fmt: str = "parquet") -> None:
    """Create a day-partitioned table if it is absent; its files lie in the shared folder unless a location is given.

    A table that is there must have these columns in this order.
    """
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    where = location or fresh_path(spark, name.split(".")[-1])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({cols}, dt STRING) USING {fmt} PARTITIONED BY (dt) LOCATION '{where}'")
    have = [(f.name, f.dataType) for f in spark.table(name).schema.fields if f.name != "dt"]
    if have != [(f.name, f.dataType) for f in schema.fields]:
        raise ValueError(f"table {name} has other columns: {have}")


def write_day(df: DataFrame, name: str, dt: str) -> None:
    """Replace one day of a table; other days stay, also after a failed run. Columns are taken by name and cast to the table's."""
    spark, view = df.sparkSession, f"day_{uuid.uuid4().hex}"
    fields = [f for f in spark.table(name).schema.fields if f.name != "dt"]
    df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]).createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {_quoted(name)} PARTITION (dt = '{_day(dt)}') SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def _day(dt: str) -> str:
    if not dt.isalnum():
        raise ValueError(f"not a day: {dt!r}")
    return dt


def read_days(spark: SparkSession, name: str, lo: str, hi: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """The days lo to hi (or lo alone) of a table: only their folders are read, and only the columns asked for."""
    d = spark.table(name).where(F.col("dt").between(lo, hi or lo))
    return d.select(*cols) if cols else d


def create_as(df: DataFrame, name: str, location: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A new table from a query (its columns and rows); one of that name must not exist."""
    spark, view = df.sparkSession, f"query_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        spark.sql(f"CREATE TABLE {_quoted(name)} USING {fmt} LOCATION '{location or fresh_path(spark, name.split('.')[-1])}' AS SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return spark.table(name)
