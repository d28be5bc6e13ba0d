"""Running sums over ordered rows of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running sums per key in a total order, without gathering a key: ``sums`` maps new columns to summed ones.

    Rows are range-partitioned by key and order; a row adds its sum inside the partition to the totals of the same key
    in earlier partitions. A null key is a key like any other; without keys the sums run over all rows.
    """
    d = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    d = stage(d, "ranges")
    totals = d.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()])
    same = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys] + [F.col("d._part") == F.col("t._part")]
    d = d.alias("d").join(totals.alias("t"), same)
    return d.select(*[F.col(f"d.`{c}`") for c in df.columns], *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
