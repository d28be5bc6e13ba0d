"""Near-equal names without comparing all pairs of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuzzy_pairs(df: DataFrame, block: str, name: str, max_dist: int = 1) -> DataFrame:
    """Distinct name pairs ``(block, a, b, distance)`` at most ``max_dist`` edits apart within a block.

    Two such names have a common rest after at most ``max_dist`` characters are taken from each, so they are joined on
    these rests and then compared; equal names are folded first. Exact; the rows per name grow with its length to the
    power of ``max_dist``, never with the block.
    """
    names = df.where(F.col(name).isNotNull()).select(block, F.col(name).alias("_s")).distinct()
    level = names.select(block, "_s", F.col("_s").alias("_rest"), F.lit(1).alias("_at"))
    rests = level
    for _ in range(max_dist):
        # Characters are taken from left to right, so that each set of places comes up once.
        level = level.where(F.col("_at") <= F.length("_rest")).select(block, "_s", "_rest", F.explode(F.sequence("_at", F.length("_rest"))).alias("_at"))
        left, right = F.substring("_rest", F.lit(1), F.col("_at") - 1), F.substring("_rest", F.col("_at") + 1, F.length("_rest"))
        level = level.select(block, "_s", F.concat(left, right).alias("_rest"), "_at")
        rests = rests.unionByName(level)
    rests = rests.select(block, "_s", "_rest").distinct()
    pairs = rests.withColumnRenamed("_s", "a").join(rests.withColumnRenamed("_s", "b"), [block, "_rest"]).where("a < b").select(block, "a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b").cast("long")).where(F.col("distance") <= max_dist)
