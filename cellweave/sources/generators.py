"""Synthetic tables as column expressions over a range or any key column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers of the 20 features: the primes from 7919 upward.
PRIMES = [7919, 7927, 7933, 7937, 7949, 7951, 7963, 7993, 8009, 8011, 8017, 8039, 8053, 8059, 8069, 8081, 8087, 8089, 8093, 8101]
FEATURES = [f"feature_{i}" for i in range(20)]


def _draw(k: Column, p: int, m: int) -> Column:
    return (k * p) % m


def synthetic_rows(keys: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Random text of 10 ideographs, 3 small integers, 10 floats in 0..10 and two labels per key."""
    k = F.col(key) + seed
    # Code points 4E00 to 9FA5.
    text = F.array_join(F.array(*[F.expr(f"decode(unhex(lpad(hex(19968 + (({key} + {seed}) * {p}) % 20902), 4, '0')), 'UTF-16BE')") for p in PRIMES[:10]]), "")
    ints = [_draw(k, PRIMES[10 + i], 5).alias(f"spare_f_{i + 1}") for i in range(3)]
    floats = [(_draw(k, PRIMES[i], 10007) / 1000.7).alias(f"dense_f_{i + 1}") for i in range(10)]
    return keys.select(key, text.alias("npl_f"), *ints, *floats, _draw(k, 8111, 2).alias("class_label"), (_draw(k, 8117, 10007) / 100.07).alias("regress_label"))


def synthetic_range(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return synthetic_rows(spark.range(n), "id", seed)


def synthetic_train(keys: DataFrame, key: str, noise: bool = True) -> DataFrame:
    """20 features in 0..100 and a label drawn by rule, a tenth of them flipped."""
    k = F.col(key)
    d = keys.select(key, *[((k * p) % 10000 / 100.0).alias(f) for p, f in zip(PRIMES, FEATURES)])
    d = d.withColumn("score", rule_score([F.col(f) for f in FEATURES]))
    u = (k * 99991) % 10007 / 10007.0
    label = (u < rule_probability(F.col("score"))).cast("int")
    if noise:
        label = F.when((k * 7927) % 10 == 0, 1 - label).otherwise(label)
    return d.withColumn("label", label)


def _mean(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / len(cols)


def rule_score(f: list[Column]) -> Column:
    """Score of the labelling rule over 20 feature columns."""
    front, middle, back = f[:5], f[5:10], f[10:20]
    high = sum((F.when(c > 60, 1).otherwise(0) for c in front[1:]), F.when(front[0] > 60, 1).otherwise(0))
    front_part = F.when((_mean(front) > 50) & (high >= 3), 0.4).when(_mean(front) > 65, 0.3).otherwise(0.0)
    middle_part = F.when(_mean(middle) < 30, 0.3).when(_mean(middle) < 45, 0.15).otherwise(0.0)
    m = _mean(back)
    variance = _mean([(c - m) * (c - m) for c in back])
    spread = F.greatest(*back) - F.least(*back)
    back_part = F.when(variance > 35, -0.2).when(spread > 60, -0.1).otherwise(0.0)
    pairs = F.when((f[0] > 70) & (f[5] < 20), 0.2).otherwise(0.0) + F.when((f[15] > 80) & (f[16] > 80), -0.15).otherwise(0.0)
    return front_part + middle_part + back_part + pairs


def rule_probability(score: Column) -> Column:
    return F.lit(1.0) / (F.exp(score * -2.0) + 1.0)
