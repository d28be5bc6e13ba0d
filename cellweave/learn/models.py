"""Training and scoring with Spark ML pipelines."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import leaderboard, metrics

# Names of the 12 address scenes.
SCENES = ["零售商铺", "服务商铺", "餐饮商铺", "个人住宅", "物品递送相关场所", "医疗相关场所", "办公相关场所", "娱乐运动场所", "教育相关场所", "公共服务相关场所", "住宿相关场所", "无明确归类"]


def _scaled(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def fit_model(kind: str, df: DataFrame, features: list[str], label: str = "label", sparse: dict[str, int] | None = None, **params) -> PipelineModel:
    """Fit one of ``lr``, ``mlp``, ``gbt``, ``fm``, ``cross_lr`` behind scaled features.

    ``sparse`` names id columns and their vocabulary sizes; they are one-hot encoded.
    """
    stages = _scaled(features)
    if sparse:
        hot = [f"{c}_hot" for c in sparse]
        stages += [OneHotEncoder(inputCols=list(sparse), outputCols=hot, handleInvalid="keep"), VectorAssembler(inputCols=["features", *hot], outputCol="wide")]
    col = "wide" if sparse else "features"
    common = {"featuresCol": col, "labelCol": label}
    if kind == "lr":
        last = [LogisticRegression(**common, **{"maxIter": 20, **params})]
    elif kind == "mlp":
        last = [MultilayerPerceptronClassifier(**common, layers=[len(features), 64, 32, 2], **{"maxIter": 20, "seed": 7, **params})]
    elif kind == "gbt":
        last = [GBTClassifier(**common, **{"maxIter": 50, "stepSize": 0.1, "maxDepth": 3, "seed": 7, **params})]
    elif kind == "fm":
        last = [FMClassifier(**common, **{"factorSize": 10, "maxIter": 20, "stepSize": 0.05, "seed": 7, **params})]
    elif kind == "cross_lr":
        last = [PolynomialExpansion(inputCol=col, outputCol="cross", degree=2), LogisticRegression(**{**common, "featuresCol": "cross"}, **{"maxIter": 20, "regParam": 0.01, **params})]
    else:
        raise ValueError(kind)
    return Pipeline(stages=stages + last).fit(df)


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Scored rows with ``p``, the probability of class 1."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def compare(kinds: list[str], train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Fit every kind, evaluate on the test rows and rank: one row per model."""
    train, test = train.persist(), test.persist()
    out = None
    for kind in kinds:
        start = time.time()
        model = fit_model(kind, train, features, label)
        r = metrics(probability(model, test).select(F.lit(kind).alias("model"), F.col(label).alias("label"), "p"), "model")
        r = r.withColumn("seconds", F.lit(time.time() - start))
        out = r if out is None else out.unionByName(r)
    return leaderboard(out)


_LOW = (1 << 32) - 1


def _murmur(data: bytes, seed: int = 42) -> int:
    """The hash by which ``HashingTF`` finds a term's place."""
    h, full = seed, len(data) // 4 * 4
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _LOW
        h ^= ((k << 15 | k >> 17) & _LOW) * 0x1B873593 & _LOW
        if i < full:
            h = ((h << 13 | h >> 19) & _LOW) * 5 + 0xE6546B64 & _LOW
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _LOW
    h = (h ^ h >> 13) * 0xC2B2AE35 & _LOW
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def char_counts(n: int, dims: int, room: int = 1 << 18) -> Callable[[str], SparseVector]:
    """Counts of a text's character n-grams (up to 4 UTF-16 units, lower case) at the places of ``RegexTokenizer``, ``NGram`` and ``HashingTF``.

    A text's units are counted at once and each n-gram is hashed once a task, so no character becomes a string. Null has none.
    """
    memo: dict[int, int] = {}

    def place(code: int) -> int:
        units = [chr(code >> 16 * i & 0xFFFF) for i in reversed(range(n))]
        return _murmur(" ".join(units).encode()) % dims

    def count(text):
        u = np.frombuffer((text or "").lower().encode("utf-16-le"), "<u2").astype(np.uint64)
        u[(u >= 0xD800) & (u < 0xE000)] = ord("?")  # half a character is none
        m = max(0, len(u) - n + 1)
        code = np.zeros(m, np.uint64)
        for i in range(n):
            code = code << np.uint64(16) | u[i : m + i]
        grams, times = np.unique(code, return_counts=True)
        if len(memo) > room:
            memo.clear()
        spots = []
        for g in grams.tolist():
            s = memo.get(g)
            if s is None:
                s = memo[g] = place(g)
            spots.append(s)
        at, of = np.unique(np.array(spots, np.int64), return_inverse=True)
        return SparseVector(dims, at, np.bincount(of, times, len(at)))

    return count


class CharCounts(Transformer):
    """Text column to ``char_counts``."""

    def __init__(self, col: str, out: str, n: int, dims: int):
        super().__init__()
        self.col, self.out, self.counts = col, out, F.udf(char_counts(n, dims), VectorUDT())

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, self.counts(F.col(self.col)))


def char_features(col: str, out: str = "features", n: int = 2, dims: int = 1 << 14) -> list:
    """Hashed character n-grams of the whole text, weighted by inverse document frequency."""
    return [CharCounts(col, "_tf", n, dims), IDF(inputCol="_tf", outputCol=out)]


def fit_text_classifier(df: DataFrame, text: str, label: str, max_iter: int = 10) -> PipelineModel:
    """Multinomial logistic regression on character features; labels may be text."""
    stages = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), *char_features(text)]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="features", labelCol="_y", family="multinomial", maxIter=max_iter, regParam=0.01)]).fit(df)


def class_name(c: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), c.cast("int") + 1)


def score_columns(model: PipelineModel, df: DataFrame, cols: list[str], trained_on: str, names: list[str]) -> DataFrame:
    """Score several text columns with one model: id, name, top probability and all probabilities each."""
    for c in cols:
        keep = df.columns
        d = df.withColumnRenamed(trained_on, "_kept") if trained_on in keep and c != trained_on else df
        scorer = PipelineModel([s for s in model.stages if s.uid.split("_")[0] != "StringIndexer"])
        d = scorer.transform(d.withColumn(trained_on, F.col(c)))
        probs = F.transform(vector_to_array("probability"), lambda v: F.round(v, 4))
        if "_kept" in d.columns:
            d = d.drop(trained_on).withColumnRenamed("_kept", trained_on)
        df = d.select(
            *keep, F.col("prediction").cast("int").alias(f"{c}_scene_id"), class_name(F.col("prediction"), names).alias(f"{c}_scene_name"),
            F.array_max(probs).alias(f"{c}_scene_pro"), probs.alias(f"{c}_scene_pro_list"),
        )
    return df


def fit_uplift(df: DataFrame, treatment: str, outcome: str, features: list[str]) -> tuple[PipelineModel, PipelineModel, PipelineModel]:
    """One outcome model per arm and a propensity model."""
    arms = []
    for arm in (0, 1):
        reg = GBTRegressor(featuresCol="features", labelCol=outcome, predictionCol=f"y{arm}", maxIter=10, maxDepth=3, seed=7)
        arms.append(Pipeline(stages=[*_scaled(features), reg]).fit(df.where(F.col(treatment) == arm)))
    prop = LogisticRegression(featuresCol="features", labelCol=treatment, maxIter=10)
    return arms[0], arms[1], Pipeline(stages=[*_scaled(features), prop]).fit(df)


def score_uplift(models, df: DataFrame, treatment: str) -> DataFrame:
    """Add ``y0, y1, uplift, fitted`` and the ``propensity``."""
    keep = df.columns
    d = models[0].transform(df).select(*keep, "y0")
    d = models[1].transform(d).select(*keep, "y0", "y1")
    d = models[2].transform(d).select(*keep, "y0", "y1", vector_to_array("probability")[1].alias("propensity"))
    t = F.col(treatment)
    return d.withColumn("uplift", F.col("y1") - F.col("y0")).withColumn("fitted", t * F.col("y1") + (1 - t) * F.col("y0"))


def zero_if_missing(c: Column) -> Column:
    """Sentinel -1 of categorical codes becomes 0."""
    return F.when(c == -1, 0).otherwise(c)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)))
