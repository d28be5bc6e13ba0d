"""Evaluation of scored rows, leaderboards and run logs, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running


def metrics(df: DataFrame, *keys: str, label: str = "label", prob: str = "p") -> DataFrame:
    """Rows, accuracy at 0.5, mean log-loss and AUC per key."""
    y, p = F.col(label), F.least(F.greatest(F.col(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))
    a = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when((F.col(prob) > 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(loss).alias("log_loss")
    )
    return a.join(auc(df, *keys, label=label, prob=prob), list(keys))


def auc(df: DataFrame, *keys: str, label: str = "label", prob: str = "p") -> DataFrame:
    """Area under the ROC curve, ties counted half, without ranking a whole key in one task.

    Equal scores are folded first; running counts then are two-phase over ranges of the scores.
    """
    ks = list(keys)
    d = df.groupBy(*ks, F.col(prob).alias("p")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")
    )
    d = running(d, ks, ["p"], {"upto": "neg"})
    wins = F.col("pos") * (F.col("upto") - F.col("neg") / 2)
    t = d.groupBy(*ks).agg(F.sum(wins).alias("w"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return t.select(*ks, F.try_divide("w", F.col("np") * F.col("nn").cast("double")).alias("auc"))


def leaderboard(df: DataFrame, top: int = 3) -> DataFrame:
    """Rank models by accuracy, then loss; one row per model, so the window is short."""
    w = Window.orderBy(F.col("accuracy").desc(), F.col("log_loss"), F.col("model"))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("top", F.col("rank") <= top)


def best_epoch(df: DataFrame, *keys: str) -> DataFrame:
    """Least loss and greatest accuracy with their first epochs."""
    return df.groupBy(*keys).agg(
        F.min("loss").alias("best_loss"), F.min_by("epoch", F.struct("loss", "epoch")).alias("loss_epoch"),
        F.max("accuracy").alias("best_accuracy"), F.min_by("epoch", F.struct((-F.col("accuracy")).alias("a"), "epoch")).alias("accuracy_epoch"),
    )


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.withColumn("share", F.col("n") / total.scalar())


# One line of a training log.
LOG_LINE = r"^Epoch (\d+)/\d+ \| train loss: ([\d.]+), acc: ([\d.]+)% \| test loss: ([\d.]+), acc: ([\d.]+)%$"


def parse_runs(df: DataFrame, run: str, line: str) -> DataFrame:
    """Epoch metrics out of log lines; other lines are skipped."""
    def at(i, t):
        return F.regexp_extract(line, LOG_LINE, i).cast(t)

    d = df.where(F.col(line).rlike(LOG_LINE))
    return d.select(run, at(1, "long").alias("epoch"), at(2, "double").alias("train_loss"), at(3, "double").alias("train_accuracy"), at(4, "double").alias("loss"), at(5, "double").alias("accuracy"))
