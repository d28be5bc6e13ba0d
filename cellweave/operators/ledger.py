"""Order identities and monthly cost settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the phone relations (same as both, as the sender, as the recipient, as none, unknown).
IDENTITY = ["自发自收下单", "发件人下单", "收件人下单", "遥控下单", "其他"]


def order_identity(binded: Column, sender: Column, recipient: Column) -> Column:
    """Relation of the account's phone to the two on the order; missing phones fall to the last name."""
    s, r = binded == sender, binded == recipient
    return F.when(s & r, IDENTITY[0]).when(s & ~r, IDENTITY[1]).when(~s & r, IDENTITY[2]).when(~s & ~r, IDENTITY[3]).otherwise(IDENTITY[4])


def monthly_totals(ledger: DataFrame) -> DataFrame:
    """``month, y, y1, y2`` from payments ``month, payer, amount``: total and what A and B advanced."""
    def paid(who):
        return F.sum(F.when(F.col("payer") == who, F.col("amount")).otherwise(0.0))

    return ledger.groupBy("month").agg(F.sum("amount").alias("y"), paid("A").alias("y1"), paid("B").alias("y2"))


def settle(df: DataFrame) -> DataFrame:
    """Settle ``x`` (the fund), ``y``, ``y1``, ``y2``: A bears a third inside the fund and two fifths beyond it.

    ``net`` > 0: A pays B. Rows that do not add up or are negative are marked invalid.
    """
    used = F.least("x", "y")
    over = F.greatest(F.lit(0.0), F.col("y") - F.col("x"))
    d = df.withColumn("fund_used", used).withColumn("over_part", over)
    d = d.withColumn("a_cost", F.col("fund_used") / 3 + F.col("over_part") * 2 / 5)
    d = d.withColumn("net", F.col("a_cost") - (F.col("x") / 3 + F.col("y1")))
    status = F.when(F.abs("net") < 0.01, "balanced").when(F.col("net") > 0, "pay").otherwise("receive")
    valid = (F.least("x", "y", "y1", "y2") >= 0) & (F.abs(F.col("y1") + F.col("y2") - F.col("y")) <= 0.01)
    return d.withColumn("status", status).withColumn("valid", valid)


def infer_third(df: DataFrame) -> DataFrame:
    """Fill in the one missing value of ``y = y1 + y2``; a negative result stays missing."""
    def positive(c):
        return F.when(c >= 0, c)

    return df.select(
        *[c for c in df.columns if c not in ("y", "y1", "y2")],
        F.coalesce("y", F.round(F.col("y1") + F.col("y2"), 2)).alias("y"),
        F.coalesce("y1", positive(F.round(F.col("y") - F.col("y2"), 2))).alias("y1"),
        F.coalesce("y2", positive(F.round(F.col("y") - F.col("y1"), 2))).alias("y2"),
    )
