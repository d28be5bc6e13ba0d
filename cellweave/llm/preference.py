"""Preference records: the common turns of a chosen and a rejected conversation once, then both masked endings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running


def render(role, text):
    """One turn in the chat template. Null roles and texts are empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def segments(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per rendered turn of each pair. ``turns`` has pair_id, side (chosen or rejected), turn, role, text.

    ``part`` is prompt for turns before the first difference (role, text, or one side has ended), which appear once, and chosen
    or rejected for the rest. ``start`` is the character at which the turn stands in its part, ``loss`` is true for turns that are
    trained on: those of a trained role outside the prompt. The first difference is one minimum per pair
    and turns are never gathered into one value or task: ``start`` is a running sum over ranges of turns. Of rows that repeat a
    pair, side and turn the least (role, text) counts; rows with a null pair, turn or another side are left out; a
    pair with one side only has no prompt.
    """
    of = lambda s: F.min(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s)
    both = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL AND side IN ('chosen', 'rejected')").groupBy("pair_id", "turn").agg(of("chosen"), of("rejected"))
    first = both.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("split"))
    marked = both.join(first, "pair_id", "left")
    same = F.coalesce(F.col("turn") < F.col("split"), F.lit(True))
    part = lambda name, s: F.struct(F.lit(name).alias("part"), F.col(f"{s}.role").alias("role"), F.col(f"{s}.text").alias("text"))
    apart = F.filter(F.array(*[F.when(F.col(s).isNotNull(), part(s, s)) for s in ("chosen", "rejected")]), lambda x: x.isNotNull())
    rows = marked.select("pair_id", "turn", F.explode(F.when(same, F.array(part("prompt", "chosen"))).otherwise(apart)).alias("x"))
    rows = rows.select("pair_id", "x.part", "turn", "x.role", render(F.col("x.role"), F.col("x.text")).alias("rendered"))
    rows = running(rows.withColumn("_chars", F.length("rendered").cast("long")), ["pair_id", "part"], ["turn"], {"_end": "_chars"})
    return rows.select(
        "pair_id", "part", "turn", "role", "rendered", (F.col("_end") - F.col("_chars")).alias("start"),
        (F.coalesce(F.col("role").isin(*trained), F.lit(False)) & (F.col("part") != "prompt")).alias("loss"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of the pairs (2k chosen, 2k + 1 rejected) of conversation ids."""
    return conversations.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
