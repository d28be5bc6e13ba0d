"""Constrained selection of flows per group, for all groups at once.

A row has a cost and a gain if chosen, and may have others if not. A group must reach a gain, within a band of
counts, at least cost. For a number of trade-offs between cost and gain the free rows of a group are ranked, and
the cheapest prefix that meets all limits is found; later rounds look closer around the best trade-off. A histogram of
scores tells which few bins can hold that prefix; only their rows are ranked. Running sums
are two-phase over range partitions, so no group has to fit one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, stage
from .ranges import running

# Lowest gain over base gain, and the count band, per variant.
BINS = 1 << 12
LIMITS = {"circle": (1.005, 0.95, 1.10), "distance": (1.003, 0.90, 1.10)}


def classify_flows(df: DataFrame, variant: str) -> DataFrame:
    """Add ``flow_class``: 1 always chosen, -1 never chosen, 0 free."""
    if variant == "circle":
        c = F.when(F.expr("base_set = 1 AND candidate_set = 0 AND navi_cls <= 2"), 1)
        c = c.when(F.expr("base_set = 0 AND candidate_set = 0 AND navi_cls > 3"), -1)
    else:
        c = F.when(F.col("navi_cls") == 1, 1).when(F.col("navi_cls") == 4, -1)
    return df.withColumn("flow_class", c.otherwise(0).cast("long"))


def group_baseline(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(F.when(F.col("base_set") == 1, 1).otherwise(0)).alias("base_n"),
        F.sum(F.when(F.col("base_set") == 1, F.col("base_gain")).otherwise(0.0)).alias("base_gain"),
    )


def limits(df: DataFrame, group: str, variant: str) -> DataFrame:
    """Per group: base count and gain, least gain, least and greatest count (halves to even)."""
    gain, lo, hi = LIMITS[variant]
    b = group_baseline(df, group)
    return b.select(
        group, "base_n", "base_gain", (F.col("base_gain") * gain).alias("min_gain"),
        F.bround(F.col("base_n") * lo).cast("long").alias("min_n"), F.bround(F.col("base_n") * hi).cast("long").alias("max_n"),
    )


def _arms(df: DataFrame, arm0: tuple[str, str] | None) -> DataFrame:
    """Add what a row costs and gains if not chosen (nothing, unless ``arm0`` names columns)."""
    c, g = (F.col(arm0[0]), F.col(arm0[1])) if arm0 else (F.lit(0.0), F.lit(0.0))
    return df.withColumn("_c0", c.cast("double")).withColumn("_g0", g.cast("double"))


def _score() -> Column:
    return F.cos("turn") * F.col("c") / F.col("cs") - F.sin("turn") * F.col("g") / F.col("gs")


def _prefixes(free: DataFrame, group: str, turns: DataFrame) -> DataFrame:
    """Free rows with their place, cost and gain up to them, for each trade-off (group, turn)."""
    d = free.join(turns, group)
    d = d.select(group, "turn", "_row", "c", "g", _score().alias("score"), F.lit(1).cast("long").alias("one"))
    return running(d, [group, "turn"], ["score", "_row"], {"pos": "one", "cc": "c", "cg": "g"})


def _leading(free: DataFrame, group: str, turns: DataFrame, need: DataFrame) -> DataFrame:
    """Prefixes ``(group, turn, pos, cc, cg)`` for each trade-off, among them the cheapest that fits and the one of the least bound.

    Scores lie between -1.5 and 1.5 and fall into equal bins. The ends of bins are prefixes; a bin whose least cost (its start
    plus all that is saved in it) is above that of a fitting end, or whose greatest gain is too little, holds no better one.
    """
    d = free.join(turns.withColumn("tan", F.tan("turn")), group)
    worth = F.col("c") - F.col("tan") * F.col("cs") / F.col("gs") * F.col("g")
    d = d.select(group, "turn", "_row", "c", "g", "bins", _score().alias("score"), worth.alias("v"))
    place = F.floor((F.col("score") + 1.5) / 3.0 * F.col("bins"))
    d = d.withColumn("bin", F.when(F.col("score").isNull(), -1).when(F.isnan("score"), F.col("bins")).otherwise(place))
    h = d.groupBy(group, "turn", "bin").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("c"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"),
        F.sum(F.least("c", F.lit(0.0))).alias("saved"), F.sum(F.greatest("g", F.lit(0.0))).alias("gained"), F.sum(F.least("v", F.lit(0.0))).alias("fall"))
    # A trade-off has at most BINS + 2 bins.
    before = Window.partitionBy(group, "turn").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = {f"{x}0": F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("n", "c", "g")}
    h = h.withColumns(start).join(need.select(group, "need", "lo", "hi", "cs", "gs"), group)
    h = stage(h.withColumn("pos", F.col("n0") + F.col("n")).withColumn("cc", F.col("c0") + F.col("c")).withColumn("cg", F.col("g0") + F.col("g")), "bins")
    price = F.tan("turn") * F.col("cs") / F.col("gs")
    known = h.where("pos BETWEEN lo AND hi").groupBy(group, "turn").agg(
        F.min(F.when(F.col("cg") >= F.col("need"), F.col("cc"))).alias("top"), F.min(F.col("cc") - price * F.col("cg")).alias("low"))
    slack = (F.abs("c0") + F.abs("saved") + price * (F.abs("g0") + F.abs("gained"))) * 1e-9
    cheap = (F.col("g0") + F.col("gained") + F.abs("need") * 1e-9 >= F.col("need")) & (F.col("top").isNull() | (F.col("c0") + F.col("saved") <= F.col("top") + (F.abs("c0") + F.abs("saved")) * 1e-9))
    bound = F.col("low").isNull() | (F.col("c0") - price * F.col("g0") + F.col("fall") <= F.col("low") + slack)
    open_bins = h.join(known, [group, "turn"], "left").where("n > 1 AND n0 < hi AND pos >= lo").where(cheap | ((F.col("turn") < math.pi / 2) & bound))
    open_bins = stage(open_bins.select(group, "turn", "bin", "n0", "c0", "g0"), "open-bins")
    rows = d.join(open_bins, [group, "turn", "bin"]).select(group, "turn", "bin", "_row", "c", "g", "score", "n0", "c0", "g0", F.lit(1).cast("long").alias("one"))
    inside = running(rows, [group, "turn", "bin"], ["score", "_row"], {"pos": "one", "cc": "c", "cg": "g"})
    inside = inside.select(group, "turn", (F.col("n0") + F.col("pos")).alias("pos"), (F.col("c0") + F.col("cc")).alias("cc"), (F.col("g0") + F.col("cg")).alias("cg"))
    return h.select(group, "turn", "pos", "cc", "cg").unionByName(inside)


def select_flows(df: DataFrame, group: str, variant: str = "circle", arm0: tuple[str, str] | None = None, turns: int = 17, rounds: int = 3) -> DataFrame:
    """Add ``flow_class``, ``is_selected``, ``bound`` and ``gap``.

    ``is_selected``: 1 or 0, or -1 for all rows of a group that no choice of rows satisfies. That is exact: the last
    trade-off looks at gain only, so its prefixes have the greatest gain of their length. ``bound``: no choice of the group
    costs less (Lagrangian bound over the trade-offs seen); ``gap``: what the choice costs above it. Both are null where
    there is no choice. ``arm0`` names the columns of cost and gain of a row that is not chosen; without it they are 0.
    ``turns`` and ``rounds`` set how finely trade-offs are searched.
    """
    d = stage(_arms(classify_flows(df, variant), arm0).withColumn("_row", F.monotonically_increasing_id()), "flows")
    lim = limits(d, group, variant)
    fixed = d.groupBy(group).agg(
        F.sum(F.when(F.col("flow_class") == 1, 1).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("flow_class") == 1, F.col("gain")).otherwise(F.col("_g0"))).cast("double").alias("fg"),
        F.sum(F.when(F.col("flow_class") == 1, F.col("cost")).otherwise(F.col("_c0"))).cast("double").alias("fc"),
        F.greatest(F.lit(1), F.least(F.lit(BINS), F.floor(F.count(F.when(F.col("flow_class") == 0, 1)) / 16))).alias("bins"),
        F.max(F.when(F.col("flow_class") == 0, F.abs(F.col("cost") - F.col("_c0")))).alias("cs"),
        F.max(F.when(F.col("flow_class") == 0, F.abs(F.col("gain") - F.col("_g0")))).alias("gs"),
    )
    positive = {n: F.when(F.col(n) > 0, F.col(n)).otherwise(1.0).alias(n) for n in ("cs", "gs")}
    # The sums of the audit run in another order; the margin keeps a rounding error from breaking a limit.
    need = cut_lineage(lim.where("base_gain > 0").join(fixed, group).select(
        group, (F.col("min_gain") + F.abs("min_gain") * 1e-12 - F.col("fg")).alias("need"), (F.col("min_n") - F.col("fn")).alias("lo"),
        (F.col("max_n") - F.col("fn")).alias("hi"), "fc", "bins", *positive.values(),
    ))
    free = d.where("flow_class = 0").join(need.select(group, "cs", "gs", "bins"), group).select(
        group, "_row", (F.col("cost") - F.col("_c0")).cast("double").alias("c"), (F.col("gain") - F.col("_g0")).cast("double").alias("g"), "cs", "gs", "bins")
    free = stage(free, "free")
    # Choosing no free row may do already; it is also a choice that bounds may not overlook.
    none = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    best = need.select(group, F.lit(0.0).alias("turn"), F.lit(0).cast("long").alias("pos"), F.when(none & (F.col("need") <= 0), 0.0).alias("cc"), F.lit(None).cast("double").alias("bound"))
    span = need.select(group, F.lit(0.0).alias("first"), F.lit(math.pi / 2).alias("last"))
    for _ in range(rounds):
        step = (F.col("last") - F.col("first")) / (turns - 1)
        at = span.select(group, step.alias("step"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda k: F.when(k == turns - 1, F.col("last")).otherwise(F.col("first") + k * step))).alias("turn"))
        at = cut_lineage(at)
        fits = _leading(free, group, at.select(group, "turn"), need).join(need, group).where("pos BETWEEN lo AND hi")
        price = F.tan("turn") * F.col("cs") / F.col("gs")
        seen = fits.groupBy(group, "turn").agg(
            F.min_by(F.struct("pos", "cc"), F.when(F.col("cg") >= F.col("need"), F.struct("cc", "pos"))).alias("b"),
            F.min(F.col("cc") - price * F.col("cg")).alias("low"))
        seen = at.join(seen, [group, "turn"], "left").join(need, group)
        low = F.least("low", F.when(none, 0.0)) + price * F.col("need")
        seen = cut_lineage(seen.select(group, "turn", "step", "b.pos", "b.cc", F.when(F.col("turn") < math.pi / 2, low).alias("bound")))
        both = seen.drop("step").unionByName(best)
        best = cut_lineage(both.groupBy(group).agg(
            F.min_by(F.struct("turn", "pos", "cc"), F.when(F.col("cc").isNotNull(), F.struct("cc", "turn", "pos"))).alias("b"), F.max("bound").alias("bound"),
        ).select(group, "b.*", "bound"))
        near = seen.where("cc IS NOT NULL").groupBy(group).agg(F.min_by(F.struct("turn", "step"), F.struct("cc", "turn")).alias("x"))
        span = near.select(group, F.greatest(F.lit(0.0), F.col("x.turn") - F.col("x.step")).alias("first"), F.least(F.lit(math.pi / 2), F.col("x.turn") + F.col("x.step")).alias("last"))
    best = best.where("cc IS NOT NULL")
    ranked = _prefixes(free, group, best.select(group, "turn"))
    hits = ranked.join(best.select(group, F.col("pos").alias("_k")), group).where("pos <= _k").select("_row", F.lit(1).alias("_hit"))
    ends = best.join(need.select(group, "fc"), group).select(group, (F.col("bound") + F.col("fc")).alias("bound"), (F.col("cc") - F.col("bound")).alias("gap"), F.lit(True).alias("_ok"))
    every = d.join(hits, "_row", "left").join(ends, group, "left")
    chosen = F.when(F.col("flow_class") == 1, 1).otherwise(F.coalesce("_hit", F.lit(0)))
    return every.select(*df.columns, "flow_class", F.when(F.col("_ok"), chosen).otherwise(-1).cast("long").alias("is_selected"), "bound", "gap")


def audit_selection(df: DataFrame, group: str, variant: str, chosen: str = "is_selected", arm0: tuple[str, str] | None = None) -> DataFrame:
    """Per group: cost, gain and count of the chosen rows, their changes, and whether all limits hold."""
    on = F.col(chosen) == 1
    df = _arms(df, arm0)
    a = df.groupBy(group).agg(
        F.sum(F.when(on, F.col("cost")).otherwise(F.col("_c0"))).alias("cost"), F.sum(F.when(on, F.col("gain")).otherwise(F.col("_g0"))).alias("gain"),
        F.sum(F.when(on, 1).otherwise(0)).alias("n"),
    )
    r = a.join(limits(df, group, variant), group)
    return r.select(
        group, "cost", "gain", "n", (F.try_divide("gain", "base_gain") - 1).alias("gain_change"), (F.try_divide("n", "base_n") - 1).alias("count_change"),
        F.coalesce((F.col("gain") >= F.col("min_gain")) & (F.col("base_gain") > 0) & F.col("n").between(F.col("min_n"), F.col("max_n")), F.lit(False)).alias("feasible"),
    )
