"""Versioned releases: previous snapshot, merging, change log, novelty and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import stage
from . import overlay as O
from . import runs as W
from . import spatial as S
from .groups import argmax


def previous_partition(df: DataFrame, dt_col: str, before: str) -> DataFrame:
    """Rows of the newest partition strictly before ``before``: a scalar subquery, so files are pruned."""
    newest = df.where(F.col(dt_col) < before).agg(F.max(dt_col)).scalar()
    return df.where(F.col(dt_col) == newest)


def look_back(df: DataFrame, dt_col: str, today: str, days: int) -> DataFrame:
    first = F.date_format(F.date_sub(F.to_date(F.lit(today), "yyyyMMdd"), days - 1), "yyyyMMdd")
    return df.where(F.col(dt_col).between(first, F.lit(today)))


def latest_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``, keeping all columns."""
    return argmax(df, key, order, df.columns)


def change_type(old: Column, new: Column) -> Column:
    """1 added, 2 removed, 3 present in both."""
    return F.when(old.isNull(), 1).when(new.isNull(), 2).otherwise(3).cast("long")


def merge_snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer join on the key; the old row wins where both exist. ``origin`` says which sides had it."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("o"))
    n = new.select(key, F.struct(*cols).alias("n"))
    j = o.join(n, key, "full_outer").withColumn("r", F.coalesce("o", "n"))
    return j.select(key, *[F.col(f"r.{c}").alias(c) for c in cols], change_type(F.col("o"), F.col("n")).alias("origin"))


def change_log(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and changed rows with the value still known; unchanged ones are dropped."""
    rest = [c for c in old.columns if c not in (key, value)]
    o = old.select(key, F.lit(True).alias("_o"), F.col(value).alias("o_v"), *[F.col(c).alias(f"o_{c}") for c in rest])
    n = new.select(key, F.lit(True).alias("_n"), F.col(value).alias("n_v"), *[F.col(c).alias(f"n_{c}") for c in rest])
    j = o.join(n, key, "full_outer").where(~F.col("o_v").eqNullSafe(F.col("n_v")) | F.col("_o").isNull() | F.col("_n").isNull())
    return j.select(
        key, F.coalesce("n_v", "o_v").alias(value), *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in rest],
        change_type(F.col("_o"), F.col("_n")).alias("change_type"),
    )


def max_overlap_ratio(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(id, ratio)``: largest share of a new shape covered by one old shape, 0 without any."""
    hit = S.intersecting(new, old).groupBy(F.col("l_id").alias("id")).agg(F.max(F.col("inter") / F.col("l_area")).alias("r"))
    return new.select("id").join(hit, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("ratio"))


def keep_novel(new: DataFrame, old: DataFrame, ratio: float = 0.1) -> DataFrame:
    ok = max_overlap_ratio(new, old).where(F.col("ratio") < ratio).select("id")
    return new.join(ok, "id", "left_semi")


def drop_covered(pieces: DataFrame, ratio: float = 0.95) -> DataFrame:
    """Drop shapes contained in, or more than ``ratio`` covered by, another one.

    Of shapes with identical outlines the smallest id stays; they are folded first, so that
    a large group of copies never meets itself in the pair join.
    """
    first = pieces.groupBy("edges").agg(F.min("id").alias("id"))
    unique = pieces.join(first.select("id"), "id", "left_semi")
    hit = S.intersecting(unique, unique, "lt")
    covered = hit.select(
        F.explode(F.array(
            F.struct(F.col("l_id").alias("id"), (F.col("inter") / F.col("l_area")).alias("own"), (F.col("inter") / F.col("r_area")).alias("other"), F.col("r_id").alias("by")),
            F.struct(F.col("r_id").alias("id"), (F.col("inter") / F.col("r_area")).alias("own"), (F.col("inter") / F.col("l_area")).alias("other"), F.col("l_id").alias("by")),
        )).alias("p")
    ).select("p.*").where((F.col("own") > ratio) & ~((F.col("other") > ratio) & (F.col("id") < F.col("by"))))
    return unique.join(covered.select("id").distinct(), "id", "left_anti")


def changed_overlaps(pieces: DataFrame, changed: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Pairs of a piece and a changed area of the same ``code`` covering more than ``ratio`` of it."""
    hit = S.intersecting(pieces, changed, extra=("code",), where=F.col("l_code") == F.col("r_code"))
    return hit.where(F.col("inter") / F.col("l_area") > ratio).select("l_id", "r_id")


def trim_changed(pieces: DataFrame, changed: DataFrame, c: float, ratio: float = 0.1) -> DataFrame:
    """Cut changed areas out of pieces and keep the largest remaining part: runs ``(id, iy, x0, x1)``.

    Only touched pieces are returned; the others stay as they are.
    """
    pairs = stage(changed_overlaps(pieces, changed, ratio), "changed-pairs")
    touched = pieces.join(pairs.select(F.col("l_id").alias("id")), "id", "left_semi")
    cuts = O.polyfill_words(changed, c).select(F.col("id").alias("r_id"), "iy", "wx", "m").join(pairs, "r_id")
    cuts = O.union_words(cuts.select(F.col("l_id").alias("id"), "iy", "wx", "m"), "id")
    rest = O.with_other(O.polyfill_words(touched, c), cuts, ["id"]).select("id", "iy", "wx", F.expr("m & ~o").alias("m")).where("m <> 0")
    parts = stage(O.parts_of_runs(stage(W.word_runs(rest), "rest"), ["id"]), "rest-parts")
    size = parts.groupBy("id", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    top = size.groupBy("id").agg(F.max_by("part", F.struct(F.col("n"), (-F.col("part")).alias("p"))).alias("part"))
    return parts.join(top, ["id", "part"], "left_semi").select("id", "iy", "x0", "x1")


def changed_shape(df: DataFrame, id_col: str, original: str, edited: str, iou: float = 0.99) -> DataFrame:
    """``(id, iou, changed)`` for rows with two outlines as point text; fewer than 4 points: never changed."""
    def side(col):
        pts = G.parse_points(F.col(col))
        good = F.filter(F.array(pts), lambda p: F.size(p) >= 4)
        return S.with_edges(df.select(F.col(id_col).alias("id"), F.explode(F.transform(good, lambda p: G.single_ring(p))).alias("rings")))

    a, b = side(original), side(edited)
    both = a.select("id").join(b.select("id"), "id")
    o = S.overlap(both.select(F.col("id").alias("l_id"), F.col("id").alias("r_id")), a, b)
    o = o.join(a.select(F.col("id").alias("l_id"), F.col("area").alias("aa")), "l_id").join(b.select(F.col("id").alias("l_id"), F.col("area").alias("ba")), "l_id")
    r = o.select(F.col("l_id").alias("id"), (F.col("inter") / (F.col("aa") + F.col("ba") - F.col("inter"))).alias("iou"))
    full = df.select(F.col(id_col).alias("id")).join(r, "id", "left")
    return full.select("id", "iou", F.coalesce(F.col("iou") < iou, F.lit(False)).alias("changed"))
