"""Outlines of cell coverages: boundary edges stitched into rings by pointer doubling, many small keys at a time or in rounds over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage, stage
from . import runs as R


def boundary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Straight stretches ``(keys, dir, sx, sy, ex, ey)`` of a coverage's boundary in lattice points, cells on the left.

    ``dir`` counts quarter turns from east. An edge between two cells of a key is met twice and drops out, in one
    aggregate; the windows span one line of one key.
    """
    edge = lambda d, x, y: F.struct(F.lit(d).alias("dir"), x.alias("x"), y.alias("y"))
    x, y = F.col("ix"), F.col("iy")
    e = cells.select(*keys, F.explode(F.array(edge(0, x, y), edge(1, x + 1, y), edge(2, x, y + 1), edge(3, x, y))).alias("e"))
    e = e.groupBy(*keys, (F.col("e.dir") % 2).alias("axis"), "e.x", "e.y").agg(F.count("*").alias("n"), F.min("e.dir").alias("dir")).where("n = 1")
    e = e.withColumn("line", F.when(F.col("axis") == 0, F.col("y")).otherwise(F.col("x"))).withColumn("at", F.when(F.col("axis") == 0, F.col("x")).otherwise(F.col("y")))
    e = e.withColumn("g", F.col("at") - F.row_number().over(Window.partitionBy(*keys, "dir", "line").orderBy("at")))
    s = e.groupBy(*keys, "dir", "line", "g").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
    point = lambda c: F.when(F.col("dir") % 2 == 0, F.struct(F.col(c).alias("x"), F.col("line").alias("y"))).otherwise(F.struct(F.col("line").alias("x"), F.col(c).alias("y")))
    forth = F.col("dir") < 2
    s = s.withColumn("s", F.when(forth, point("lo")).otherwise(point("hi"))).withColumn("e", F.when(forth, point("hi")).otherwise(point("lo")))
    return s.select(*keys, "dir", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("e.x").alias("ex"), F.col("e.y").alias("ey"))


def ordered_rings(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Every stretch with its ring (the ring's least stretch) and its step from there: ``(keys, ring, step, sx, sy, ex, ey)``.

    Where two rings meet in a point the left turn is taken, so a ring stays with its cells. Each round doubles the way that a stretch
    looks ahead, and keeps the least stretch seen and the steps to it; when a round changes nothing, all know their
    ring's least one. The number of rounds is the logarithm of the longest ring.
    """
    node = F.struct(F.col("sy").alias("y"), F.col("sx").alias("x"), F.col("dir").alias("d"))
    s = cut_lineage(stretches.withColumn("node", node))
    turn = F.pmod(F.col("n.dir") - F.col("s.dir") - 1, F.lit(4))
    same = [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys] + [F.col("s.ex") == F.col("n.sx"), F.col("s.ey") == F.col("n.sy")]
    nxt = s.alias("s").join(s.alias("n"), same).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.node").alias("node")).agg(F.min_by("n.node", turn).alias("nxt"))
    at = cut_lineage(nxt.select(*keys, "node", "nxt", F.col("node").alias("least"), F.lit(0).cast("long").alias("off")))
    span = 1
    while True:
        ahead = at.select(*keys, F.col("node").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("least").alias("least2"), F.col("off").alias("off2"))
        lower = F.col("least2") < F.col("least")
        step = at.join(ahead, [*keys, "nxt"])
        at = cut_lineage(step.select(
            *keys, "node", F.col("nxt2").alias("nxt"), F.when(lower, F.col("least2")).otherwise(F.col("least")).alias("least"),
            F.when(lower, F.col("off2") + span).otherwise(F.col("off")).alias("off"), lower.alias("moved"),
        ))
        span *= 2
        if at.where("moved").isEmpty():
            break
    count = at.groupBy(*keys, "least").agg(F.count("*").alias("len"))
    at = at.join(count, [*keys, "least"]).select(*keys, "node", F.col("least").alias("ring"), F.when(F.col("off") == 0, F.lit(0).cast("long")).otherwise(F.col("len") - F.col("off")).alias("step"))
    return s.join(at, [*keys, "node"]).select(*keys, "ring", "step", "sx", "sy", "ex", "ey")


def rings_of_runs(runs: DataFrame, keys: list[str], room: int = R.ROOM) -> DataFrame:
    """``ordered_rings`` of coverages given as stored runs: keys of at most ``room`` runs are traced many at a time in one task, larger ones by rounds."""
    large = stage(R.large_keys(runs, keys, room), "large")
    small = R.traced(runs.join(F.broadcast(large), keys, "left_anti"), keys)
    if large.isEmpty():
        return small
    cells = runs.join(F.broadcast(large), keys, "left_semi").select(*keys, "iy", F.explode(F.sequence("x0", "x1")).alias("ix"))
    return small.unionByName(ordered_rings(boundary(cells, keys), keys))


def outlines(cells: DataFrame, keys: list[str], part: str, c: float, room: int = R.ROOM) -> DataFrame:
    """``(keys, rings)``: the outline of each coverage in degrees, in the form that ``geometry`` parses polygons to.

    ``cells`` are cells or runs. ``part`` numbers the connected parts of a key from 1; each has one outer ring, first, and its holes
    after it. Only the points of a finished outline are gathered, since they are one value of the result.
    """
    of = [*keys, part]
    if "ix" in cells.columns:
        cells = cells.withColumn("x0", F.col("ix")).withColumn("x1", F.col("ix"))
    r = rings_of_runs(stage(cells.select(*of, *[F.col(k).cast("long").alias(k) for k in ("iy", "x0", "x1")]), "outline-runs"), of, room)
    point = F.struct("step", F.struct((F.col("sx") * F.lit(c)).alias("x"), (F.col("sy") * F.lit(c)).alias("y")).alias("p"))
    twice = F.sum(F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy"))
    r = r.groupBy(*of, "ring").agg(F.sort_array(F.collect_list(point)).alias("pts"), twice.alias("twice"))
    order = F.struct(F.col(part).cast("int").alias("part"), (F.col("twice") < 0).alias("hole"), F.col("ring"), F.transform("pts", lambda p: p["p"]).alias("pts"))
    r = r.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("o"))
    first = lambda o, i: i - F.array_position(F.transform("o", lambda q: q["part"]), o["part"]).cast("int") + 1
    return r.select(*keys, F.transform("o", lambda o, i: F.struct(o["part"].alias("part"), first(o, i).alias("ring"), o["pts"].alias("pts"))).alias("rings"))


def as_polygons(cells: DataFrame, keys: list[str], part: str, c: float, digits: int = 6) -> DataFrame:
    """``(keys, polygon)``: the outlines as polygon text."""
    return outlines(cells, keys, part, c).select(*keys, G.rings_to_wkt(F.col("rings"), digits).alias("polygon"))
