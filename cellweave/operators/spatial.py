"""Spatial joins as equi-joins on grid cells.

Shapes carry ``id, edges, xmin, ymin, xmax, ymax`` (see ``shapes``). Candidate pairs come
from a ladder of grids: a shape lives on the level whose cell is just larger than its box,
so it touches about one to four cells however large it is, and a cell never holds many more
small shapes than really lie next to each other. A pair meets on the coarser level of the
two, and is kept only in the cell that both boxes' lower-left corners agree on, so no
``distinct`` is needed. Where outlines are compared, the cell rows carry them: what is shuffled
grows with the shapes, and a pair is measured in the task that finds it, never shuffled itself.
Hot cells are ordinary skewed join keys: adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import each, spread, stage
from .measures import measured_pairs

BASE_CELL = 0.0005
STEP = 2
LEVELS = 21  # 0.0005 * 2^20 degrees is more than the globe


def shapes(df: DataFrame, id_col: str, wkt_col: str, keep: list[str] | None = None) -> DataFrame:
    """Parse polygon text into the stored shape table: outline, box, area, perimeter.

    Text is parsed once and written to the shared folder, so that the box columns can be
    scanned alone afterwards. Bad rows are left out (``ingest.split_valid`` keeps them).
    """
    keep = keep or []
    # The generator parses once, and drops the rows without a valid outline.
    df = spread(df)
    good = F.filter(F.array(G.parse_polygon(F.col(wkt_col))), lambda r: G.is_valid_rings(F.col(wkt_col), r))
    return stage(with_edges(each(df, [F.col(id_col).alias("id"), *keep], good, "rings")), "shapes")


def with_edges(df: DataFrame) -> DataFrame:
    """Replace ``rings`` by ``edges`` and add box, area and perimeter; row-local."""
    r = df.withColumn("edges", G.edges_of(F.col("rings"))).drop("rings")
    r = r.withColumn("_b", G.bbox(F.col("edges")))
    return r.select(
        *[c for c in r.columns if c != "_b"],
        F.col("_b.xmin").alias("xmin"), F.col("_b.ymin").alias("ymin"),
        F.col("_b.xmax").alias("xmax"), F.col("_b.ymax").alias("ymax"),
        G.area(F.col("edges")).alias("area"), G.perimeter(F.col("edges")).alias("perimeter"),
    )


def _level(w: Column) -> Column:
    out = F.lit(LEVELS - 1)
    for lv in range(LEVELS - 2, -1, -1):
        out = F.when(w <= BASE_CELL * STEP ** lv, F.lit(lv)).otherwise(out)
    return out


def _size(level: Column) -> Column:
    return F.lit(BASE_CELL) * F.pow(F.lit(float(STEP)), level)


def _boxes(df: DataFrame, side: str, pad_m: float, extra: list[str]) -> DataFrame:
    if pad_m:
        # A little more than needed: the exact distance is tested later.
        dy = F.lit(pad_m / G.METRES_PER_DEGREE * 1.01)
        dx = dy / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("ymin"), F.abs("ymax")) + dy)))
    else:
        dx = dy = F.lit(0.0)
    b = df.select(
        F.col("id").alias(f"{side}_id"),
        (F.col("xmin") - dx).alias("x0"), (F.col("ymin") - dy).alias("y0"),
        (F.col("xmax") + dx).alias("x1"), (F.col("ymax") + dy).alias("y1"),
        *[F.col(c).alias(f"{side}_{c}") for c in extra],
    )
    return b.withColumn("own", _level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))


def _cells(boxes: DataFrame, side: str, levels: DataFrame) -> DataFrame:
    """One row per (join role, level, cell) a box takes part in.

    Role 0: the left side's own level is the coarser or equal one; role 1: the right side's.
    """
    coarser_role = 1 if side == "l" else 0
    lower = F.col("own") + 1 if side == "l" else F.col("own")
    # ``levels`` has at most LEVELS rows, so the broadcast is bounded by construction.
    coarse = boxes.join(F.broadcast(levels), F.col("lv") >= lower).withColumn("role", F.lit(coarser_role))
    own = boxes.withColumn("lv", F.col("own")).withColumn("role", F.lit(1 - coarser_role))
    r = coarse.unionByName(own).withColumn("_s", _size(F.col("lv")))
    for c in ("x0", "y0", "x1", "y1"):
        r = r.withColumn(f"c{c}", F.floor(F.col(c) / F.col("_s")))
    r = r.withColumn("cx", F.explode(F.sequence("cx0", "cx1"))).withColumn("cy", F.explode(F.sequence("cy0", "cy1")))
    rest = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1", "own")]
    return r.select(
        *rest, *[F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1", "cx0", "cy0")], "role", "lv", "cx", "cy"
    )


def candidates(
    left: DataFrame, right: DataFrame, pad_m: float = 0.0, extra: tuple[str, ...] = (), self_join: str | None = None
) -> DataFrame:
    """Pairs ``(l_id, r_id, l_<extra>, r_<extra>)`` whose boxes, the left one grown by ``pad_m`` metres, overlap or touch.

    A side carries those columns of ``extra`` that it has. ``self_join``: ``"lt"`` keeps l_id < r_id, ``"ne"`` keeps l_id <> r_id.
    """
    ex_l, ex_r = ([c for c in extra if c in side.columns] for side in (left, right))
    lb, rb = _boxes(left, "l", pad_m, ex_l), _boxes(right, "r", 0.0, ex_r)
    lv_l = lb.select(F.col("own").alias("lv")).distinct()
    lv_r = rb.select(F.col("own").alias("lv")).distinct()
    lc, rc = _cells(lb, "l", lv_r), _cells(rb, "r", lv_l)
    cond = (
        (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1"))
        & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
        & (F.col("cx") == F.greatest("l_cx0", "r_cx0")) & (F.col("cy") == F.greatest("l_cy0", "r_cy0"))
    )
    if self_join == "lt":
        cond = cond & (F.col("l_id") < F.col("r_id"))
    elif self_join == "ne":
        cond = cond & (F.col("l_id") != F.col("r_id"))
    return (
        lc.join(rc, ["role", "lv", "cx", "cy"]).where(cond)
        .select("l_id", "r_id", *[f"l_{c}" for c in ex_l], *[f"r_{c}" for c in ex_r])
    )


def _attach(pairs: DataFrame, left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    le = left.select(F.col("id").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in cols])
    re = right.select(F.col("id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in cols])
    return pairs.select("l_id", "r_id").join(le, "l_id").join(re, "r_id")


def edge_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, strips: bool = True) -> DataFrame:
    """Edges of both shapes side by side, in coordinates relative to the pair's corner.

    With ``strips`` only edges inside the common x-range are kept: all that areas and
    touching need. Rows are ``l_id, r_id, kx, ax1..ay2, bx1..by2``; ``kx`` is metres per degree of
    longitude at the mid latitude of the two boxes.
    """
    p = _attach(pairs, left, right, ["edges", "xmin", "ymin", "xmax", "ymax"])
    p = p.withColumn("ox", F.least("l_xmin", "r_xmin")).withColumn("oy", F.least("l_ymin", "r_ymin"))

    def inside(arr, lo, hi):
        return F.filter(
            F.col(arr), lambda e: (F.least(e["x1"], e["x2"]) <= F.col(hi)) & (F.greatest(e["x1"], e["x2"]) >= F.col(lo))
        )

    ea = inside("l_edges", "r_xmin", "r_xmax") if strips else F.col("l_edges")
    eb = inside("r_edges", "l_xmin", "l_xmax") if strips else F.col("r_edges")
    mid = (F.col("l_ymin") + F.col("l_ymax") + F.col("r_ymin") + F.col("r_ymax")) / 4
    kx = (F.cos(F.radians(mid)) * G.METRES_PER_DEGREE).alias("kx")
    p = p.select("l_id", "r_id", "ox", "oy", kx, ea.alias("ea"), eb.alias("eb"))
    p = each(p, ["l_id", "r_id", "ox", "oy", "kx", "eb"], F.col("ea"), "a")
    p = each(p, ["l_id", "r_id", "ox", "oy", "kx", "a"], F.col("eb"), "b")
    return p.select(
        "l_id", "r_id", "kx",
        *[(F.col(f"{s}.{c}") - F.col("ox" if c[0] == "x" else "oy")).alias(f"{s}{c}") for s in "ab" for c in ("x1", "y1", "x2", "y2")],
    )


# Area under the lower of the two lines over their common x-range, signed by the edges'
# direction. Summed over all edge pairs of two shapes it is the area of their intersection.
_STRIP_AREA = """
CASE WHEN lo < hi THEN sa * sb * CASE
  WHEN (fl - gl) * (fh - gh) >= 0 THEN (least(fl, gl) + least(fh, gh)) / 2 * (hi - lo)
  ELSE (least(fl, gl) + fl + (fh - fl) * t) / 2 * (hi - lo) * t
     + (fl + (fh - fl) * t + least(fh, gh)) / 2 * (hi - lo) * (1 - t) END
ELSE 0D END
"""


def touch_expr() -> str:
    """SQL text: closed segments a and b have a point in common."""
    t1 = "((ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1))"
    t2 = "((ax2 - ax1) * (by2 - ay1) - (ay2 - ay1) * (bx2 - ax1))"
    t3 = "((bx2 - bx1) * (ay1 - by1) - (by2 - by1) * (ax1 - bx1))"
    t4 = "((bx2 - bx1) * (ay2 - by1) - (by2 - by1) * (ax2 - bx1))"
    boxes = (
        "least(ax1, ax2) <= greatest(bx1, bx2) AND least(bx1, bx2) <= greatest(ax1, ax2) AND "
        "least(ay1, ay2) <= greatest(by1, by2) AND least(by1, by2) <= greatest(ay1, ay2)"
    )
    return f"({boxes} AND sign({t1}) * sign({t2}) <= 0 AND sign({t3}) * sign({t4}) <= 0)"


def _with_strips(e: DataFrame) -> DataFrame:
    e = e.selectExpr(
        "*",
        "greatest(least(ax1, ax2), least(bx1, bx2)) AS lo",
        "least(greatest(ax1, ax2), greatest(bx1, bx2)) AS hi",
        "CASE WHEN ax1 > ax2 THEN 1D ELSE -1D END AS sa",
        "CASE WHEN bx1 > bx2 THEN 1D ELSE -1D END AS sb",
        f"{touch_expr()} AS touch",
    )
    on_line = "CASE WHEN {s}x1 = {s}x2 THEN 0D ELSE {s}y1 + ({s}y2 - {s}y1) * (({x} - {s}x1) / ({s}x2 - {s}x1)) END"
    e = e.selectExpr(
        "*",
        *[on_line.format(s=s, x=x) + f" AS {n}" for s, x, n in (("a", "lo", "fl"), ("a", "hi", "fh"), ("b", "lo", "gl"), ("b", "hi", "gh"))],
    )
    return e.withColumn("t", F.expr("CASE WHEN fl = gl AND fh = gh THEN 0D ELSE abs(fl - gl) / (abs(fl - gl) + abs(fh - gh)) END"))


def overlap(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l_id, r_id, inter, touch)``: exact intersection area and whether the outlines meet."""
    e = _with_strips(edge_pairs(pairs, left, right))
    return e.groupBy("l_id", "r_id").agg(F.expr(f"sum({_STRIP_AREA})").alias("inter"), F.max("touch").alias("touch"))


def intersecting(left: DataFrame, right: DataFrame, self_join: str | None = None, extra: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """Closed intersection join: ``(l_id, r_id, inter, l_area, r_area)``, then ``extra``. Touching counts.

    ``where`` drops pairs before they are measured; it may use ``l_`` and ``r_`` columns of ``extra``.
    """
    pairs = candidates(left, right, extra=("area", "edges", *extra), self_join=self_join)
    o = measured_pairs(pairs if where is None else pairs.where(where))
    return (
        o.where(F.col("touch") | (F.col("inter") > F.least("l_area", "r_area") * 1e-9))
        .select("l_id", "r_id", F.greatest("inter", F.lit(0.0)).alias("inter"), "l_area", "r_area", *[c for c in o.columns if c[2:] in extra])
    )


def assign_max_overlap(left: DataFrame, right: DataFrame, keep_right: list[str]) -> DataFrame:
    """Every left shape with the right shape of the largest common area (ties: smallest id).

    A right shape that only touches still wins over none. ``r_id`` is null without a match.
    """
    hit = intersecting(left, right)
    best = hit.groupBy("l_id").agg(
        F.max_by(F.struct("r_id", "inter"), F.struct(F.col("inter"), (-F.col("r_id")).alias("n"))).alias("m")
    ).select("l_id", "m.r_id", "m.inter")
    r = right.select(F.col("id").alias("r_id"), *keep_right)
    return left.join(best, left["id"] == best["l_id"], "left").drop("l_id").join(r, "r_id", "left")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    return intersecting(left, right).select(F.col("l_id").alias("id")).distinct()


def _split_by_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """``id`` of the left shapes that meet any right shape.

    First against one right shape of every cell of its level, which settles shapes in dense places; then the others against all.
    So the work does not grow with the number of pairs.
    """
    r = right.withColumn("_lv", _level(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))))
    cell = [F.floor(F.col(c) / _size(F.col("_lv"))) for c in ("xmin", "ymin")]
    some = r.groupBy("_lv", *cell).agg(F.min("id").alias("id")).select("id")
    first = stage(_met(left, right.join(some, "id", "left_semi")), "met")
    return first.unionByName(_met(left.join(first, "id", "left_anti"), right))


def spatial_semi(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left shapes that meet any right shape."""
    return left.join(_split_by_meeting(left, right), "id", "left_semi")


def spatial_anti(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(_split_by_meeting(left, right), "id", "left_anti")


def contains_pairs(left: DataFrame, right: DataFrame, self_join: str | None = None) -> DataFrame:
    """Pairs where the left shape covers the right one: common area equals the right area."""
    hit = intersecting(left, right, self_join)
    return hit.where(F.col("inter") >= F.col("r_area") * (1 - 1e-9)).select("l_id", "r_id")


def pair_distance(pairs: DataFrame, left: DataFrame, right: DataFrame, within: float | None = None, points: str | None = None) -> DataFrame:
    """``(l_id, r_id, inter, l_area, r_area, dist_degree, dist_meter)`` for pairs with ``l_area`` and ``r_area``, then their other columns.

    Metres are local: longitudes are scaled by the cosine of the pair's mid latitude
    (that of the two boxes). Touching or overlapping shapes have distance 0. Pairs that carry
    ``l_edges`` and ``r_edges`` are measured where they are; others get them by id. ``within`` keeps pairs of at most so many
    metres; ``points`` adds ``l_gap`` and ``r_gap`` (see ``measured_pairs``).
    """
    if "l_edges" not in pairs.columns:
        pairs = pairs.join(left.select(F.col("id").alias("l_id"), F.col("edges").alias("l_edges")), "l_id")
        pairs = pairs.join(right.select(F.col("id").alias("r_id"), F.col("edges").alias("r_edges")), "r_id")
    d = measured_pairs(pairs, "distance", within, points)
    meet = F.col("touch") | (F.col("inter") > F.least("l_area", "r_area") * 1e-9)
    first = ["l_id", "r_id", "l_area", "r_area"]
    d = d.select(
        "l_id", "r_id", F.greatest("inter", F.lit(0.0)).alias("inter"), "l_area", "r_area",
        F.when(meet, 0.0).otherwise(F.sqrt("dd")).alias("dist_degree"),
        F.when(meet, 0.0).otherwise(F.sqrt("dm")).alias("dist_meter"),
        *[c for c in pairs.columns if c not in (*first, "l_edges", "r_edges")], *(["l_gap", "r_gap"] if points else []),
    )
    return d if within is None else d.where(F.col("dist_meter") <= within)


def radius_pairs(areas: DataFrame, probe_m: float = 2000.0, keep_m: float = 1000.0) -> DataFrame:
    """Unordered neighbour pairs: shapes at most ``keep_m`` apart, each direction flagged by
    whether the other shape lies within ``probe_m`` of the own centroid (``l_sees``, ``r_sees``).
    """
    # Nine decimals are a tenth of a millimetre: repeated runs agree on points that lie on an outline.
    side = areas.withColumn("c", G.centroid(F.col("edges")))
    side = side.withColumn("c", G.xy(F.round("c.x", 9), F.round("c.y", 9)))
    p = candidates(side, side, pad_m=keep_m, extra=("area", "edges", "c"), self_join="lt")
    d = pair_distance(p, areas, areas, keep_m, "c")
    return d.select(
        "l_id", "r_id", "inter", "l_area", "r_area", "dist_degree", "dist_meter", "l_c", "r_c",
        (F.col("l_gap") <= probe_m).alias("l_sees"), (F.col("r_gap") <= probe_m).alias("r_sees"),
    ).where("l_sees OR r_sees")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Turn unordered neighbour pairs into ordered ones; a row-local step."""
    one = F.struct(
        F.col("l_id").alias("id"), F.col("r_id").alias("near_id"), F.col("l_area").alias("area"), F.col("r_area").alias("near_area"), F.col("l_sees").alias("sees")
    )
    two = F.struct(
        F.col("r_id").alias("id"), F.col("l_id").alias("near_id"), F.col("r_area").alias("area"), F.col("l_area").alias("near_area"), F.col("r_sees").alias("sees")
    )
    rest = [c for c in pairs.columns if c not in ("l_id", "r_id", "l_area", "r_area", "l_sees", "r_sees", "l_c", "r_c")]
    return pairs.select(F.explode(F.array(one, two)).alias("p"), *rest).where("p.sees").select(
        "p.id", "p.near_id", "dist_degree", "dist_meter",
        (F.col("inter") / F.col("p.area")).alias("inter_ratio"), (F.col("inter") / F.col("p.near_area")).alias("near_inter_ratio"),
        *[c for c in rest if c not in ("inter", "dist_degree", "dist_meter")],
    )


def topology(areas: DataFrame, probe_m: float = 2000.0, keep_m: float = 1000.0) -> DataFrame:
    """Neighbour pairs with distances, overlap ratios and the areas lying between the two."""
    near = stage(radius_pairs(areas, probe_m, keep_m), "near")
    seg = near.select(
        F.struct("l_id", "r_id").alias("id"), F.col("l_c.x").alias("x1"), F.col("l_c.y").alias("y1"), F.col("r_c.x").alias("x2"), F.col("r_c.y").alias("y2")
    )
    met = crossing_areas(seg, areas).select(F.col("l_id.l_id").alias("l_id"), F.col("l_id.r_id").alias("r_id"), F.col("r_id").alias("mid"))
    met = met.where("mid <> l_id AND mid <> r_id").groupBy("l_id", "r_id").agg(F.sort_array(F.collect_list("mid")).alias("pass_list"))
    none = F.array().cast("array<bigint>")
    full = near.join(met, ["l_id", "r_id"], "left").withColumn("pass_list", F.coalesce("pass_list", none))
    return both_ways(full).withColumn("pass_cnt", F.size("pass_list").cast("bigint"))


def points_in(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Points (``id, x, y``) inside areas, by counting crossings of a ray: ``(l_id, r_id)``, then the point and the area's box."""
    boxes = points.select("id", "x", "y", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    box = ("xmin", "ymin", "xmax", "ymax")
    areas = areas.select("id", "edges", *box, F.struct(*box).alias("box"))
    p = candidates(boxes, areas, extra=("x", "y", "edges", "box"))
    return p.where(inside_expr(F.col("r_edges"), F.col("l_x"), F.col("l_y"))).select("l_id", "r_id", F.col("l_x").alias("x"), F.col("l_y").alias("y"), F.col("r_box").alias("box"))


def inside_expr(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of one point against the row's own edges."""
    crossings = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(crossings) % 2 == 1


def crossing_areas(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """``(l_id, r_id)``: areas met by a segment (``id, x1, y1, x2, y2``) that hold neither of its ends."""
    boxes = segments.select(
        "id", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"),
        F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"), F.struct("x1", "y1", "x2", "y2").alias("s"),
    )
    p = candidates(boxes, areas.select("id", "edges", "xmin", "ymin", "xmax", "ymax"), extra=("s", "edges"))
    p = p.select("l_id", "r_id", F.col("r_edges").alias("edges"), *[F.col(f"l_s.{c}").alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")])
    ends = inside_expr(F.col("edges"), F.col("sx1"), F.col("sy1")) | inside_expr(F.col("edges"), F.col("sx2"), F.col("sy2"))
    p = p.where(~ends)
    # With both ends outside, the segment meets the area only where it meets the outline.
    one = F.struct(*[F.col(f"s{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    p = measured_pairs(p.select("l_id", "r_id", F.array(one).alias("l_edges"), F.col("edges").alias("r_edges")), "touch")
    return p.where("touch").select("l_id", "r_id").distinct()
