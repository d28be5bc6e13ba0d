"""Polygon overlay as set operations on covered grid cells.

A coverage is rows ``(scope..., ix, iy)``; cell (ix, iy) of size ``c`` has its centre at
((ix + 0.5) c, (iy + 0.5) c). Union, difference and intersection are distinct, anti and
semi joins; growing and shrinking are counts over shifted copies. Outlines are turned into
horizontal runs first (one scan line per grid row), never by testing every cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..session import each, stage
from . import runs as R
from .components import connected_components
from .contract import contract


def polyfill_runs(shapes: DataFrame, c: float, keep: list[str] | None = None) -> DataFrame:
    """Runs ``(id, iy, x0, x1)`` of cells whose centre lies inside the shape."""
    keep = keep or []
    rows = _lines(shapes, c, keep)
    pairs = F.when(F.size("xs") > 1, F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)))
    r = each(rows, ["id", *keep, "iy", "xs"], pairs, "i")
    r = r.select("id", *keep, "iy", F.get("xs", F.col("i")).alias("x0"), (F.get("xs", F.col("i") + 1) - 1).alias("x1"))
    return r.where("x0 <= x1")


def _lines(shapes: DataFrame, c: float, keep: list[str]) -> DataFrame:
    """Grid rows ``(id, iy, xs)`` of a shape; ``xs`` has the first cell of each run and the cell behind it, in turns."""
    rows = shapes.select(
        "id", *keep, "edges",
        F.explode(F.sequence(F.ceil(F.col("ymin") / c - 0.5), F.floor(F.col("ymax") / c - 0.5))).alias("iy"),
    ).where("iy IS NOT NULL").withColumn("yc", (F.col("iy") + 0.5) * c)
    cut = F.filter("edges", lambda e: (e["y1"] > F.col("yc")) != (e["y2"] > F.col("yc")))
    xs = F.array_sort(F.transform(cut, lambda e: (e["x2"] - e["x1"]) * (F.col("yc") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return rows.select("id", *keep, "iy", F.transform(xs, lambda x: F.ceil(x / c - 0.5)).alias("xs"))


def polyfill_words(shapes: DataFrame, c: float) -> DataFrame:
    """Words ``(id, iy, wx, m)`` of the covered cells: bit b of ``m`` is cell 64 wx + b. A shape has one row for a word."""
    return R.words(_lines(shapes, c, []))


def union_words(words: DataFrame, *group: str) -> DataFrame:
    return words.groupBy(*group, "iy", "wx").agg(F.bit_or("m").alias("m"))


def with_other(words: DataFrame, other: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Words with ``o``, the cells of ``other`` (united words) in the same place, 0 without any."""
    on = [*(on or []), "iy", "wx"]
    return words.join(other.select(*on, F.col("m").alias("o")), on, "left").withColumn("o", F.coalesce("o", F.lit(0).cast("long")))


def open_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """``opening`` by one cell on words: neighbours in a row are shifted bits, rows are combined by and, then by or."""
    w = Window.partitionBy(*keys, "iy").orderBy("wx")
    beside = lambda f, d: F.when(f("wx").over(w) == F.col("wx") + d, f("m").over(w)).otherwise(F.lit(0))
    s = words.withColumn("_l", beside(F.lag, -1)).withColumn("_r", beside(F.lead, 1))
    s = s.withColumn("m", F.expr("m & (shiftleft(m, 1) | shiftrightunsigned(_l, 63)) & (shiftrightunsigned(m, 1) | shiftleft(_r, 63))"))
    near = F.explode(F.expr("array(iy - 1, iy, iy + 1)")).alias("iy")
    # A word counts where all three rows have it: rows without cells are missing, cells met twice count twice.
    s = s.select(*keys, "wx", "m", near).groupBy(*keys, "iy", "wx").agg(F.bit_and("m").alias("m"), F.count("*").alias("_n")).where("_n = 3 AND m <> 0")
    g = s.select(*keys, near, F.explode(F.expr(
        "filter(array(struct(wx, m | shiftleft(m, 1) | shiftrightunsigned(m, 1) AS m), struct(wx + 1 AS wx, shiftrightunsigned(m, 63) AS m), struct(wx - 1 AS wx, shiftleft(m, 63) AS m)), v -> v.m <> 0)")).alias("v"))
    return union_words(g.select(*keys, "iy", "v.wx", "v.m"), *keys)


def run_cells(runs: DataFrame) -> DataFrame:
    rest = [k for k in runs.columns if k not in ("x0", "x1")]
    return runs.select(*rest, F.explode(F.sequence("x0", "x1")).alias("ix"))


def polyfill(shapes: DataFrame, c: float, keep: list[str] | None = None) -> DataFrame:
    return run_cells(polyfill_runs(shapes, c, keep))


def union_cells(cells: DataFrame, *group: str) -> DataFrame:
    return cells.select(*group, "ix", "iy").distinct()


def subtract_cells(cells: DataFrame, other: DataFrame, on: list[str] | None = None) -> DataFrame:
    return cells.join(other, [*(on or []), "ix", "iy"], "left_anti")


def clip_cells(cells: DataFrame, other: DataFrame, on: list[str] | None = None) -> DataFrame:
    return cells.join(other, [*(on or []), "ix", "iy"], "left_semi")


def _spread(cells: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    rest = [k for k in [*keys, "ix", "iy"] if k != axis]
    return cells.select(*rest, F.explode(F.array(F.col(axis) - 1, F.col(axis), F.col(axis) + 1)).alias(axis))


def grow(cells: DataFrame, keys: list[str], steps: int = 1) -> DataFrame:
    """All cells within ``steps`` (8-neighbourhood), one axis after the other."""
    for _ in range(steps):
        for axis in ("ix", "iy"):
            cells = _spread(cells, axis, keys).distinct()
    return cells.select(*keys, "ix", "iy")


def shrink(cells: DataFrame, keys: list[str], steps: int = 1) -> DataFrame:
    """Cells whose whole neighbourhood is covered."""
    for _ in range(steps):
        for axis in ("ix", "iy"):
            cells = _spread(cells, axis, keys).groupBy(*keys, "ix", "iy").count().where("count = 3").drop("count")
    return cells.select(*keys, "ix", "iy")


def opening(cells: DataFrame, keys: list[str], steps: int = 1) -> DataFrame:
    return grow(shrink(cells, keys, steps), keys, steps)


def to_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal horizontal runs. The window spans one grid row of one shape."""
    w = Window.partitionBy(*keys, "iy").orderBy("ix")
    g = cells.withColumn("_g", F.col("ix") - F.row_number().over(w))
    return g.groupBy(*keys, "iy", "_g").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1")).drop("_g")


def parts(cells: DataFrame, keys: list[str], name: str = "part", room: int = R.ROOM) -> DataFrame:
    """Connected parts (4-neighbourhood) per key: runs ``(keys, <name>, iy, x0, x1)``, numbered from 1."""
    return parts_of_runs(stage(to_runs(cells, keys), "runs"), keys, name, room, cut=False)


def parts_of_runs(runs: DataFrame, keys: list[str], name: str = "part", room: int = R.ROOM, cut: bool = True) -> DataFrame:
    """``parts`` of stored runs, with ``cut`` such that may end where another begins: keys of at most ``room`` runs are labelled many at a time in one task, larger ones by rounds."""
    large = stage(R.large_keys(runs, keys, room), "large")
    small = R.label_runs(runs.join(F.broadcast(large), keys, "left_anti"), keys, name, cut)
    if large.isEmpty():
        return small
    rest = runs.join(F.broadcast(large), keys, "left_semi")
    return small.unionByName(_parts_by_rounds(whole_runs(rest, keys) if cut else rest, keys, name))


def whole_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that touch end to end become one. The window spans one grid row of one shape."""
    w = Window.partitionBy(*keys, "iy").orderBy("x0")
    g = runs.withColumn("_new", F.coalesce((F.col("x0") != F.lag("x1").over(w) + 1).cast("int"), F.lit(1)))
    g = g.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "iy", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def _parts_by_rounds(runs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs are the nodes of the component search, so it sees a few rows per grid line rather than every cell."""
    node = F.struct(*keys, "iy", "x0")
    runs = stage(runs.withColumn("node", node), "runs")
    up = runs.select(*keys, (F.col("iy") - 1).alias("iy"), F.col("x0").alias("ux0"), F.col("x1").alias("ux1"), F.col("node").alias("un"))
    links = runs.join(up, [*keys, "iy"]).where("x0 <= ux1 AND ux0 <= x1").select(F.col("node").alias("u"), F.col("un").alias("v"))
    comp = connected_components(links)
    lab = runs.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # One row per part: numbering looks at parts, not at cells.
    w = Window.partitionBy(*keys).orderBy("component")
    num = lab.select(*keys, "component").distinct().withColumn(name, F.row_number().over(w).cast("long"))
    return lab.join(num, [*keys, "component"]).select(*keys, name, "iy", "x0", "x1")


def as_runs(cells: DataFrame) -> DataFrame:
    """A coverage given as cells or runs, as runs; a cell is a run of its own."""
    if "ix" in cells.columns:
        cells = cells.withColumn("x0", F.col("ix")).withColumn("x1", F.col("ix")).drop("ix")
    return cells.select(*[F.col(c).cast("long").alias(c) if c in ("iy", "x0", "x1") else c for c in cells.columns])


def count_cells() -> Column:
    return F.sum(F.col("x1") - F.col("x0") + 1)


def touching(cells: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Numbers ``k`` of pairs of side-by-side cells of the same key, by ``cols`` of both as ``a_`` and ``b_``."""
    by = [*keys, *[f"{ab}_{c}" for ab in "ab" for c in cols]]
    return R.touching(as_runs(cells), keys, cols).groupBy(*by).agg(F.sum("k").alias("k"))


def measure(cells: DataFrame, keys: list[str], c: float) -> DataFrame:
    """Cell count, area and outline length per key of cells or runs."""
    n = as_runs(cells).groupBy(*keys).agg(count_cells().alias("n"))
    m = n.join(touching(cells, keys, []), keys, "left").withColumn("inner", F.coalesce("k", F.lit(0)))
    return m.select(*keys, "n", (F.col("n") * (c * c)).alias("area"), ((F.col("n") * 4 - F.col("inner") * 2) * c).alias("perimeter"))


def cut_by_parent(cells: DataFrame, keys: list[str], up: int, whole_below: int) -> DataFrame:
    """Cut every key's cells along the coarse grid; keys with fewer than ``whole_below`` cells stay whole.

    Returns cells, or runs if they are given, with ``px, py`` (the coarse cell, -1 for whole ones) and ``piece`` (the
    connected part within it). Runs of a key have to be maximal and must not overlap.
    """
    of = [*keys, "px", "py"]
    if "ix" in cells.columns:
        size = cells.groupBy(*keys).agg(F.count("*").alias("_n"))
        big = cells.join(size, keys).withColumn("_cut", F.col("_n") >= whole_below)
        coarse = lambda c: F.when(F.col("_cut"), F.shiftright(c, up)).otherwise(-1).cast("long").alias(f"p{c[1]}")
        return run_cells(parts(big.select(*keys, "ix", "iy", coarse("ix"), coarse("iy")), of, "piece"))
    size = cells.groupBy(*keys).agg((count_cells() >= whole_below).alias("_cut"))
    r = as_runs(cells).join(size, keys).select(
        *keys, "iy", "x0", "x1", "_cut", F.expr(f"CASE WHEN _cut THEN shiftright(iy, {up}) ELSE -1L END").alias("py"),
        F.explode(F.expr(f"CASE WHEN _cut THEN sequence(shiftright(x0, {up}), shiftright(x1, {up})) ELSE array(-1L) END")).alias("px"),
    )
    first = F.shiftleft("px", up)
    r = r.withColumn("x0", F.when(F.col("_cut"), F.greatest("x0", first)).otherwise(F.col("x0")))
    r = r.withColumn("x1", F.when(F.col("_cut"), F.least("x1", first + ((1 << up) - 1))).otherwise(F.col("x1")))
    return parts_of_runs(stage(r.select(*of, "iy", "x0", "x1"), "runs"), of, "piece", cut=False)


def shared_border(cells: DataFrame, keys: list[str], piece: list[str], c: float) -> DataFrame:
    """Common border of neighbouring pieces of one key: ordered pairs ``(keys, a, b, border)``. ``cells`` are cells or runs."""
    p = as_runs(cells).select(*keys, F.struct(*piece).alias("p"), "iy", "x0", "x1")
    t = _both_ways(touching(p, keys, ["p"]), keys, "p")
    return t.groupBy(*keys, "a", "b").agg((F.sum("k") * c).alias("border"))


def _both_ways(t: DataFrame, keys: list[str], piece: str) -> DataFrame:
    """``(keys, a, b, k)`` of different pieces that touch, each pair from both sides."""
    a, b = F.col(f"a_{piece}"), F.col(f"b_{piece}")
    both = F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b"))))
    return t.where(a != b).select(*keys, both.alias("x"), "k").select(*keys, "x.a", "x.b", "k")


def _merge(cells: DataFrame, keys: list[str], piece: list[str], within: list, **rule) -> DataFrame:
    """Cells (or runs) with ``merged``, the piece that theirs ends in when pieces of equal keys and ``within`` are contracted."""
    place = ["ix", "iy"] if "ix" in cells.columns else ["iy", "x0", "x1"]
    p = stage(cells.select(*keys, F.struct(*piece).alias("pid"), *[w.alias(f"_w{i}") for i, w in enumerate(within)], *place), "pieces")
    group = [*keys, *[f"_w{i}" for i in range(len(within))]]
    size = as_runs(p).groupBy(*group, "pid").agg(count_cells().alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"))
    t = stage(touching(p, keys, ["pid", *group[len(keys):]]), "touching")
    inner = t.where("a_pid = b_pid").groupBy(*keys, F.col("a_pid").alias("pid")).agg(F.sum("k").alias("inner"))
    nodes = size.join(inner, [*keys, "pid"], "left").withColumn("sides", 4 * F.col("n") - 2 * F.coalesce("inner", F.lit(0)))
    for w in group[len(keys):]:
        t = t.where(F.col(f"a_{w}") == F.col(f"b_{w}")).withColumnRenamed(f"a_{w}", w)
    edges = _both_ways(t, group, "pid").groupBy(*group, "a", "b").agg(F.sum("k").alias("k"))
    owner = contract(nodes, edges, group, **rule).select(*keys, "pid", F.col("owner").alias("merged"))
    return p.join(owner, [*keys, "pid"]).select(*keys, "merged", *place)


def merge_small(cells: DataFrame, keys: list[str], piece: list[str], max_cells: int) -> DataFrame:
    """Pieces of at most ``max_cells`` cells merge, in ascending order of (cells, id), into the neighbour with the longest common border.

    A piece that has grown beyond the limit before its turn stays. Neighbours are pieces that haven't merged away and whose
    first box touches the piece's present box (see ``contract``). Returns cells (or runs) with ``merged``, the piece they end in.
    """
    return _merge(cells, keys, piece, [], max_size=max_cells, boxed=True)


def merge_by_parent(cells: DataFrame, keys: list[str], piece: list[str], parent: list, min_share: float = 0.3) -> DataFrame:
    """Pieces inside one coarse parent merge, in ascending order of (cells, id), into the later one that shares most of their outline.

    A merge needs more than ``min_share`` of the outline that the piece has by then; the outline grows with what has merged into it.
    ``parent`` are columns over ``piece``. Returns cells (or runs) with ``merged``, the piece they end in.
    """
    return _merge(cells, keys, piece, parent, min_share=min_share, later_only=True)


def piece_ids(pieces: DataFrame, levels: tuple[int, ...] = (17, 18, 19)) -> DataFrame:
    """Id of a piece (``lng, lat`` of its centre): the tile at the first level where it is alone."""
    t = pieces
    for z in levels:
        t = t.withColumn(f"_t{z}", C.tile(F.col("lng"), F.col("lat"), z))
        t = t.withColumn(f"_k{z}", C.tile_pack(F.col(f"_t{z}.x"), F.col(f"_t{z}.y"), z)).drop(f"_t{z}")
    pick = F.col(f"_k{levels[-1]}")
    for z in reversed(levels[:-1]):
        n = t.groupBy(f"_k{z}").agg(F.count("*").alias(f"_n{z}"))
        t = t.join(n, f"_k{z}")
        pick = F.when(F.col(f"_n{z}") == 1, F.col(f"_k{z}")).otherwise(pick)
    return t.withColumn("shadow_id", pick).select(*pieces.columns, "shadow_id")


def merge_same_id(pieces: DataFrame, cells: DataFrame, piece: str, attrs: list[str]) -> DataFrame:
    """Pieces with the same id become one: cells (or runs) united, attributes of the largest one."""
    top = pieces.groupBy("shadow_id").agg(
        F.max_by(F.struct(*attrs), F.struct("n", piece)).alias("m"), F.count("*").alias("merged_from")
    )
    united = as_runs(cells).join(pieces.select(piece, "shadow_id"), piece).select("shadow_id", "iy", "x0", "x1")
    n = union_words(R.run_words(united), "shadow_id").groupBy("shadow_id").agg(F.sum(F.expr("bit_count(m)")).alias("n"))
    return top.join(n, "shadow_id").select("shadow_id", "m.*", "n", "merged_from")
