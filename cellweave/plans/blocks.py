"""Blocks minus areas: coverage, gaps, parts, pieces and their merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import outline as L
from ..operators import overlay as O
from ..operators import runs as W
from ..operators import spatial as S
from ..session import stage
from . import fixtures as X
from .grid import AREA_CTES, BLOCK_CTES

QUERIES, ORACLE = {}, {}
CELL = 0.00041
UP = 3  # coarse cells are 8 x 8 cells
WHOLE_BELOW = 30  # 5e4 / 1e10 squared degrees in cells of 0.00041
SMALL = 35  # 6e4 / 1e10


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def block_shapes(spark, sf):
    return S.shapes(X.blocks(spark, sf), "id", "polygon", ["category"])


def area_shapes(spark, sf):
    return S.shapes(X.areas(spark, sf), "id", "polygon")


def block_cells(spark, sf):
    return O.polyfill(block_shapes(spark, sf), CELL).select("id", "ix", "iy")


def area_words(spark, sf):
    return O.union_words(O.polyfill_words(area_shapes(spark, sf), CELL))


def block_words(spark, sf):
    """Words of every block, with the cells of areas in them."""
    return O.with_other(O.polyfill_words(block_shapes(spark, sf), CELL), area_words(spark, sf))


def gap_runs(spark, sf):
    """Block cells without area cells, as runs cut at words; blocks that lost cells are opened by one cell."""
    words = stage(block_words(spark, sf).select("id", "iy", "wx", F.expr("m & ~o").alias("m"), F.expr("m & o <> 0").alias("lost")), "gap-words")
    kept = words.groupBy("id").agg(F.max("lost").alias("lost")).where("NOT lost").select("id")
    left = words.where("m <> 0").drop("lost")
    opened = O.open_words(left.join(kept, "id", "left_anti"), ["id"]).unionByName(left.join(kept, "id", "left_semi"))
    return stage(W.word_runs(opened.select("id", "iy", "wx", "m")), "opened")


def _cells_sql(name: str, boxes: str, edges: str) -> str:
    """CTE ``name`` (id, ix, iy): every cell centre of the box tested against the outline."""
    return f"""{name}_c AS (SELECT id, unnest(range(CAST(floor(xmin / {CELL}) AS BIGINT) - 1, CAST(ceil(xmax / {CELL}) AS BIGINT) + 1)) AS ix, ymin, ymax FROM {boxes}),
{name}_d AS (SELECT id, ix, unnest(range(CAST(floor(ymin / {CELL}) AS BIGINT) - 1, CAST(ceil(ymax / {CELL}) AS BIGINT) + 1)) AS iy FROM {name}_c),
{name} AS (SELECT d.id, ix, iy FROM {name}_d d JOIN {edges} e ON e.id = d.id GROUP BY d.id, ix, iy
  HAVING sum(CASE WHEN (y1 > (iy + 0.5e0) * {CELL}e0) <> (y2 > (iy + 0.5e0) * {CELL}e0) AND (ix + 0.5e0) * {CELL}e0 < (x2 - x1) * ((iy + 0.5e0) * {CELL}e0 - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"""


BC = f"{BLOCK_CTES}, {_cells_sql('bc', 'bb', 'be')}"
AC = f"{AREA_CTES}, {_cells_sql('ac', 'ab', 'ae')}"
NINE = "(VALUES (-1), (0), (1)) vx(dx), (VALUES (-1), (0), (1)) vy(dy)"
GAP = f"""{BC}, {AC}, un AS (SELECT DISTINCT ix, iy FROM ac),
lft AS (SELECT b.* FROM bc b WHERE NOT EXISTS (SELECT 1 FROM un WHERE un.ix = b.ix AND un.iy = b.iy)),
same AS (SELECT a.id FROM (SELECT id, count(*) AS n FROM bc GROUP BY id) a JOIN (SELECT id, count(*) AS n FROM lft GROUP BY id) b ON a.id = b.id AND a.n = b.n),
ero AS (SELECT id, ix + dx AS ix, iy + dy AS iy FROM lft, {NINE} WHERE id NOT IN (SELECT id FROM same) GROUP BY 1, 2, 3 HAVING count(*) = 9),
gap AS (SELECT DISTINCT id, ix + dx AS ix, iy + dy AS iy FROM ero, {NINE} UNION ALL SELECT * FROM lft WHERE id IN (SELECT id FROM same))"""


@query
def polyfill(spark, sf):
    return block_cells(spark, sf).withColumnRenamed("id", "blockid")


ORACLE["polyfill"] = f"WITH {BC} SELECT id AS blockid, ix, iy FROM bc"


@query
def cells_union(spark, sf):
    return O.union_cells(O.polyfill(area_shapes(spark, sf), CELL))


ORACLE["cells_union"] = f"WITH {AC} SELECT DISTINCT ix, iy FROM ac"


@query
def cells_difference(spark, sf):
    """Cells of every block left after all areas are taken away."""
    left = block_words(spark, sf).select("id", "iy", "wx", F.expr("m & ~o").alias("m"))
    return O.run_cells(W.word_runs(left)).select(F.col("id").alias("blockid"), "ix", "iy")


ORACLE["cells_difference"] = f"""WITH {BC}, {AC} SELECT b.id AS blockid, b.ix, b.iy FROM bc b WHERE (ix, iy) NOT IN (SELECT (ix, iy) FROM ac)"""


@query
def cells_clip(spark, sf):
    """Cells of every block that lie in some area."""
    common = block_words(spark, sf).select("id", F.expr("bit_count(m & o)").cast("long").alias("n")).where("n > 0")
    return common.groupBy(F.col("id").alias("blockid")).agg(F.sum("n").alias("n_common"))


ORACLE["cells_clip"] = f"""WITH {BC}, {AC}, un AS (SELECT DISTINCT ix, iy FROM ac)
SELECT b.id AS blockid, count(*) AS n_common FROM bc b JOIN un ON un.ix = b.ix AND un.iy = b.iy GROUP BY 1"""


@query
def opening(spark, sf):
    return O.run_cells(gap_runs(spark, sf)).select(F.col("id").alias("blockid"), "ix", "iy")


ORACLE["opening"] = f"WITH {GAP} SELECT id AS blockid, ix, iy FROM gap"


@query
def grow_shrink(spark, sf):
    """Cell counts of every area grown and shrunk by one cell."""
    a = stage(O.polyfill(area_shapes(spark, sf), CELL).select("id", "ix", "iy"), "area-cells")
    n = a.groupBy("id").agg(F.count("*").alias("n"))
    g = O.grow(a, ["id"]).groupBy("id").agg(F.count("*").alias("n_grown"))
    s = O.shrink(a, ["id"]).groupBy("id").agg(F.count("*").alias("n_shrunk"))
    return n.join(g, "id").join(s, "id", "left").select(F.col("id").alias("aoi_id"), "n", "n_grown", F.coalesce("n_shrunk", F.lit(0)).alias("n_shrunk"))


ORACLE["grow_shrink"] = f"""WITH {AC}, c9 AS (SELECT id, ix + dx AS ix, iy + dy AS iy, count(*) AS k FROM ac, {NINE} GROUP BY 1, 2, 3),
s AS (SELECT id, count(*) AS n_grown, sum(CASE WHEN k = 9 THEN 1 ELSE 0 END) AS n_shrunk FROM c9 GROUP BY id), n AS (SELECT id, count(*) AS n FROM ac GROUP BY id)
SELECT n.id AS aoi_id, n, n_grown, CAST(n_shrunk AS BIGINT) AS n_shrunk FROM n JOIN s ON s.id = n.id"""


def _runs_sql(cells: str, keys: str, name: str) -> str:
    """CTEs ``name`` (keys, iy, x0, x1, label): runs with the smallest run of their connected part."""
    ks = [k.strip() for k in keys.split(",")]
    eq = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    ak = ", ".join(f"a.{k}" for k in ks)
    return f"""{name}_g AS (SELECT {keys}, iy, ix, ix - row_number() OVER (PARTITION BY {keys}, iy ORDER BY ix) AS g FROM {cells}),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY {keys}, iy, x0) AS rid FROM (SELECT {keys}, iy, min(ix) AS x0, max(ix) AS x1 FROM {name}_g GROUP BY {keys}, iy, g) t),
{name}_k AS (SELECT a.rid AS u, b.rid AS v FROM {name}_r a JOIN {name}_r b ON {eq} AND (b.iy = a.iy + 1 OR b.iy = a.iy - 1) AND a.x0 <= b.x1 AND b.x0 <= a.x1),
{name}_w(s, t) AS (SELECT rid, rid FROM {name}_r UNION SELECT w.s, k.v FROM {name}_w w JOIN {name}_k k ON k.u = w.t),
{name}_m AS (SELECT s, min(t) AS label FROM {name}_w GROUP BY s),
{name} AS (SELECT {ak}, a.iy, a.x0, a.x1, label FROM {name}_r a JOIN {name}_m m ON m.s = a.rid)"""


@query
def parts(spark, sf):
    """Connected parts of what remains of every block."""
    p = O.parts_of_runs(gap_runs(spark, sf), ["id"])
    return p.groupBy(F.col("id").alias("blockid"), "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.min("iy").alias("bottom"), F.max("iy").alias("top"))


PARTS = f"{GAP}, {_runs_sql('gap', 'id', 'pt')}, pn AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY label) AS part FROM pt)"
ORACLE["parts"] = f"""WITH RECURSIVE {PARTS}
SELECT id AS blockid, part, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n, min(iy) AS bottom, max(iy) AS top FROM pn GROUP BY 1, 2"""


def raw_gap_runs(spark, sf):
    """Runs (id, part, iy, x0, x1) of the remaining parts of all blocks, and what they measure, slivers dropped."""
    shapes = block_shapes(spark, sf)
    p = stage(O.parts_of_runs(gap_runs(spark, sf), ["id"]), "part-runs")
    m = O.measure(p, ["id", "part"], CELL).join(shapes.select("id", "category"), "id")
    m = m.where(~G.is_sliver(F.col("area"), F.col("perimeter"), F.col("category")))
    return p, m


@query
def raw_gap(spark, sf):
    """Parts of blocks not covered by any area, without slivers."""
    _, m = raw_gap_runs(spark, sf)
    return m.select(
        F.col("id").alias("blockid"), F.col("category").alias("detailed_category"), "part", "n",
        G.rnd(F.col("area") * 1e10, 2).alias("area_e10"), G.rnd(F.col("perimeter"), 6).alias("perimeter"),
    )


_THIN = "(p / ar * (p / 20))"
RAW = f"""{PARTS}, pcell AS (SELECT id, part, iy, unnest(range(x0, x1 + 1)) AS ix FROM pn),
pin AS (SELECT a.id, a.part, count(*) AS k FROM pcell a JOIN pcell b ON a.id = b.id AND a.part = b.part AND ((b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.iy = a.iy + 1 AND b.ix = a.ix)) GROUP BY 1, 2),
pme AS (SELECT c.id, c.part, c.n, n * ({CELL}e0 * {CELL}e0) AS ar, (4 * n - 2 * coalesce(k, 0)) * {CELL}e0 AS p
  FROM (SELECT id, part, count(*) AS n FROM pcell GROUP BY 1, 2) c LEFT JOIN pin ON pin.id = c.id AND pin.part = c.part),
raw AS (SELECT m.*, b.category FROM pme m JOIN b ON b.id = m.id WHERE NOT (category NOT IN ('居住', '办公', '商业') AND {_THIN} > 2 AND
  (ar * 1e10 < 500 OR ({_THIN} > 20e0 / 9 AND ar * 1e10 <= 5000) OR ({_THIN} > 10 AND ar * 1e10 <= 100000))))"""
ORACLE["raw_gap"] = f"""WITH RECURSIVE {RAW}
SELECT id AS blockid, category AS detailed_category, part, n, {X.r_sql('ar * 1e10', 2)} AS area_e10, {X.r_sql('p', 6)} AS perimeter FROM raw"""


def measured(df, keys: list[str]):
    """Points, area, outline and square metres of polygon text, read back from the text."""
    edges = G.edges_of(G.parse_polygon(F.col("polygon")))
    return df.withColumn("_e", edges).select(
        *keys, "polygon", F.size("_e").cast("long").alias("n_points"), G.rnd(G.area(F.col("_e")) * 1e10, 2).alias("area_e10"),
        G.rnd(G.perimeter(F.col("_e")), 6).alias("perimeter"), G.rnd(G.geodesic_area(F.col("_e")), 2).alias("area_m2"),
    )


def outline_sql(cells: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys, n_points, area_e10, perimeter, area_m2) from cells alone: corners by the four cells around a lattice point."""
    ks = [k.strip() for k in keys.split(",")]
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    e2, e1 = f"{G.WGS84_E2!r}e0", f"{G.WGS84_E2 ** 0.5!r}e0"
    q = lambda y: f"((1 - {e2}) * (sin(radians({y})) / (1 - {e2} * sin(radians({y})) * sin(radians({y}))) + atanh(sin(radians({y})) * {e1}) / {e1}))"
    band = f"radians({CELL}e0) * ({q(f'(iy + 1) * {CELL}e0')} - {q(f'iy * {CELL}e0')}) * ({G.WGS84_A!r}e0 * {G.WGS84_A!r}e0 / 2)"
    return f"""{name}_v AS (SELECT {keys}, ix + dx AS x, iy + dy AS y, sum(bit) AS bits FROM {cells}, (VALUES (1, 1, 1), (0, 1, 2), (1, 0, 4), (0, 0, 8)) v(dx, dy, bit) GROUP BY ALL),
{name}_p AS (SELECT {keys}, sum(CASE WHEN bits IN (6, 9) THEN 2 WHEN bits IN (3, 5, 10, 12, 15) THEN 0 ELSE 1 END) AS n_points FROM {name}_v GROUP BY {keys}),
{name}_i AS (SELECT {", ".join(f"a.{k}" for k in ks)}, count(*) AS k FROM {cells} a JOIN {cells} b ON {eq('a', 'b')} AND ((b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.iy = a.iy + 1 AND b.ix = a.ix)) GROUP BY ALL),
{name}_c AS (SELECT {keys}, count(*) AS n, sum({band}) AS m2 FROM {cells} GROUP BY {keys}),
{name} AS (SELECT {", ".join(f"c.{k}" for k in ks)}, CAST(n_points AS BIGINT) AS n_points, {X.r_sql(f'n * ({CELL}e0 * {CELL}e0) * 1e10', 2)} AS area_e10, {X.r_sql(f'(4 * n - 2 * coalesce(i.k, 0)) * {CELL}e0', 6)} AS perimeter,
  {X.r_sql('m2', 2)} AS area_m2 FROM {name}_c c JOIN {name}_p p ON {eq('p', 'c')} LEFT JOIN {name}_i i ON {eq('i', 'c')})"""


@query
def part_outlines(spark, sf):
    """Outlines, with holes, of the parts of blocks that no area covers, read back from their polygon text."""
    p, m = raw_gap_runs(spark, sf)
    runs = p.join(m.select("id", "part"), ["id", "part"], "left_semi").withColumn("one", F.lit(1))
    return measured(L.as_polygons(runs, ["id", "part"], "one", CELL), ["id", "part"]).withColumnRenamed("id", "blockid").drop("polygon")


ORACLE["part_outlines"] = f"""WITH RECURSIVE {RAW}, kept AS (SELECT c.* FROM pcell c JOIN raw r ON r.id = c.id AND r.part = c.part), {outline_sql('kept', 'id, part', 'ln')}
SELECT id AS blockid, part, n_points, area_e10, perimeter, area_m2 FROM ln"""


def piece_runs(spark, sf):
    """Gap parts cut along the coarse grid, as runs: (id, part, px, py, piece, iy, x0, x1).

    Blocks whose id stands more than once have cells that come more than once; these are cut cell by cell.
    """
    p, m = raw_gap_runs(spark, sf)
    runs = stage(p.join(m.select("id", "part"), ["id", "part"], "left_semi"), "gap-part-runs")
    again = X.blocks(spark, sf).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    cut = O.cut_by_parent(runs.join(again, "id", "left_anti"), ["id", "part"], UP, WHOLE_BELOW)
    if not again.isEmpty():
        cells = O.run_cells(runs.join(again, "id", "left_semi"))
        cut = cut.unionByName(O.as_runs(O.cut_by_parent(cells, ["id", "part"], UP, WHOLE_BELOW)))
    return stage(cut, "piece-runs")


PIECE = ["px", "py", "piece"]


@query
def cut_pieces(spark, sf):
    return piece_runs(spark, sf).groupBy(F.col("id").alias("blockid"), "part", *PIECE).agg(O.count_cells().alias("n"))


CUT = f"""{RAW}, gc AS (SELECT c.id, c.part, c.ix, c.iy, CASE WHEN r.n >= {WHOLE_BELOW} THEN c.ix >> {UP} ELSE -1 END AS px, CASE WHEN r.n >= {WHOLE_BELOW} THEN c.iy >> {UP} ELSE -1 END AS py
  FROM pcell c JOIN raw r ON r.id = c.id AND r.part = c.part),
{_runs_sql('gc', 'id, part, px, py', 'cu')},
cn AS (SELECT *, dense_rank() OVER (PARTITION BY id, part, px, py ORDER BY label) AS piece FROM cu),
pc AS (SELECT id, part, px, py, piece, iy, unnest(range(x0, x1 + 1)) AS ix FROM cn)"""
ORACLE["cut_pieces"] = f"WITH RECURSIVE {CUT} SELECT id AS blockid, part, px, py, piece, count(*) AS n FROM pc GROUP BY 1, 2, 3, 4, 5"


@query
def shared_border(spark, sf):
    """Common border of neighbouring pieces, in degrees and as a share of the first piece's outline."""
    c = piece_runs(spark, sf)
    b = O.shared_border(c, ["id", "part"], PIECE, CELL)
    size = O.measure(c.select("id", "part", F.struct(*PIECE).alias("a"), "iy", "x0", "x1"), ["id", "part", "a"], CELL)
    r = b.join(size, ["id", "part", "a"])
    return r.select(
        F.col("id").alias("blockid"), "part", *[F.col(f"a.{k}").alias(f"a_{k}") for k in PIECE], *[F.col(f"b.{k}").alias(f"b_{k}") for k in PIECE],
        G.rnd(F.col("border"), 6).alias("border"), G.rnd(F.col("border") / F.col("perimeter"), 4).alias("share"),
    )


BORDER = f"""{CUT}, tn AS (SELECT a.id, a.part, a.px AS apx, a.py AS apy, a.piece AS ap, b.px AS bpx, b.py AS bpy, b.piece AS bp FROM pc a JOIN pc b ON a.id = b.id AND a.part = b.part
  AND ((b.iy = a.iy AND b.ix IN (a.ix - 1, a.ix + 1)) OR (b.ix = a.ix AND b.iy IN (a.iy - 1, a.iy + 1)))),
per AS (SELECT p.id, p.part, p.px, p.py, p.piece, p.n, 4 * p.n - coalesce(t.k, 0) AS sides FROM (SELECT id, part, px, py, piece, count(*) AS n FROM pc GROUP BY ALL) p
  LEFT JOIN (SELECT id, part, apx, apy, ap, count(*) AS k FROM tn WHERE apx = bpx AND apy = bpy AND ap = bp GROUP BY ALL) t ON t.id = p.id AND t.part = p.part AND t.apx = p.px AND t.apy = p.py AND t.ap = p.piece),
bo AS (SELECT id, part, apx, apy, ap, bpx, bpy, bp, count(*) AS k FROM tn WHERE apx <> bpx OR apy <> bpy OR ap <> bp GROUP BY ALL)"""
ORACLE["shared_border"] = f"""WITH RECURSIVE {BORDER}
SELECT b.id AS blockid, b.part, apx AS a_px, apy AS a_py, ap AS a_piece, bpx AS b_px, bpy AS b_py, bp AS b_piece, {X.r_sql(f'k * {CELL}e0', 6)} AS border,
  {X.r_sql(f'(k * {CELL}e0) / (sides * {CELL}e0)', 4)} AS share FROM bo b JOIN per p ON p.id = b.id AND p.part = b.part AND p.px = apx AND p.py = apy AND p.piece = ap"""


def merged_runs(spark, sf):
    m = stage(O.merge_small(piece_runs(spark, sf), ["id", "part"], PIECE, SMALL), "merged")
    return m.select("id", "part", *[F.col(f"merged.{k}").alias(k) for k in PIECE], "iy", "x0", "x1")


@query
def merge_small(spark, sf):
    """Small pieces merged one after the other, smallest first, into the neighbour with the longest common border."""
    return merged_runs(spark, sf).groupBy(F.col("id").alias("blockid"), "part", *PIECE).agg(O.count_cells().alias("n"))


def _contract_sql(name: str, nodes: str, edges: str, rule: str, order: str) -> str:
    """CTEs ``name`` (g, pk, owner): the sequential rule, one piece of every group ``g`` a step.

    ``nodes``: g, pk, n, sides, x0, x1, y0, y1; ``edges``: g, a, b, k. ``rule`` sees the piece (c) and its neighbour (q, with k).
    """
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n, pk) AS turn FROM {nodes}),
{name}_s(step, g, pk, owner) AS (SELECT 0, g, pk, pk FROM {name}_n UNION ALL (
  WITH w AS (SELECT * FROM {name}_s), o AS (SELECT w.*, n.n, n.sides, n.x0, n.x1, n.y0, n.y1, n.turn FROM w JOIN {name}_n n ON n.g = w.g AND n.pk = w.pk),
  a AS (SELECT o.g, o.pk FROM o WHERE o.turn = o.step + 1 AND o.pk = o.owner),
  i AS (SELECT a.g, sum(e.k) AS k FROM a JOIN w x ON x.g = a.g AND x.owner = a.pk JOIN {edges} e ON e.g = x.g AND e.a = x.pk JOIN w y ON y.g = e.g AND y.pk = e.b AND y.owner = a.pk GROUP BY a.g),
  c AS (SELECT a.g, a.pk, sum(o.n) AS n, sum(o.sides) - coalesce(max(i.k), 0) AS sides, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1
    FROM a JOIN o ON o.g = a.g AND o.owner = a.pk LEFT JOIN i ON i.g = a.g GROUP BY a.g, a.pk),
  b AS (SELECT a.g, y.owner, sum(e.k) AS k FROM a JOIN w x ON x.g = a.g AND x.owner = a.pk JOIN {edges} e ON e.g = x.g AND e.a = x.pk JOIN w y ON y.g = e.g AND y.pk = e.b WHERE y.owner <> a.pk GROUP BY 1, 2),
  p AS (SELECT c.g, c.pk, b.owner, row_number() OVER (PARTITION BY c.g ORDER BY b.k DESC, {order}) AS r FROM c JOIN b ON b.g = c.g JOIN {name}_n q ON q.g = b.g AND q.pk = b.owner WHERE {rule})
  SELECT w.step + 1, w.g, w.pk, coalesce(p.owner, w.owner) FROM w LEFT JOIN p ON p.g = w.g AND p.pk = w.owner AND p.r = 1
  WHERE w.step < (SELECT max(turn) FROM {name}_n))),
{name} AS (SELECT g, pk, owner FROM {name}_s WHERE step = (SELECT max(turn) FROM {name}_n))"""


MERGED = f"""{BORDER}, pid AS (SELECT *, row_number() OVER (ORDER BY id, part, px, py, piece) AS pk FROM per),
pbox AS (SELECT id, part, px, py, piece, min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM pc GROUP BY 1, 2, 3, 4, 5),
sgn AS (SELECT concat_ws('/', p.id, p.part) AS g, pk, n, sides, x0, x1, y0, y1 FROM pid p JOIN pbox b ON b.id = p.id AND b.part = p.part AND b.px = p.px AND b.py = p.py AND b.piece = p.piece),
sge AS (SELECT concat_ws('/', b.id, b.part) AS g, x.pk AS a, y.pk AS b, k FROM bo b JOIN pid x ON x.id = b.id AND x.part = b.part AND x.px = apx AND x.py = apy AND x.piece = ap
  JOIN pid y ON y.id = b.id AND y.part = b.part AND y.px = bpx AND y.py = bpy AND y.piece = bp),
{_contract_sql('sq', 'sgn', 'sge', f'c.n <= {SMALL} AND q.x0 <= c.x1 + 1 AND c.x0 <= q.x1 + 1 AND q.y0 <= c.y1 + 1 AND c.y0 <= q.y1 + 1', 'b.owner')},
mm AS (SELECT pk AS s, owner AS root FROM sq),
mg AS (SELECT r.id, r.part, r.px, r.py, r.piece, sum(p.n) AS n, mm.root FROM mm JOIN pid p ON p.pk = mm.s JOIN pid r ON r.pk = mm.root GROUP BY ALL)"""
ORACLE["merge_small"] = f"WITH RECURSIVE {MERGED} SELECT id AS blockid, part, px, py, piece, CAST(n AS BIGINT) AS n FROM mg"

SHARE = 0.3


@query
def merge_by_parent(spark, sf):
    """Merged pieces that share more than 0.3 of their outline with a larger one of the same coarse parent join it."""
    m = O.merge_by_parent(merged_runs(spark, sf), ["id", "part"], PIECE, [F.shiftright("px", 1), F.shiftright("py", 1)], SHARE)
    n = m.groupBy(F.col("id").alias("blockid"), "part", "merged").agg(O.count_cells().alias("n"))
    return n.select("blockid", "part", *[F.col(f"merged.{k}").alias(k) for k in PIECE], "n")


ORACLE["merge_by_parent"] = f"""WITH RECURSIVE {MERGED},
hk AS (SELECT pk, root FROM mm JOIN pid ON pk = s), hin AS (SELECT x.root, sum(e.k) AS k FROM sge e JOIN hk x ON x.pk = e.a JOIN hk y ON y.pk = e.b WHERE x.root = y.root GROUP BY 1),
hn AS (SELECT concat_ws('/', r.id, r.part, r.px >> 1, r.py >> 1) AS g, r.pk, sum(p.n) AS n, sum(p.sides) - coalesce(max(i.k), 0) AS sides, 0 AS x0, 0 AS x1, 0 AS y0, 0 AS y1
  FROM hk h JOIN pid p ON p.pk = h.pk JOIN pid r ON r.pk = h.root LEFT JOIN hin i ON i.root = h.root GROUP BY 1, 2),
he AS (SELECT a.g, x.root AS a, y.root AS b, sum(e.k) AS k FROM sge e JOIN hk x ON x.pk = e.a JOIN hk y ON y.pk = e.b JOIN hn a ON a.pk = x.root JOIN hn b ON b.pk = y.root WHERE x.root <> y.root AND a.g = b.g GROUP BY 1, 2, 3),
{_contract_sql('hq', 'hn', 'he', f"b.k / CAST(c.sides AS DOUBLE) > {SHARE}e0 AND (q.n, q.pk) > (SELECT (z.n, z.pk) FROM hq_n z WHERE z.g = c.g AND z.pk = c.pk)", 'q.n, q.pk')}
SELECT r.id AS blockid, r.part, r.px, r.py, r.piece, CAST(sum(n.n) AS BIGINT) AS n FROM hq JOIN hn n ON n.pk = hq.pk JOIN pid r ON r.pk = hq.owner GROUP BY 1, 2, 3, 4, 5"""


def _centres(runs):
    key = F.struct("id", "part", *PIECE)
    size = F.col("x1") - F.col("x0") + 1
    # Sums of halves are exact, so these are the averages over the cells.
    return runs.groupBy(key.alias("pk"), "id").agg(O.count_cells().alias("n"), F.sum((F.col("x0") + F.col("x1") + 1) / 2 * size).alias("_x"), F.sum((F.col("iy") + 0.5) * size).alias("_y")).select(
        "pk", "id", "n", (F.col("_x") / F.col("n") * CELL).alias("lng"), (F.col("_y") / F.col("n") * CELL).alias("lat"))


@query
def piece_ids(spark, sf):
    """Tile id of every merged piece, finer where the coarse tile is shared."""
    t = O.piece_ids(_centres(merged_runs(spark, sf)))
    return t.select(F.col("id").alias("blockid"), F.col("pk.part").alias("part"), *[F.col(f"pk.{k}").alias(k) for k in PIECE], "n", "shadow_id")


def _tile_sql(z):
    n = 1 << z
    return (
        f"{z} * 72057594037927936 + CAST(floor((lng + 180) / 360 * {n}) AS BIGINT) * 268435456 + "
        f"CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {n}) AS BIGINT) AS k{z}"
    )


IDS = f"""{MERGED}, mc AS (SELECT m.root, c.ix, c.iy FROM pc c JOIN pid p ON p.id = c.id AND p.part = c.part AND p.px = c.px AND p.py = c.py AND p.piece = c.piece JOIN mm m ON m.s = p.pk),
ctr AS (SELECT root, count(*) AS n, avg(ix + 0.5e0) * {CELL}e0 AS lng, avg(iy + 0.5e0) * {CELL}e0 AS lat FROM mc GROUP BY root),
kk AS (SELECT root, n, {_tile_sql(17)}, {_tile_sql(18)}, {_tile_sql(19)} FROM ctr),
ids AS (SELECT root, n, CASE WHEN count(*) OVER (PARTITION BY k17) = 1 THEN k17 WHEN count(*) OVER (PARTITION BY k18) = 1 THEN k18 ELSE k19 END AS shadow_id FROM kk)"""
ORACLE["piece_ids"] = f"""WITH RECURSIVE {IDS}
SELECT p.id AS blockid, p.part, p.px, p.py, p.piece, i.n, shadow_id FROM ids i JOIN pid p ON p.pk = i.root"""


@query
def same_id_merge(spark, sf):
    """Pieces of different blocks that share an id become one."""
    runs = merged_runs(spark, sf)
    p = stage(O.piece_ids(_centres(runs)), "piece-ids")
    c = runs.select(F.struct("id", "part", *PIECE).alias("pk"), "iy", "x0", "x1")
    m = O.merge_same_id(p.withColumn("blockid", F.col("id")), c, "pk", ["blockid"])
    return m.select("shadow_id", "blockid", "n", "merged_from")


ORACLE["same_id_merge"] = f"""WITH RECURSIVE {IDS},
top AS (SELECT shadow_id, id AS blockid, count(*) OVER (PARTITION BY shadow_id) AS merged_from, row_number() OVER (PARTITION BY shadow_id ORDER BY i.n DESC, root DESC) AS rn FROM ids i JOIN pid p ON p.pk = i.root),
cnt AS (SELECT shadow_id, count(*) AS n FROM (SELECT DISTINCT shadow_id, ix, iy FROM mc JOIN ids ON ids.root = mc.root) t GROUP BY 1)
SELECT t.shadow_id, blockid, n, merged_from FROM top t JOIN cnt c ON c.shadow_id = t.shadow_id WHERE rn = 1"""
