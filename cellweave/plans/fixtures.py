"""Derived inputs: the delivery and map tables computed from the standard test tables.

Written as SQL text that runs on any engine; ``{div}`` is the integer division operator.
Spark builds outline text from the shape rows; the checking SQL builds edges from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit outlines (counter-clockwise shell, clockwise hole), scaled by r around (cx, cy).
OUTLINES: dict[str, list[list[tuple[float, float]]]] = {
    "square": [[(-1, -1), (1, -1), (1, 1), (-1, 1)]],
    "tri": [[(-1, -1), (1, -1), (0, 1)]],
    "L": [[(-1, -1), (1, -1), (1, 0), (0, 0), (0, 1), (-1, 1)]],
    "hole": [[(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)]],
}

AREA_SQL = """
SELECT k AS id,
  116e0 + ((kk * 7919) % 10007) / 10007e0 * 0.5e0 + 0.0007e0 * moved AS cx,
  39.7e0 + ((kk * 104729) % 10009) / 10009e0 * 0.5e0 + 0.0005e0 * moved AS cy,
  0.0006e0 + (k % 5) * 0.0002e0 AS r,
  CASE WHEN k % 11 = 0 THEN 'hole' WHEN k % 3 = 0 THEN 'square' WHEN k % 3 = 1 THEN 'tri' ELSE 'L' END AS shape
FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 1 ELSE p_partkey END AS kk,
             CASE WHEN p_partkey % 4 = 3 AND p_partkey % 20 <> 7 THEN 1 ELSE 0 END AS moved FROM {part}) t
"""

BLOCK_SQL = """
SELECT c_custkey AS id,
  116e0 + ((c_custkey * 15485) % 9973) / 9973e0 * 0.5e0 AS cx,
  39.7e0 + ((c_custkey * 32452) % 9967) / 9967e0 * 0.5e0 AS cy,
  0.003e0 + (c_custkey % 4) * 0.0005e0 AS r,
  CASE WHEN c_custkey % 4 = 3 THEN 'L' ELSE 'square' END AS shape,
  CASE c_mktsegment WHEN 'FURNITURE' THEN '居住' WHEN 'HOUSEHOLD' THEN '办公' WHEN 'MACHINERY' THEN '商业'
    WHEN 'BUILDING' THEN '工业' ELSE '水系' END AS category
FROM {customer}
"""

# Rectangles, given as their lower-left corner and side.
REGION_SQL = """
SELECT CAST(100 + n_nationkey AS BIGINT) AS id, 116e0 + 0.1e0 * (n_nationkey % 5) AS x0,
  39.7e0 + 0.1e0 * (n_nationkey {div} 5) AS y0, 0.1e0 AS side,
  CAST(n_regionkey AS BIGINT) AS parentcode, n_name AS name, CAST(2 AS BIGINT) AS level
FROM {nation} WHERE n_nationkey <> 24
"""

PING_SQL = """
SELECT event_id AS id, user_id,
  116e0 + ((user_id * 7919 + (event_id % 7) * 13) % 10007) / 10007e0 * 0.5e0 AS lng,
  39.7e0 + ((user_id * 104729 + (event_id % 5) * 11) % 10009) / 10009e0 * 0.5e0 AS lat,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS is_dau, event_type, ts
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL over the parquet tables it names."""
    names = [n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
             if "{" + n + "}" in sql]
    return spark.sql(sql.replace("{div}", "div"), **{n: table(spark, sf_dir, n) for n in names})


def for_oracle(sql: str) -> str:
    """The same SQL for the checking engine, where the tables are views."""
    s = sql.replace("{div}", "//")
    for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        s = s.replace("{" + n + "}", n)
    return s


def outline_wkt(cx: str = "cx", cy: str = "cy", r: str = "r", shape: str = "shape") -> Column:
    """WKT text of a scaled unit outline."""

    def pt(dx, dy):
        return f"(({cx}) + ({float(dx)}D) * ({r})) || ' ' || (({cy}) + ({float(dy)}D) * ({r}))"

    cases = []
    for name, rings in OUTLINES.items():
        body = " || '), (' || ".join(" || ', ' || ".join(pt(*p) for p in ring + ring[:1]) for ring in rings)
        cases.append(f"WHEN {shape} = '{name}' THEN 'POLYGON ((' || {body} || '))'")
    return F.expr("CASE " + " ".join(cases) + " END")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, polygon (WKT)."""
    return run(spark, sf_dir, AREA_SQL).select("id", outline_wkt().alias("polygon"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, polygon (WKT)."""
    return run(spark, sf_dir, BLOCK_SQL).select("id", "category", outline_wkt().alias("polygon"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (code), parentcode, name, level, polygon (WKT)."""
    d = run(spark, sf_dir, REGION_SQL)
    w = F.expr(
        "'POLYGON ((' || x0 || ' ' || y0 || ', ' || (x0 + side) || ' ' || y0 || ', ' || (x0 + side) || ' ' || (y0 + side) "
        "|| ', ' || x0 || ' ' || (y0 + side) || ', ' || x0 || ' ' || y0 || '))'"
    )
    return d.select("id", "parentcode", "name", "level", w.alias("polygon"))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PING_SQL)


# ---- the same inputs as edge rows, for the checking engine -------------------------------------


def unit_edges() -> str:
    """VALUES rows (shape, ring, pos, dx1, dy1, dx2, dy2)."""
    rows = []
    for name, rings in OUTLINES.items():
        for ri, ring in enumerate(rings):
            for i, (x, y) in enumerate(ring):
                x2, y2 = ring[(i + 1) % len(ring)]
                rows.append(f"('{name}', {ri}, {i}, {float(x)}e0, {float(y)}e0, {float(x2)}e0, {float(y2)}e0)")
    return "(VALUES " + ", ".join(rows) + ") u(shape, ring, pos, dx1, dy1, dx2, dy2)"


def edges_cte(name: str, src: str, extra: str = "") -> str:
    """CTE ``name``: edge rows (id, ring, pos, x1, y1, x2, y2) of the centred shapes in ``src``."""
    return (
        f"{name} AS (SELECT s.id{extra}, u.ring, u.pos, s.cx + u.dx1 * s.r AS x1, s.cy + u.dy1 * s.r AS y1, "
        f"s.cx + u.dx2 * s.r AS x2, s.cy + u.dy2 * s.r AS y2 FROM {src} s JOIN {unit_edges()} ON u.shape = s.shape)"
    )


def region_edges_cte(name: str, src: str) -> str:
    return (
        f"{name} AS (SELECT id, 0 AS ring, pos, CASE WHEN pos IN (1, 2) THEN x0 + side ELSE x0 END AS x1, "
        "CASE WHEN pos IN (2, 3) THEN y0 + side ELSE y0 END AS y1, CASE WHEN pos IN (0, 1) THEN x0 + side ELSE x0 END AS x2, "
        f"CASE WHEN pos IN (1, 2) THEN y0 + side ELSE y0 END AS y2 FROM {src}, (VALUES (0), (1), (2), (3)) p(pos))"
    )


def box_cte(name: str, edges: str) -> str:
    """CTE ``name``: box, area and perimeter per shape, area relative to the box corner."""
    return (
        f"{name} AS (SELECT e.id, any_value(b.xmin) AS xmin, any_value(b.ymin) AS ymin, any_value(b.xmax) AS xmax, any_value(b.ymax) AS ymax, "
        "sum((x1 - b.xmin) * (y2 - b.ymin) - (x2 - b.xmin) * (y1 - b.ymin)) / 2 AS area, "
        "sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS perimeter "
        f"FROM {edges} e JOIN (SELECT id, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM {edges} GROUP BY id) b "
        "ON b.id = e.id GROUP BY e.id)"
    )


def r_sql(expr: str, digits: int) -> str:
    """Rounded double without negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0e0 ELSE round({expr}, {digits}) END"


def overlap_ctes(left_e: str, left_b: str, right_e: str, right_b: str, cond: str = "TRUE", name: str = "hit") -> str:
    """CTEs ending in ``name`` (l_id, r_id, inter, touch, l_area, r_area): brute-force over all box-overlapping pairs."""
    def line(s, x):
        return f"CASE WHEN {s}x1 = {s}x2 THEN 0e0 ELSE {s}y1 + ({s}y2 - {s}y1) * (({x} - {s}x1) / ({s}x2 - {s}x1)) END"

    def turn(p, q):
        return (
            f"sign(({p}x2 - {p}x1) * ({q}y1 - {p}y1) - ({p}y2 - {p}y1) * ({q}x1 - {p}x1)) * "
            f"sign(({p}x2 - {p}x1) * ({q}y2 - {p}y1) - ({p}y2 - {p}y1) * ({q}x2 - {p}x1)) <= 0"
        )

    return f"""
{name}_p AS (SELECT l.id AS l_id, r.id AS r_id, l.area AS l_area, r.area AS r_area, least(l.xmin, r.xmin) AS ox, least(l.ymin, r.ymin) AS oy
  FROM {left_b} l JOIN {right_b} r ON l.xmin <= r.xmax AND r.xmin <= l.xmax AND l.ymin <= r.ymax AND r.ymin <= l.ymax WHERE {cond}),
{name}_e AS (SELECT p.l_id, p.r_id, p.l_area, p.r_area, a.x1 - ox AS ax1, a.y1 - oy AS ay1, a.x2 - ox AS ax2, a.y2 - oy AS ay2,
    b.x1 - ox AS bx1, b.y1 - oy AS by1, b.x2 - ox AS bx2, b.y2 - oy AS by2
  FROM {name}_p p JOIN {left_e} a ON a.id = p.l_id JOIN {right_e} b ON b.id = p.r_id),
{name}_l AS (SELECT *, greatest(least(ax1, ax2), least(bx1, bx2)) AS lo, least(greatest(ax1, ax2), greatest(bx1, bx2)) AS hi FROM {name}_e),
{name}_f AS (SELECT *, {line('a', 'lo')} AS fl, {line('a', 'hi')} AS fh, {line('b', 'lo')} AS gl, {line('b', 'hi')} AS gh FROM {name}_l),
{name}_t AS (SELECT *, CASE WHEN fl = gl AND fh = gh THEN 0e0 ELSE abs(fl - gl) / (abs(fl - gl) + abs(fh - gh)) END AS t FROM {name}_f),
{name} AS (SELECT l_id, r_id, any_value(l_area) AS l_area, any_value(r_area) AS r_area,
    greatest(0e0, sum(CASE WHEN lo < hi THEN (CASE WHEN (ax1 > ax2) = (bx1 > bx2) THEN 1 ELSE -1 END) *
      CASE WHEN (fl - gl) * (fh - gh) >= 0 THEN (least(fl, gl) + least(fh, gh)) / 2 * (hi - lo)
           ELSE (least(fl, gl) + fl + (fh - fl) * t) / 2 * (hi - lo) * t + (fl + (fh - fl) * t + least(fh, gh)) / 2 * (hi - lo) * (1 - t) END
      ELSE 0e0 END)) AS inter,
    bool_or(least(ax1, ax2) <= greatest(bx1, bx2) AND least(bx1, bx2) <= greatest(ax1, ax2)
      AND least(ay1, ay2) <= greatest(by1, by2) AND least(by1, by2) <= greatest(ay1, ay2) AND {turn('a', 'b')} AND {turn('b', 'a')}) AS touch
  FROM {name}_t GROUP BY l_id, r_id)"""


MEETS = "(touch OR inter > least(l_area, r_area) * 1e-9)"
