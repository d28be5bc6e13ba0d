"""Selection of shop-area flows per city."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import groups as R
from ..operators import selection as E
from . import fixtures as X

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


FLOW_SQL = """
SELECT city_id, poi_id, aoi_id, ((poi_id * 31 + aoi_id * 17) % 500) / 100e0 AS cost, qty AS gain, qty AS base_gain,
  CAST(1 + (poi_id + aoi_id) % 4 AS BIGINT) AS navi_cls,
  CAST(CASE WHEN 1 + (poi_id + aoi_id) % 4 <= 2 AND aoi_id % 9 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS base_set,
  CAST(CASE WHEN (poi_id * aoi_id) % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS candidate_set
FROM (SELECT CAST(s_nationkey AS BIGINT) AS city_id, l_suppkey AS poi_id, l_partkey AS aoi_id, sum(l_quantity) AS qty
      FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY 1, 2, 3) t
"""
FLOW = f"f AS ({X.for_oracle(FLOW_SQL)})"
CIRCLE = "CASE WHEN base_set = 1 AND candidate_set = 0 AND navi_cls <= 2 THEN 1 WHEN base_set = 0 AND candidate_set = 0 AND navi_cls > 3 THEN -1 ELSE 0 END"


def flows(spark, sf):
    return X.run(spark, sf, FLOW_SQL)


@query
def selection_classes(spark, sf):
    both = E.classify_flows(flows(spark, sf), "circle").withColumnRenamed("flow_class", "circle_class")
    both = E.classify_flows(both, "distance")
    return both.select("city_id", "poi_id", "aoi_id", "circle_class", F.col("flow_class").alias("distance_class"))


ORACLE["selection_classes"] = f"""WITH {FLOW} SELECT city_id, poi_id, aoi_id, CAST({CIRCLE} AS BIGINT) AS circle_class,
  CAST(CASE WHEN navi_cls = 1 THEN 1 WHEN navi_cls = 4 THEN -1 ELSE 0 END AS BIGINT) AS distance_class FROM f"""


def _limits_sql(gain, lo, hi):
    return f"""SELECT city_id, sum(base_set) AS bn, sum(CASE WHEN base_set = 1 THEN base_gain ELSE 0e0 END) AS bg,
  sum(CASE WHEN base_set = 1 THEN base_gain ELSE 0e0 END) * {gain}e0 AS mg, CAST(round_even(sum(base_set) * {lo}e0, 0) AS BIGINT) AS lo, CAST(round_even(sum(base_set) * {hi}e0, 0) AS BIGINT) AS hi FROM f GROUP BY city_id"""


@query
def selection_limits(spark, sf):
    f = flows(spark, sf)
    both = E.limits(f, "city_id", "circle").join(E.limits(f, "city_id", "distance").select("city_id", F.struct("min_gain", "min_n", "max_n").alias("d")), "city_id")
    one = F.struct(F.lit("circle").alias("variant"), F.struct("min_gain", "min_n", "max_n").alias("v"))
    two = F.struct(F.lit("distance").alias("variant"), F.col("d").alias("v"))
    return both.select("city_id", "base_n", G.rnd(F.col("base_gain"), 2).alias("base_gain"), F.explode(F.array(one, two)).alias("x")).select(
        "city_id", "x.variant", "base_n", "base_gain", G.rnd(F.col("x.v.min_gain"), 4).alias("min_gain"), "x.v.min_n", "x.v.max_n")


ORACLE["selection_limits"] = f"WITH {FLOW} " + " UNION ALL ".join(
    f"SELECT city_id, '{v}' AS variant, CAST(bn AS BIGINT) AS base_n, {X.r_sql('bg', 2)} AS base_gain, {X.r_sql('mg', 4)} AS min_gain, lo AS min_n, hi AS max_n FROM ({_limits_sql(*E.LIMITS[v])}) x"
    for v in ("circle", "distance"))


@query
def group_baseline(spark, sf):
    """Base shops and their gain per area and city, with the number of flows."""
    f = flows(spark, sf)
    b = E.group_baseline(f, "city_id", "aoi_id").join(f.groupBy("city_id", "aoi_id").agg(F.count("*").alias("n_flows")), ["city_id", "aoi_id"])
    return b.select("city_id", "aoi_id", "base_n", "n_flows", G.rnd(F.col("base_gain"), 2).alias("base_gain"))


ORACLE["group_baseline"] = f"""WITH {FLOW} SELECT city_id, aoi_id, CAST(sum(base_set) AS BIGINT) AS base_n, count(*) AS n_flows,
  {X.r_sql('sum(CASE WHEN base_set = 1 THEN base_gain ELSE 0e0 END)', 2)} AS base_gain FROM f GROUP BY 1, 2"""


@query
def selection_audit(spark, sf):
    """Audit of a simple choice: always-chosen rows plus every other free one."""
    f = E.classify_flows(flows(spark, sf), "circle")
    f = f.withColumn("is_selected", F.expr("CASE WHEN flow_class = 1 OR (flow_class = 0 AND (poi_id + aoi_id) % 2 = 0) THEN 1 ELSE 0 END"))
    a = E.audit_selection(f, "city_id", "circle")
    return a.select("city_id", G.rnd(F.col("cost"), 2).alias("cost"), G.rnd(F.col("gain"), 2).alias("gain"), "n", G.rnd(F.col("gain_change"), 4).alias("gain_change"),
                    G.rnd(F.col("count_change"), 4).alias("count_change"), "feasible")


ORACLE["selection_audit"] = f"""WITH {FLOW}, c AS (SELECT *, CASE WHEN {CIRCLE} = 1 OR ({CIRCLE} = 0 AND (poi_id + aoi_id) % 2 = 0) THEN 1 ELSE 0 END AS s FROM f),
a AS (SELECT city_id, sum(s * cost) AS cost, sum(s * gain) AS gain, CAST(sum(s) AS BIGINT) AS n FROM c GROUP BY 1), l AS ({_limits_sql(*E.LIMITS['circle'])})
SELECT a.city_id, {X.r_sql('cost', 2)} AS cost, {X.r_sql('gain', 2)} AS gain, n, {X.r_sql('gain / bg - 1', 4)} AS gain_change, {X.r_sql('n / CAST(bn AS DOUBLE) - 1', 4)} AS count_change,
  gain >= mg AND n BETWEEN lo AND hi AS feasible FROM a JOIN l ON l.city_id = a.city_id"""


@query
def selection(spark, sf):
    s = E.select_flows(flows(spark, sf), "city_id", "circle")
    return s.select("city_id", "poi_id", "aoi_id", "base_set", "candidate_set", "is_selected")


@query
def selection_distance(spark, sf):
    s = E.select_flows(flows(spark, sf), "city_id", "distance")
    return s.select("city_id", "poi_id", "aoi_id", "base_set", "candidate_set", "is_selected")


def _check_query(variant):
    """Per city: whether there is a choice, and whether the choice made keeps all limits and lies above its bound."""
    def check(spark, sf):
        s = E.stage(E.select_flows(flows(spark, sf), "city_id", variant), "selection")
        per = s.groupBy("city_id").agg(F.min("is_selected").alias("least"), F.min(F.coalesce("gap", F.lit(0.0))).alias("gap"))
        a = E.audit_selection(s, "city_id", variant).select("city_id", F.col("feasible").alias("kept"))
        has = F.col("least") >= 0
        return per.join(a, "city_id").select("city_id", has.alias("feasible"), (~has | (F.col("kept") & (F.col("gap") >= -1e-6))).alias("holds"))

    return check


# A city has a choice if its rows of greatest gain, as many as may be chosen and help, reach the least gain.
_CHECK_SQL = """WITH {flow}, l AS ({limits}), c AS (SELECT *, {cls} AS k FROM f),
x AS (SELECT city_id, count(*) FILTER (k = 1) AS fn, coalesce(sum(gain) FILTER (k = 1), 0) AS fg, count(*) FILTER (k = 0) AS n0 FROM c GROUP BY 1),
r AS (SELECT city_id, gain, row_number() OVER (PARTITION BY city_id ORDER BY gain DESC) AS p FROM c WHERE k = 0),
t AS (SELECT l.city_id, coalesce(sum(gain) FILTER (p <= hi - fn AND (gain > 0 OR p <= lo - fn)), 0) AS g FROM l JOIN x ON x.city_id = l.city_id LEFT JOIN r ON r.city_id = l.city_id GROUP BY 1)
SELECT l.city_id, bg > 0 AND hi >= fn AND n0 >= lo - fn AND fg + g >= mg AS feasible, true AS holds FROM l JOIN x ON x.city_id = l.city_id JOIN t ON t.city_id = l.city_id"""

for _v, _cls in (("circle", CIRCLE), ("distance", "CASE WHEN navi_cls = 1 THEN 1 WHEN navi_cls = 4 THEN -1 ELSE 0 END")):
    QUERIES[f"selection_check_{_v}"] = _check_query(_v)
    ORACLE[f"selection_check_{_v}"] = _CHECK_SQL.format(flow=FLOW, limits=_limits_sql(*E.LIMITS[_v]), cls=_cls)


@query
def kth_largest(spark, sf):
    """Third largest gain per city."""
    k = R.kth_largest(flows(spark, sf), "city_id", "gain", 3)
    return k.select("city_id", G.rnd(F.col("gain"), 2).alias("gain"))


ORACLE["kth_largest"] = f"""WITH {FLOW} SELECT city_id, {X.r_sql('gain', 2)} AS gain FROM (SELECT city_id, gain, row_number() OVER (PARTITION BY city_id ORDER BY gain DESC) AS k FROM f WHERE gain IS NOT NULL) t WHERE k = 3"""


@query
def group_rows(spark, sf):
    """Distinct groups with their row and shop counts: what the per-group lists are used for."""
    return flows(spark, sf).groupBy("city_id").agg(F.count("*").alias("cnt"), F.countDistinct("poi_id").alias("shops"), F.countDistinct("aoi_id").alias("areas"))


ORACLE["group_rows"] = f"WITH {FLOW} SELECT city_id, count(*) AS cnt, count(DISTINCT poi_id) AS shops, count(DISTINCT aoi_id) AS areas FROM f GROUP BY 1"


@query
def salt(spark, sf):
    """Rows per group and salt: a hot group is spread while its key stays whole."""
    f = flows(spark, sf).withColumn("salt", F.pmod(F.col("poi_id") * 31 + F.col("aoi_id") * 17, F.lit(100)))
    part = f.groupBy("city_id", "salt").agg(F.sum("gain").alias("g"), F.count("*").alias("n"))
    return part.groupBy("city_id").agg(G.rnd(F.sum("g"), 2).alias("gain"), F.sum("n").alias("n"), F.count("*").alias("slices"))


ORACLE["salt"] = f"WITH {FLOW} SELECT city_id, {X.r_sql('sum(gain)', 2)} AS gain, count(*) AS n, count(DISTINCT (poi_id * 31 + aoi_id * 17) % 100) AS slices FROM f GROUP BY 1"
