"""Sources and sinks, each written to and read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..operators import groups as R
from ..operators import snapshots as N
from ..operators import spatial as S
from ..session import fresh_path, stage
from ..sources import catalog as K
from ..sources import files as I
from ..sources import generators as Y
from ..sources import outlines as L
from . import fixtures as X
from .grid import AREA_CTES, BLOCK_CTES

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _schema(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


@query
def tsv_defaults(spark, sf):
    """Tab-separated review rows without the optional ``fix`` column, which becomes '0'."""
    path = fresh_path(spark, "review")
    X.areas(spark, sf).select(F.col("id").alias("aoi_id"), F.concat(F.lit("area "), F.col("id")).alias("aoi_name"), F.col("polygon").alias("polygon_str")).write.csv(path, sep="\t", header=True)
    d = I.read_delimited(spark, path, _schema(("aoi_id", T.LongType()), ("aoi_name", T.StringType()), ("polygon_str", T.StringType())), defaults={"fix": "0"})
    return d.select("aoi_id", "aoi_name", "fix", F.col("polygon_str").startswith("POLYGON ((").alias("has_outline"))


ORACLE["tsv_defaults"] = "SELECT p_partkey AS aoi_id, 'area ' || p_partkey AS aoi_name, '0' AS fix, TRUE AS has_outline FROM part"


@query
def copy_table(spark, sf):
    """Two columns of the areas copied into a table of their own."""
    d = I.copy_table(spark, X.areas(spark, sf).withColumn("extra", F.lit(1)), fresh_path(spark, "copy"), ["id", "polygon"])
    return S.shapes(d, "id", "polygon").select(F.col("id").alias("aoi_id"), G.rnd(F.col("area") * 1e10, 2).alias("area_e10"))


ORACLE["copy_table"] = f"WITH {AREA_CTES} SELECT id AS aoi_id, {X.r_sql('area * 1e10', 2)} AS area_e10 FROM ab"


@query
def copy_as_table(spark, sf):
    """Two columns of the areas copied into a named table by a query."""
    d = K.create_as(X.areas(spark, sf).select("id", "polygon"), f"copy_{uuid.uuid4().hex}")
    return S.shapes(d, "id", "polygon").select(F.col("id").alias("aoi_id"), G.rnd(F.col("area") * 1e10, 2).alias("area_e10"))


ORACLE["copy_as_table"] = ORACLE["copy_table"]


@query
def partition_days(spark, sf):
    """A day-partitioned ORC table: two days written, one replaced, then read by day range."""
    path = fresh_path(spark, "days")
    b = X.blocks(spark, sf).select("id", "category")
    schema = _schema(("id", T.LongType()), ("category", T.StringType()))
    for dt, keep in (("20240101", F.col("id") % 2 == 0), ("20240102", F.col("id") % 3 == 0), ("20240101", F.col("id") % 5 == 0)):
        I.overwrite_partition(b.where(keep), path, dt, "orc", schema)
    d = I.read_table(spark, path, "orc", lo="20240101", hi="20240102")
    return d.groupBy(F.col("dt").cast("string").alias("dt"), "category").agg(F.count("*").alias("n"))


ORACLE["partition_days"] = f"""WITH b AS ({X.for_oracle(X.BLOCK_SQL)}) SELECT '20240101' AS dt, category, count(*) AS n FROM b WHERE id % 5 = 0 GROUP BY 2
UNION ALL SELECT '20240102', category, count(*) FROM b WHERE id % 3 = 0 GROUP BY 2"""


@query
def look_back(spark, sf):
    """Valid events of the last 10 days up to 20240115, per day."""
    d = R.valid_activity(X.pings(spark, sf)).withColumn("dt", F.date_format("ts", "yyyyMMdd"))
    return N.look_back(d, "dt", "20240115", 10).groupBy("dt").agg(F.count("*").alias("n"))


ORACLE["look_back"] = f"""WITH p AS ({X.for_oracle(X.PING_SQL)}) SELECT strftime(ts, '%Y%m%d') AS dt, count(*) AS n FROM p WHERE is_dau = 1 AND user_id > 0 AND strftime(ts, '%Y%m%d') BETWEEN '20240106' AND '20240115' GROUP BY 1"""


@query
def date_list(spark, sf):
    """For every day with events the three days ending there, newest first, and the day a week before."""
    d = X.table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("dt")).distinct()
    return d.select("dt", F.array_join(I.days_back(F.col("dt"), 3), ",").alias("days"), I.shift_day(F.col("dt"), 7).alias("week_before"))


ORACLE["date_list"] = """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
SELECT strftime(d, '%Y%m%d') AS dt, strftime(d, '%Y%m%d') || ',' || strftime(d - INTERVAL 1 DAY, '%Y%m%d') || ',' || strftime(d - INTERVAL 2 DAY, '%Y%m%d') AS days, strftime(d - INTERVAL 7 DAY, '%Y%m%d') AS week_before FROM d"""


@query
def geojson_rows(spark, sf):
    """Region features written as GeoJSON files, read back, one code dropped; outlines by type."""
    r = X.run(spark, sf, X.REGION_SQL)
    x1, y1 = F.col("x0") + F.col("side"), F.col("y0") + F.col("side")
    ring = [(F.col("x0"), F.col("y0")), (x1, F.col("y0")), (x1, y1), (F.col("x0"), y1), (F.col("x0"), F.col("y0"))]
    coords = F.array(F.array(*[F.array(a, b) for a, b in ring]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").cast("string").alias("adcode"), F.col("name").alias("name")).alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))
    path = fresh_path(spark, "geojson")
    # One collection per parent: a bounded handful of features each.
    r.groupBy("parentcode").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    d = I.read_geojson(spark, path, drop_codes=("103",), lines=True)
    g = L.ingest_geojson(d, "code", "geometry")
    return g.join(d.select(F.col("code").alias("id"), "name"), "id").select(F.col("id").cast("long").alias("code"), "name", "type", F.size("pts").cast("long").alias("n"),
                    G.rnd(F.abs(G.signed_area(G.open_ring(F.col("pts")))), 7).alias("area"))


ORACLE["geojson_rows"] = f"""WITH g AS ({X.for_oracle(X.REGION_SQL)}) SELECT id AS code, name, 'Polygon' AS type, CAST(5 AS BIGINT) AS n, 0.01e0 AS area FROM g WHERE id <> 103"""

WAYS = ["primary", "residential", "trunk", "service"]


def packed_links(spark, sf):
    """One packed text per region of 5 links, as the road job receives them."""
    r = X.run(spark, sf, X.REGION_SQL)

    def link(i):
        way = F.element_at(F.array(*[F.lit(w) for w in WAYS]), ((F.col("id") + i) % 4 + 1).cast("int"))
        y = (F.col("y0") + 0.01 * (i + 1)).cast("string")
        return F.concat(
            (F.col("id") * 10 + i).cast("string"), F.lit("&_&LINESTRING ("), (F.col("x0") + 0.01).cast("string"), F.lit(" "), y, F.lit(", "), (F.col("x0") + 0.06).cast("string"), F.lit(" "), y,
            F.lit(')&_&{"highway": "'), way, F.lit('", "name": "'), F.col("name"), F.lit('"'), F.lit(', "oneway": "yes"}' if i % 2 else "}"))

    return r.select("id", F.concat_ws("&#&", *[link(i) for i in range(5)]).alias("links"))


@query
def link_explode(spark, sf):
    d = I.explode_links(packed_links(spark, sf), "links", [])
    return d.select("link_id", I.link_text(F.col("attrs")).alias("text"), F.size(G.parse_linestring(F.col("wkt"))).cast("long").alias("n_points"))


_WAY = "CASE (id + i) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'trunk' ELSE 'service' END"
LINKS = f"g AS ({X.for_oracle(X.REGION_SQL)}), k AS (SELECT id * 10 + i AS link_id, {_WAY} AS way, name, i, x0 + 0.01e0 AS xa, x0 + 0.06e0 AS xb, y0 + 0.01e0 * (i + 1) AS y FROM g, (VALUES (0), (1), (2), (3), (4)) v(i))"
ORACLE["link_explode"] = f"WITH {LINKS} SELECT link_id, way || ' ' || name || ' ' || CASE WHEN i % 2 = 1 THEN 'yes' ELSE 'no' END || ' no' AS text, CAST(2 AS BIGINT) AS n_points FROM k"


@query
def road_links(spark, sf):
    """Links whose box meets the box of a block, with a flag for high road classes."""
    k = stage(I.link_boxes(I.explode_links(packed_links(spark, sf), "links", [])), "links")
    b = S.shapes(X.blocks(spark, sf), "id", "polygon")
    p = S.candidates(b, k)
    return p.join(k.select(F.col("id").alias("r_id"), F.coalesce(F.col("attrs")["highway"].isin(I.HIGH_WAYS), F.lit(False)).alias("high")), "r_id").select(F.col("l_id").alias("blockid"), F.col("r_id").alias("link_id"), "high")


ORACLE["road_links"] = f"""WITH {BLOCK_CTES}, {LINKS} SELECT bb.id AS blockid, link_id, way IN ('primary', 'trunk') AS high FROM bb JOIN k ON xa <= xmax AND xb >= xmin AND y <= ymax AND y >= ymin"""


@query
def in_set(spark, sf):
    """Links of the high road classes, by a semi join with their list."""
    k = I.explode_links(packed_links(spark, sf), "links", []).select("link_id", F.col("attrs")["highway"].alias("highway"))
    dim = spark.createDataFrame([(w,) for w in I.HIGH_WAYS], "highway string")
    return R.in_set(k, "highway", dim).select("link_id", "highway")


ORACLE["in_set"] = f"WITH {LINKS} SELECT link_id, way AS highway FROM k WHERE way IN ('primary', 'trunk')"


@query
def fixes_applied(spark, sf):
    """Corrections appended in two batches and applied to the review rows."""
    path = fresh_path(spark, "fixes")
    rows = X.areas(spark, sf).select(F.col("id").alias("aoi_id"), F.concat(F.lit("area "), F.col("id")).alias("aoi_name"), F.col("polygon").alias("polygon_str"), F.col("polygon").alias("fix_polygon_str"), F.lit(0).cast("long").alias("fix"))
    fix = rows.withColumn("fix_polygon_str", F.concat(F.lit("fixed "), F.col("aoi_id"))).drop("fix")
    # The first text of a key corrected twice sorts behind the second.
    I.append_fixes(fix.where("aoi_id % 10 = 3").withColumn("fix_polygon_str", F.concat(F.lit("old "), F.col("aoi_id"))), path, 1)
    I.append_fixes(fix.where("aoi_id % 10 IN (3, 4)"), path, 2)
    back = I.read_delimited(spark, path, _schema(("aoi_id", T.LongType()), ("aoi_name", T.StringType()), ("polygon_str", T.StringType()), ("fix_polygon_str", T.StringType()), ("batch", T.LongType())))
    return I.apply_fixes(rows, back, "aoi_id").select("aoi_id", "fix", F.col("fix_polygon_str").startswith("fixed ").alias("latest"), (F.col("fix_polygon_str") == F.col("polygon_str")).alias("same"))


ORACLE["fixes_applied"] = "SELECT p_partkey AS aoi_id, CAST(CASE WHEN p_partkey % 10 IN (3, 4) THEN 1 ELSE 0 END AS BIGINT) AS fix, p_partkey % 10 IN (3, 4) AS latest, p_partkey % 10 NOT IN (3, 4) AS same FROM part"


@query
def synthetic_rows(spark, sf):
    """Synthetic rows for every event key: text, small integers, floats and labels."""
    d = Y.synthetic_rows(X.table(spark, sf, "events").select("event_id"), "event_id")
    return d.select(F.col("event_id").alias("id"), "npl_f", "spare_f_1", "spare_f_2", "spare_f_3", G.rnd(F.col("dense_f_1"), 4).alias("dense_f_1"), G.rnd(F.col("dense_f_10"), 4).alias("dense_f_10"),
                    "class_label", G.rnd(F.col("regress_label"), 4).alias("regress_label"))


ORACLE["synthetic_rows"] = f"""SELECT event_id AS id, {' || '.join(f'chr(CAST(19968 + (event_id * {p}) % 20902 AS INTEGER))' for p in Y.PRIMES[:10])} AS npl_f,
  (event_id * {Y.PRIMES[10]}) % 5 AS spare_f_1, (event_id * {Y.PRIMES[11]}) % 5 AS spare_f_2, (event_id * {Y.PRIMES[12]}) % 5 AS spare_f_3,
  {X.r_sql(f'(event_id * {Y.PRIMES[0]}) % 10007 / 1000.7e0', 4)} AS dense_f_1, {X.r_sql(f'(event_id * {Y.PRIMES[9]}) % 10007 / 1000.7e0', 4)} AS dense_f_10,
  (event_id * 8111) % 2 AS class_label, {X.r_sql('(event_id * 8117) % 10007 / 100.07e0', 4)} AS regress_label FROM events"""


@query
def wide_select(spark, sf):
    """A 151-field text of which 15 fields are read; one row in ten is malformed in a number."""
    path = fresh_path(spark, "wide")
    e = X.table(spark, sf, "events").select("event_id")
    cols = [F.when((F.col("event_id") % 10 == 0) & F.lit(i == 20), F.lit("x")).otherwise(((F.col("event_id") * (i + 3)) % 1009).cast("string")) for i in range(151)]
    e.select(F.concat_ws("\t", F.col("event_id").cast("string"), *cols[1:]).alias("value")).write.text(path)
    fields = {"user": (0, "long"), "label": (1, "int"), **{f"sparse_{i}": (10 + i, "int") for i in range(4)}, **{f"dense_{i}": (20 + i, "double") for i in range(10)}}
    d = I.read_wide(spark, path, 151, fields)
    total = sum((F.col(f"dense_{i}") for i in range(2, 10)), F.col("dense_1"))
    return d.select(F.col("user").alias("id"), F.col("label").cast("long").alias("label"), F.col("sparse_3").cast("long").alias("sparse_3"), "dense_0", total.alias("dense_sum"))


ORACLE["wide_select"] = f"""SELECT event_id AS id, (event_id * 4) % 1009 AS label, (event_id * 16) % 1009 AS sparse_3, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST((event_id * 23) % 1009 AS DOUBLE) END AS dense_0,
  CAST({' + '.join(f'(event_id * {23 + i}) % 1009' for i in range(1, 10))} AS DOUBLE) AS dense_sum FROM events"""


@query
def training_text(spark, sf):
    """Training text in two separators with header lines, read back by value."""
    path = fresh_path(spark, "train")
    t = Y.synthetic_train(X.table(spark, sf, "events").select("event_id"), "event_id")
    head = F.lit(",".join(Y.FEATURES[:3] + ["label"]))
    row = F.concat_ws(",", "feature_0", "feature_1", "feature_2", "label")
    lines = t.select(F.explode(F.when(F.col("event_id") % 100 == 0, F.array(head, row)).otherwise(F.array(row))).alias("value"), "event_id")
    lines.select(F.when(F.col("event_id") % 2 == 0, F.translate("value", ",", "\t")).otherwise(F.col("value")).alias("value")).write.text(path)
    schema = _schema(*[(f, T.DoubleType()) for f in Y.FEATURES[:3]], ("label", T.IntegerType()))
    d = I.read_training_text(spark, path, schema)
    return d.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), G.rnd(F.sum("feature_0"), 2).alias("sum_0"), G.rnd(F.sum("feature_2"), 2).alias("sum_2"))


from .learning import TRAIN  # noqa: E402 - the labelled rows' checking SQL

ORACLE["training_text"] = f"""WITH {TRAIN} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {X.r_sql('sum(f0)', 2)} AS sum_0, {X.r_sql('sum(f2)', 2)} AS sum_2 FROM t JOIN f ON f.event_id = t.event_id GROUP BY label"""
