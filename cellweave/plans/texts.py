"""Text normalisation, order identities, places and settlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import fuzzy, ledger, places
from ..operators import groups as R
from ..session import spread
from . import fixtures as X

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Numerals of several forms, full-width letters and single characters mixed into whole texts.
_SPELL = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(CAST({n} AS {str}), '0', '零'), '1', '一'), '2', '二'), '3', '三'), '4', '四'), '5', '五'), '6', '六'), '7', '七'), '8', '八'), '9', '九')"


def text_sql(string: str) -> str:
    k = _SPELL.format(n="doc_id", str=string)
    d = [_SPELL.format(n=f"doc_id {{div}} {p} % 9 + 1", str=string) for p in (1, 9, 81)]
    return f"""
SELECT doc_id AS id, '朝阳区' || {k} || '号楼ＡＢ１２　' || {d[0]} || '百' || {d[1]} || '十' || {d[2]} || '弄，甲-' || text || '十' || {d[1]} || '层！' || {d[2]} || '千零' || {d[0]} || '室三万' AS t
FROM {{documents}}"""


TXT = f"x AS ({X.for_oracle(text_sql('VARCHAR'))})"


def texts(spark, sf):
    return spread(X.run(spark, sf, text_sql("STRING")))


# The same text taken apart for checking: the fixture's numerals have known values.
def _digits_sql() -> str:
    d0, d1, d2 = ("(doc_id // 1 % 9 + 1)", "(doc_id // 9 % 9 + 1)", "(doc_id // 81 % 9 + 1)")
    # A run cannot start with a zero, so a leading one stays as it is written.
    k = "CASE WHEN doc_id = 0 THEN '零' ELSE CAST(doc_id AS VARCHAR) END"
    return f"""'朝阳区' || {k} || '号楼ＡＢ１２　' || CAST({d0} * 100 + {d1} * 10 + {d2} AS VARCHAR) || '弄，甲-' || text || CAST(10 + {d1} AS VARCHAR) || '层！'
 || CAST({d2} * 1000 + {d0} AS VARCHAR) || '室30000'"""


DIG = f"x AS (SELECT doc_id AS id, {_digits_sql()} AS t FROM documents)"
WORDS = "array_to_string(regexp_extract_all({c}, '[一-龥_a-zA-Z0-9]{{2,50}}'), '')"
WIDE = "　" + "".join(chr(i) for i in range(0xFF01, 0xFF5F))
PLAIN = (" " + "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))).replace("'", "''")


@query
def norm_digits(spark, sf):
    # The generator converts a text once for both columns.
    d = texts(spark, sf).select("id", F.explode(F.array(T.cn_digits(F.col("t")))).alias("w"))
    return d.select("id", F.md5("w").alias("h"), F.length("w").cast("long").alias("n"))


ORACLE["norm_digits"] = f"WITH {DIG} SELECT id, md5(t) AS h, length(t) AS n FROM x"


@query
def norm_punct(spark, sf):
    d = texts(spark, sf).select("id", T.keep_words(F.col("t")).alias("w"))
    return d.select("id", F.md5("w").alias("h"), F.length("w").cast("long").alias("n"))


ORACLE["norm_punct"] = f"WITH {TXT}, w AS (SELECT id, {WORDS.format(c='t')} AS w FROM x) SELECT id, md5(w) AS h, length(w) AS n FROM w"


@query
def norm_width(spark, sf):
    d = texts(spark, sf).select("id", T.half_width(F.col("t")).alias("w"), T.half_width(F.col("t"), False).alias("v"))
    return d.select("id", F.md5("w").alias("h"), F.md5("v").alias("h_blank"))


BLANK = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}]+"
ORACLE["norm_width"] = f"""WITH {TXT}, w AS (SELECT id, translate(t, '{WIDE}', '{PLAIN}') AS v FROM x)
SELECT id, md5(regexp_replace(v, '{BLANK}', '', 'g')) AS h, md5(v) AS h_blank FROM w"""


@query
def norm_text(spark, sf):
    """The whole normalisation, in the established order and with widths first."""
    d = texts(spark, sf).select("id", T.normalize(F.col("t")).alias("w"), T.normalize(F.col("t"), True).alias("v"))
    return d.select("id", F.md5("w").alias("h"), F.length("w").cast("long").alias("n"), F.length("v").cast("long").alias("n_width_first"))


NARROW = f"regexp_replace(translate(t, '{WIDE}', '{PLAIN}'), '{BLANK}', '', 'g')"
ORACLE["norm_text"] = f"""WITH {DIG}, w AS (SELECT id, {WORDS.format(c='t')} AS w, {WORDS.format(c=NARROW)} AS v FROM x)
SELECT id, md5(w) AS h, length(w) AS n, length(v) AS n_width_first FROM w"""


def _name_pairs(spark, sf, max_dist):
    p = X.table(spark, sf, "part").select("p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    return fuzzy.fuzzy_pairs(p, "p_brand", "name", max_dist).select(F.col("p_brand").alias("brand"), "a", "b", "distance")


@query
def levenshtein_pairs(spark, sf):
    """Part names with size one edit apart within a brand."""
    return _name_pairs(spark, sf, 1)


@query
def levenshtein_pairs_two(spark, sf):
    """Part names with size at most two edits apart within a brand."""
    return _name_pairs(spark, sf, 2)


for _n, _k in (("levenshtein_pairs", 1), ("levenshtein_pairs_two", 2)):
    ORACLE[_n] = f"""WITH n AS (SELECT DISTINCT p_brand, p_name || ' ' || p_size AS s FROM part)
SELECT x.p_brand AS brand, x.s AS a, y.s AS b, levenshtein(x.s, y.s) AS distance FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.s < y.s WHERE levenshtein(x.s, y.s) <= {_k}"""

WAYBILL_SQL = """
SELECT o_orderkey AS platform_order_id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 5 END AS binded_phone,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 5 END AS sender_phone,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey {div} 7) % 5 END AS recipient_phone,
  o_orderkey % 3 AS business_type, CASE WHEN o_orderstatus = 'F' THEN 50 ELSE 40 END AS waybill_status
FROM {orders}"""


@query
def order_identity(spark, sf):
    w = R.finished_orders(X.run(spark, sf, WAYBILL_SQL))
    return w.select("platform_order_id", "user_id", ledger.order_identity(F.col("binded_phone"), F.col("sender_phone"), F.col("recipient_phone")).alias("order_identity"))


ORACLE["order_identity"] = f"""WITH w AS ({X.for_oracle(WAYBILL_SQL)})
SELECT platform_order_id, user_id, CASE WHEN binded_phone = sender_phone AND binded_phone = recipient_phone THEN '{ledger.IDENTITY[0]}'
  WHEN binded_phone = sender_phone AND binded_phone <> recipient_phone THEN '{ledger.IDENTITY[1]}' WHEN binded_phone <> sender_phone AND binded_phone = recipient_phone THEN '{ledger.IDENTITY[2]}'
  WHEN binded_phone <> sender_phone AND binded_phone <> recipient_phone THEN '{ledger.IDENTITY[3]}' ELSE '{ledger.IDENTITY[4]}' END AS order_identity
FROM w WHERE business_type = 1 AND waybill_status = 50"""

LEDGER = """l AS (SELECT month, y, y1, y2, y * (CASE WHEN mm % 2 = 0 THEN 0.9e0 ELSE 1.1e0 END) AS x FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, any_value(month(o_orderdate)) AS mm, sum(o_totalprice) AS y,
    sum(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE 0e0 END) AS y1, sum(CASE WHEN o_custkey % 2 = 0 THEN 0e0 ELSE o_totalprice END) AS y2
  FROM orders GROUP BY 1) t)"""


def monthly(spark, sf):
    o = X.table(spark, sf, "orders")
    m = ledger.monthly_totals(o.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B").alias("payer"), F.col("o_totalprice").alias("amount")))
    mm = F.substring("month", 6, 2).cast("int")
    return m.withColumn("x", F.col("y") * F.when(mm % 2 == 0, 0.9).otherwise(1.1))


@query
def settlement(spark, sf):
    """Who owes whom per month, given the fund of the month."""
    s = ledger.settle(monthly(spark, sf))
    return s.select("month", *[G.rnd(F.col(c), 1).alias(c) for c in ("fund_used", "over_part", "a_cost", "net")], "status", "valid")


ORACLE["settlement"] = f"""WITH {LEDGER}, c AS (SELECT *, least(x, y) AS fu, greatest(0e0, y - x) AS ov FROM l), d AS (SELECT *, fu / 3 + ov * 2 / 5 AS ac FROM c), e AS (SELECT *, ac - (x / 3 + y1) AS net FROM d)
SELECT month, {X.r_sql('fu', 1)} AS fund_used, {X.r_sql('ov', 1)} AS over_part, {X.r_sql('ac', 1)} AS a_cost, {X.r_sql('net', 1)} AS net,
  CASE WHEN abs(net) < 0.01e0 THEN 'balanced' WHEN net > 0 THEN 'pay' ELSE 'receive' END AS status, x >= 0 AND y >= 0 AND y1 >= 0 AND y2 >= 0 AND abs(y1 + y2 - y) <= 0.01e0 AS valid FROM e"""


@query
def settle_infer(spark, sf):
    """The third of total and shares, where one of them is missing."""
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey") % 4
    o = o.select("o_orderkey", F.when(k != 0, F.col("o_totalprice")).alias("y"), F.when(k != 1, (F.floor(F.col("o_totalprice") * 25) / 100)).alias("y1"),
                 F.when(k == 3, F.col("o_totalprice") + 1).when(k != 2, F.col("o_totalprice") - (F.floor(F.col("o_totalprice") * 25) / 100)).alias("y2"))
    o = o.withColumn("y1", F.when(k == 3, F.lit(None)).otherwise(F.col("y1")))
    i = ledger.infer_third(o)
    return i.select("o_orderkey", *[G.rnd(F.col(c), 2).alias(c) for c in ("y", "y1", "y2")])


ORACLE["settle_infer"] = f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_totalprice AS t, floor(o_totalprice * 25) / 100e0 AS q FROM orders)
SELECT o_orderkey, {X.r_sql('t', 2)} AS y, CASE WHEN k = 3 THEN NULL ELSE {X.r_sql('CASE WHEN k = 1 THEN t - (t - q) ELSE q END', 2)} END AS y1,
  {X.r_sql('CASE WHEN k = 3 THEN t + 1 ELSE t - q END', 2)} AS y2 FROM o"""

PLACE_SQL = """
SELECT s_suppkey AS id, s_name || '（' || n_name || '）' AS display, CAST(n_nationkey AS BIGINT) AS k, n_name AS place,
  CASE WHEN s_suppkey % 10 = 0 THEN 'capital' WHEN s_suppkey % 10 = 1 THEN 'secondary' WHEN s_suppkey % 10 <= 5 THEN 'city' ELSE 'town' END AS tier, s_suppkey % 17 AS period
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""
PLACE = f"p AS ({X.for_oracle(PLACE_SQL)}), c AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 20e0 + n_nationkey AS lat, 100e0 + n_nationkey AS lng FROM nation WHERE n_nationkey <> 7)"


def place_rows(spark, sf):
    p = X.run(spark, sf, PLACE_SQL)
    c = X.table(spark, sf, "nation").where("n_nationkey <> 7").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") + 20.0).alias("lat"), (F.col("n_nationkey") + 100.0).alias("lng"))
    return p, c


@query
def coord_lookup(spark, sf):
    """Places with coordinates, and those whose key is missing (status)."""
    p, c = place_rows(spark, sf)
    j = p.join(c, "k", "left")
    status = F.when(F.col("lng").isNull(), "missing").otherwise("found")
    return j.select("id", F.coalesce("lng", F.lit(-1.0)).alias("lng"), F.coalesce("lat", F.lit(-1.0)).alias("lat"), status.alias("status"))


ORACLE["coord_lookup"] = f"WITH {PLACE} SELECT p.id, coalesce(lng, -1) AS lng, coalesce(lat, -1) AS lat, CASE WHEN c.k IS NULL THEN 'missing' ELSE 'found' END AS status FROM p LEFT JOIN c ON c.k = p.k"


@query
def place_projection(spark, sf):
    found, _ = R.lookup(*place_rows(spark, sf), "k")
    p = places.project_places(found)
    return p.select("id", "label", G.rnd(F.col("px"), 4).alias("px"), G.rnd(F.col("py"), 4).alias("py"), places.tier_rank(F.col("tier")).alias("rank"))


PROJ = f"{PLACE}, j AS (SELECT p.*, lng * cos(radians(35e0)) * 9 AS px, -lat * 9 AS py, CASE tier WHEN 'capital' THEN 0 WHEN 'secondary' THEN 1 WHEN 'city' THEN 2 ELSE 3 END AS rk FROM p JOIN c ON c.k = p.k)"
ORACLE["place_projection"] = f"WITH {PROJ} SELECT id, string_split(display, '（')[1] AS label, {X.r_sql('px', 4)} AS px, {X.r_sql('py', 4)} AS py, CAST(rk AS BIGINT) AS rank FROM j"


@query
def places_count(spark, sf):
    """Places per period; the row with period -1 is the total."""
    return places.count_places(place_rows(spark, sf)[0])


ORACLE["places_count"] = f"WITH {PLACE} SELECT coalesce(period, -1) AS period, count(*) AS n FROM p GROUP BY ROLLUP (period)"


@query
def place_dups(spark, sf):
    """Places sharing coordinates or a name within a period."""
    found, _ = R.lookup(*place_rows(spark, sf), "k")
    return places.duplicate_places(found, ["lng", "lat"], "place")


ORACLE["place_dups"] = f"""WITH {PLACE}, j AS (SELECT p.*, lng, lat FROM p JOIN c ON c.k = p.k)
SELECT period, 'coordinates' AS kind, CAST(lng AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) AS value, count(*) AS n FROM j GROUP BY period, lng, lat HAVING count(*) > 1
UNION ALL SELECT period, 'name', place, count(*) FROM j GROUP BY period, place HAVING count(*) > 1"""


@query
def label_slot(spark, sf):
    """The best-ranked place of every 32 pixel cell keeps its label."""
    found, _ = R.lookup(*place_rows(spark, sf), "k")
    return places.label_slots(places.project_places(found), 32).select("id", "period", "shown")


ORACLE["label_slot"] = f"""WITH {PROJ} SELECT id, period, row_number() OVER (PARTITION BY period, floor(px / 32), floor(py / 32) ORDER BY rk, id) = 1 AS shown FROM j"""


@query
def nested_periods(spark, sf):
    """Periods with their places nested in order, written as JSON in bounded chunks and read back."""
    p, _ = place_rows(spark, sf)
    back = places.nested_round_trip(p, "period", ["id", "place", "tier"])
    items = back.select("period", "chunk", F.posexplode("items").alias("place_in_chunk", "i"))
    return items.select("period", "chunk", F.col("place_in_chunk").cast("long").alias("place_in_chunk"), "i.id", "i.place", "i.tier")


ORACLE["nested_periods"] = f"""WITH {PLACE} SELECT period, (_nth - 1) // 10000 AS chunk, (_nth - 1) % 10000 AS place_in_chunk, id, place, tier
FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY id, place, tier) AS _nth FROM p) t"""
