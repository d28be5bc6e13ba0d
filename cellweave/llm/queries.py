"""The operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, fill_middle, html_text, mixing, near_dups, packing, phrases, pii, preference, quality, sharding, substrings, toxicity

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_weighted_tree(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"), 24)


@query
def op2_visible_text(spark, sf_dir):
    out = html_text.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")


@query
def op3_anchor_pii(spark, sf_dir):
    return pii.detect(read(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op4_suffix_dedup(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


@query
def op5_preference_pairs(spark, sf_dir):
    return preference.segments(preference.neighbours(read(spark, sf_dir, "conversations")))


ORACLE["op5_preference_pairs"] = """
WITH t AS (SELECT conv_id // 2 AS pair_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, role, text FROM conversations),
b AS (SELECT pair_id, turn, MAX(CASE WHEN side = 'chosen' THEN role END) AS cr, MAX(CASE WHEN side = 'chosen' THEN text END) AS ct, MAX(CASE WHEN side = 'rejected' THEN role END) AS rr,
  MAX(CASE WHEN side = 'rejected' THEN text END) AS rt FROM t GROUP BY pair_id, turn),
s AS (SELECT pair_id, MIN(turn) AS split FROM b WHERE cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt GROUP BY pair_id),
m AS (SELECT b.*, b.turn < s.split OR s.split IS NULL AS same FROM b LEFT JOIN s ON b.pair_id = s.pair_id),
x AS (SELECT pair_id, 'prompt' AS part, turn, cr AS role, ct AS text FROM m WHERE same
  UNION ALL SELECT pair_id, 'chosen', turn, cr, ct FROM m WHERE NOT same AND cr IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, rr, rt FROM m WHERE NOT same AND rr IS NOT NULL),
r AS (SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM x)
SELECT pair_id, part, turn, role, rendered,
 CAST(COALESCE(SUM(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
 role = 'assistant' AND part <> 'prompt' AS loss FROM r
"""


@query
def op6_suffix_decontamination(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op7_best_fit(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op8_certified_rules(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_compression_toxicity(spark, sf_dir):
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_toivonen_phrases(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLE["op11_toivonen_phrases"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, COUNT(*) AS a FROM g GROUP BY ALL HAVING COUNT(*) >= 10),
n AS (SELECT lang, COUNT(*) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c),
h AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * k.a * k.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.size], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM h) WHERE o = 1),
i AS (SELECT lang, phrase, MAX(a) AS most FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE size = 3) GROUP BY ALL),
s AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""


@query
def op12_secondary_sort(spark, sf_dir):
    return fill_middle.transform(read(spark, sf_dir, "documents"), with_text=False)


ORACLE["op12_secondary_sort"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM p
"""


@query
def op13_fair_queueing(spark, sf_dir):
    return mixing.report(read(spark, sf_dir, "documents"))


ORACLE["op13_fair_queueing"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:16] AS h FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM r),
o AS (SELECT *, SUM(cap) OVER q - cap AS c0, SUM(w) OVER q - w AS w0, SUM(source_size) OVER () AS t, SUM(w) OVER () AS wt FROM w WINDOW q AS (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CAST(cap AS HUGEINT) * (wt - w0) < CAST(w AS HUGEINT) * (t - c0) AS full_ FROM o),
l AS (SELECT CAST(MAX(t) - COALESCE(SUM(cap) FILTER (WHERE full_), 0) AS DOUBLE) / CAST(MAX(wt) - COALESCE(SUM(w) FILTER (WHERE full_), 0) AS DOUBLE) AS level, CAST(MAX(t) AS BIGINT) AS budget FROM c),
x AS (SELECT source, source_size, rank, budget, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE LEAST(CAST(cap AS DOUBLE), w * level) END AS target FROM c, l),
e AS (SELECT d.*, x.source_size, x.rank, x.target, x.budget, SUM(size) OVER (PARTITION BY x.rank ORDER BY h, doc_id, size, i ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
k AS (SELECT *, unnest(range(0, size, 512)) AS start FROM e WHERE size > 0),
p AS (SELECT *, LEAST(512, size - start) AS words, unnest(range(0, 3)) AS pass FROM k),
z AS (SELECT *, pass * source_size + before + start + words AS end_ FROM p),
v AS (SELECT *, SUM(words) OVER (ORDER BY CAST(end_ AS DOUBLE) / target, rank, end_ ROWS UNBOUNDED PRECEDING) - words AS place FROM z),
g AS (SELECT i, CAST(SUM(GREATEST(0, LEAST(words, budget - place))) AS BIGINT) AS taken FROM v GROUP BY i)
SELECT doc_id, size, source_size, target, COALESCE(taken, 0) AS taken FROM e LEFT JOIN g ON e.i = g.i
"""
