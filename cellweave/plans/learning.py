"""Labels, metrics and Spark ML jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..learn import metrics as M
from ..learn import models as L
from ..operators import groups as R
from ..sources import generators as Y
from . import fixtures as X

QUERIES, ORACLE = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def train_rows(spark, sf):
    return Y.synthetic_train(X.table(spark, sf, "events").select("event_id"), "event_id")


_F = [f"(event_id * {p} % 10000 / 100e0)" for p in Y.PRIMES]


def _avg(names):
    return "(" + " + ".join(names) + f") / {len(names)}"


_fs = [f"f{i}" for i in range(20)]
_VAR = _avg([f"(f{i} - m) * (f{i} - m)" for i in range(10, 20)])
TRAIN = f"""f AS (SELECT event_id, {', '.join(f'{e} AS f{i}' for i, e in enumerate(_F))} FROM events), g AS (SELECT *, {_avg(_fs[10:])} AS m FROM f),
s AS (SELECT *, CASE WHEN {_avg(_fs[:5])} > 50 AND {' + '.join(f'CAST(f{i} > 60 AS INT)' for i in range(5))} >= 3 THEN 0.4e0 WHEN {_avg(_fs[:5])} > 65 THEN 0.3e0 ELSE 0e0 END
  + CASE WHEN {_avg(_fs[5:10])} < 30 THEN 0.3e0 WHEN {_avg(_fs[5:10])} < 45 THEN 0.15e0 ELSE 0e0 END
  + CASE WHEN {_VAR} > 35 THEN -0.2e0 WHEN greatest({', '.join(_fs[10:])}) - least({', '.join(_fs[10:])}) > 60 THEN -0.1e0 ELSE 0e0 END
  + CASE WHEN f0 > 70 AND f5 < 20 THEN 0.2e0 ELSE 0e0 END + CASE WHEN f15 > 80 AND f16 > 80 THEN -0.15e0 ELSE 0e0 END AS score FROM g),
l AS (SELECT event_id, score, CAST((event_id * 99991) % 10007 / 10007e0 < 1 / (1 + exp(-2 * score)) AS INT) AS raw FROM s),
t AS (SELECT event_id, score, CASE WHEN (event_id * 7927) % 10 = 0 THEN 1 - raw ELSE raw END AS label FROM l)"""


@query
def label_rules(spark, sf):
    return train_rows(spark, sf).select("event_id", G.rnd(F.col("score"), 4).alias("score"), F.col("label").cast("long").alias("label"))


ORACLE["label_rules"] = f"WITH {TRAIN} SELECT event_id, {X.r_sql('score', 4)} AS score, CAST(label AS BIGINT) AS label FROM t"


@query
def label_balance(spark, sf):
    b = M.label_balance(train_rows(spark, sf), "label")
    return b.select(F.col("label").cast("long").alias("label"), "n", G.rnd(F.col("share"), 6).alias("share"))


ORACLE["label_balance"] = f"WITH {TRAIN} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, {X.r_sql('count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE)', 6)} AS share FROM t GROUP BY label"


def scored(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("m"))
    return e.select(F.concat(F.lit("m"), "m").alias("model"), (F.col("event_id") * (F.col("m") * 2 + 7919) % 1000 / 1000.0).alias("p"), (F.col("event_id") * 31 % 2).alias("label"))


SCORED = "x AS (SELECT 'm' || m AS model, event_id * (7919 + 2 * m) % 1000 / 1000e0 AS p, event_id * 31 % 2 AS label FROM events, range(0, 8) r(m))"
EVAL = f"""{SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p) AS lo, count(*) OVER (PARTITION BY model, p) AS ties FROM x),
ev AS (SELECT model, count(*) AS n, avg(CASE WHEN (p > 0.5e0) = (label = 1) THEN 1e0 ELSE 0e0 END) AS acc,
  avg(-ln(CASE WHEN label = 1 THEN least(greatest(p, 1e-7), 1 - 1e-7) ELSE 1 - least(greatest(p, 1e-7), 1 - 1e-7) END)) AS loss,
  (sum(CASE WHEN label = 1 THEN lo + (ties - 1) / 2e0 ELSE 0e0 END) - sum(label) * (sum(label) + 1) / 2e0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS auc FROM k GROUP BY model)"""


@query
def eval_metrics(spark, sf):
    m = M.metrics(scored(spark, sf), "model")
    return m.select("model", "n", G.rnd(F.col("accuracy"), 6).alias("accuracy"), G.rnd(F.col("log_loss"), 6).alias("log_loss"))


ORACLE["eval_metrics"] = f"WITH {EVAL} SELECT model, n, {X.r_sql('acc', 6)} AS accuracy, {X.r_sql('loss', 6)} AS log_loss FROM ev"


@query
def auc(spark, sf):
    return M.auc(scored(spark, sf), "model").select("model", G.rnd(F.col("auc"), 6).alias("auc"))


ORACLE["auc"] = f"WITH {EVAL} SELECT model, {X.r_sql('auc', 6)} AS auc FROM ev"


@query
def leaderboard(spark, sf):
    m = M.metrics(scored(spark, sf), "model")
    m = m.withColumn("accuracy", F.round("accuracy", 9)).withColumn("log_loss", F.round("log_loss", 9))
    return M.leaderboard(m).select("model", "rank", "top")


ORACLE["leaderboard"] = f"""WITH {EVAL}, r AS (SELECT model, row_number() OVER (ORDER BY round(acc, 9) DESC, round(loss, 9), model) AS rank FROM ev) SELECT model, rank, rank <= 3 AS top FROM r"""


def epochs(spark, sf):
    """Log rows per user: loss and accuracy of ten epochs, derived from the number of the user's events."""
    u = X.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("c"))
    e = u.select("user_id", (F.col("c") % 8).alias("m"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("epoch"))
    return e.select("user_id", F.col("epoch").cast("long").alias("epoch"), (75000 - F.col("epoch") * 1000 + (F.col("epoch") * F.col("m") % 7) * 300).alias("l"), (5000 + F.col("epoch") * 50 - (F.col("epoch") * F.col("m") % 5) * 70).alias("a"))


EPOCHS = """u AS (SELECT user_id, count(*) % 8 AS m FROM events GROUP BY 1), e AS (SELECT user_id, epoch, (75000 - epoch * 1000 + (epoch * m % 7) * 300) / 100000e0 AS loss, (5000 + epoch * 50 - (epoch * m % 5) * 70) / 100e0 AS acc FROM u, range(1, 11) r(epoch))"""


@query
def best_epoch(spark, sf):
    e = epochs(spark, sf).select("user_id", "epoch", (F.col("l") / 100000.0).alias("loss"), (F.col("a") / 100.0).alias("accuracy"))
    return M.best_epoch(e, "user_id").select("user_id", G.rnd(F.col("best_loss"), 5).alias("best_loss"), "loss_epoch", G.rnd(F.col("best_accuracy"), 2).alias("best_accuracy"), "accuracy_epoch")


BEST = f"""WITH {EPOCHS}, w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY loss, epoch) AS rl, row_number() OVER (PARTITION BY user_id ORDER BY acc DESC, epoch) AS ra FROM e)
SELECT user_id, {X.r_sql('min(loss)', 5)} AS best_loss, max(CASE WHEN rl = 1 THEN epoch END) AS loss_epoch, {X.r_sql('max(acc)', 2)} AS best_accuracy, max(CASE WHEN ra = 1 THEN epoch END) AS accuracy_epoch FROM w GROUP BY 1"""
ORACLE["best_epoch"] = BEST


@query
def run_log(spark, sf):
    """The same figures out of log lines mixed with others."""
    e = epochs(spark, sf)
    line = F.format_string("Epoch %d/10 | train loss: %.5f, acc: %.2f%% | test loss: %.5f, acc: %.2f%%", F.col("epoch"), F.col("l") / 99000.0, F.col("a") / 101.0, F.col("l") / 100000.0, F.col("a") / 100.0)
    lines = e.select("user_id", F.explode(F.array(line, F.lit("saving checkpoint"))).alias("line"))
    r = M.best_epoch(M.parse_runs(lines, "user_id", "line"), "user_id")
    return r.select("user_id", G.rnd(F.col("best_loss"), 5).alias("best_loss"), "loss_epoch", G.rnd(F.col("best_accuracy"), 2).alias("best_accuracy"), "accuracy_epoch")


ORACLE["run_log"] = BEST


@query
def stack_split(spark, sf):
    t = train_rows(spark, sf)
    s = R.stack(t.where("event_id % 5 <> 0"), t.where("event_id % 5 = 0"))
    return s.groupBy("split", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


ORACLE["stack_split"] = f"WITH {TRAIN} SELECT CASE WHEN event_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split, CAST(label AS BIGINT) AS label, count(*) AS n FROM t GROUP BY 1, 2"


def _scored_model(spark, sf, kind, sparse=None):
    t = train_rows(spark, sf).withColumn("region", L.zero_if_missing(F.col("event_id") % 8 - 1).cast("double")).persist()
    model = L.fit_model(kind, t.where("event_id % 5 <> 0"), Y.FEATURES, sparse=sparse)
    return L.probability(model, t.where("event_id % 5 = 0")).select("event_id", "label", F.round("p", 4).alias("p"))


@query
def lr(spark, sf):
    return _scored_model(spark, sf, "lr", {"region": 7})


@query
def mlp(spark, sf):
    return _scored_model(spark, sf, "mlp")


@query
def gbt(spark, sf):
    return _scored_model(spark, sf, "gbt")


@query
def fm(spark, sf):
    return _scored_model(spark, sf, "fm")


@query
def cross_lr(spark, sf):
    return _scored_model(spark, sf, "cross_lr")


@query
def model_comparison(spark, sf):
    t = train_rows(spark, sf)
    r = L.compare(["lr", "mlp", "fm"], t.where("event_id % 5 <> 0"), t.where("event_id % 5 = 0"), Y.FEATURES)
    return r.select("model", "rank", "top", F.round("accuracy", 4).alias("accuracy"), F.round("log_loss", 4).alias("log_loss"), F.round("auc", 4).alias("auc"))


@query
def uplift(spark, sf):
    """Average uplift and propensity per tenth of the propensity score."""
    t = train_rows(spark, sf).withColumn("treated", (F.col("event_id") * 13 % 3 == 0).cast("int"))
    t = t.withColumn("outcome", F.col("feature_0") / 100 + F.col("treated") * F.col("feature_1") / 50).persist()
    s = L.score_uplift(L.fit_uplift(t, "treated", "outcome", Y.FEATURES[:6]), t, "treated")
    return s.select("event_id", "treated", F.round("uplift", 4).alias("uplift"), F.round("fitted", 4).alias("fitted"), F.round("propensity", 4).alias("propensity"))


def _texts(spark, sf):
    return X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id")


@query
def text_classes(spark, sf):
    """Source of a document from its characters: predicted class per labelled document."""
    d = _texts(spark, sf).persist()
    m = L.fit_text_classifier(d, "text", "source")
    return m.transform(d).select("doc_id", "source", F.col("prediction").cast("long").alias("class"))


@query
def score_two_columns(spark, sf):
    """One text model of all documents scored on two columns of each: classes, names, top and all probabilities."""
    d = X.table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("c"), F.format_string("%02d", F.col("doc_id") % 12)).alias("y")).persist()
    m = L.fit_text_classifier(d.select(F.col("text").alias("address"), "y").where("address IS NOT NULL AND y IS NOT NULL"), "address", "y")
    two = d.select("doc_id", F.col("text").alias("sender"), F.reverse("text").alias("recipient"))
    r = L.score_columns(m, two, ["sender", "recipient"], "address", L.SCENES)
    found = [f"{c}_scene_{v}" for c in ("sender", "recipient") for v in ("id", "name", "pro", "pro_list")]
    return r.select("doc_id", *found, F.size("recipient_scene_pro_list").alias("n_classes"))
