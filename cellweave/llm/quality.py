"""Quality rules whose cutoffs are certified on labelled documents by exact binomial bounds. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

BLANKS = r"[\x20\x09-\x0D]+"
SPAN = 8  #: words of a window
GRID = 50  #: cutoffs of a rule: 1/50 .. 50/50
RULES = ("symbols", "capitals", "repeats", "lines")


def _with(value: Column, use) -> Column:
    """``use(x)`` with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), use)[0]


def _gram(words, i):
    return F.array_join(F.slice(words, i, SPAN), " ")


def _covered(words: Column, n: Column) -> Column:
    """Words inside windows that occur twice or more: sort the windows, keep equal neighbours, add up their spans."""

    def count(s):
        same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
        dup = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
        at = F.sort_array(F.transform(dup, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + i + SPAN - F.greatest(a["end"], i)).alias("n"), (i + SPAN).alias("end")))["n"]

    grams = F.transform(F.sequence(F.lit(1), n - (SPAN - 1)), lambda i: F.struct(_gram(words, i).alias("g"), i.alias("i")))
    return _with(F.sort_array(grams), count)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, the base counts and the rule scores (0 to 1) of every row, without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    d = d.select(
        "id", "stratum", F.filter(F.split("t", BLANKS), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("t", F.lit("[A-Z]")).alias("caps"),
    )
    d = d.select(
        "id", "stratum", "w", "n_symbols", "caps", F.size("w").alias("n"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Windows with different hashes differ, so most texts are done here; the others compare the words themselves.
    hashes = F.when(F.col("n") >= SPAN, F.transform(F.sequence(F.lit(1), F.col("n") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("w", i, SPAN))))
    d = d.select("*", F.coalesce(_with(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), F.lit(False)).alias("twice"))
    d = d.select("*", F.when(F.col("twice"), _covered(F.col("w"), F.col("n"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)))
    return d.select(
        "id", "stratum", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n"))).alias("base_failed"),
        share("n_symbols", "n").alias("symbols"), share("caps", "word_chars").alias("capitals"),
        share("n_repeat_words", "n").alias("repeats"), share("n_dup_lines", "n_lines").alias("lines_"),
    ).withColumnRenamed("lines_", "lines")


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed term by term from the logarithm of the first one."""
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(a, i):
        term = a["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("log"), (a["sum"] + F.exp(term)).alias("sum"))

    return F.when(k == 0, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add)["sum"])


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float, error: float, id_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(stratum, one column per rule: the bin from which it rejects, or null; number of strata).

    A rule may reject at most ``risk / rules`` of a stratum's good documents. A cutoff is certified if the exact
    chance of seeing so few rejections at a higher rate, P(Bin(n, rate) <= k), is at most ``error`` divided by all tests
    made (strata x rules x cutoffs); so with a chance of 1 - error every cutoff in use keeps its promise. Of the
    certified cutoffs the strictest is taken; more rejections can't be certified where fewer aren't.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    held = scored.join(good, "id", "left_semi").where(~F.col("base_failed"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.floor(F.col(r) * GRID).cast("int").alias("bin")) for r in RULES]))
    bins = stage(held.select("stratum", rules.alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(F.count("*").alias("c")), "bins")
    strata = bins.select("stratum").distinct().count()
    rate, level = risk / len(RULES), error / max(1, strata * len(RULES) * GRID)
    per = bins.groupBy("stratum", "rule").agg(F.collect_list(F.struct("bin", "c")).alias("h"), F.sum("c").cast("double").alias("n"))
    tests = per.select("stratum", "rule", "n", "h", F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("cut"))
    k = F.aggregate(F.filter("h", lambda x: x["bin"] >= F.col("cut")), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    tests = tests.select("stratum", "rule", "n", "cut", k.alias("k"))
    # From the expected number on the chance is near a half or more: no need to sum it.
    sure = F.when(F.col("k") < F.col("n") * rate, tail(F.col("k"), F.col("n"), rate) <= level).otherwise(F.lit(False))
    sure = tests.where(sure).groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])
    return stage(sure, "cutoffs"), strata


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.02, error: float = 0.05, small: int = 10_000) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A row is kept if it passes the base rules and reaches no certified cutoff of its stratum. In strata with too few good
    labelled documents nothing is certified, so only the base rules act. Null texts have no words; a null stratum is a
    stratum; repeated rows are judged alike, and repeated labels count once; other columns are not read.
    The cutoffs (a row per stratum) are broadcast up to ``small`` strata.
    """
    scored = stage(features(docs, id_col, text_col, stratum_col), "features")
    cuts, strata = cutoffs(scored, labels, risk, error, id_col, label_col)
    if strata <= small:
        cuts = F.broadcast(cuts)
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(F.floor(F.col(r) * GRID) >= F.col(f"cut_{r}"), F.lit(False))
    out = scored.join(cuts, "stratum", "left")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~hit).alias("kept"))
