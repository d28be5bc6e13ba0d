"""Mixing sources by weighted fair queueing: virtual finish times, one global range sort, a cut at the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running
from ..session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of virtual time for the search of the cut; all times from EDGE on share one.
FINE, EDGE = 1024, 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, rank, target) for (source, source_size): all sources share the sum of all sizes by weight.

    Sources in code point order, null last, take the weights in turn. No target exceeds ``most`` times its source; what is above is
    shared again by weight until none is. That end is a level: a source has weight times level, or its limit if that
    is less. Sorted by limit over weight, running sums tell each source whether its limit comes first, so neither
    sources nor shares are gathered.
    """
    s = sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    s = running(s, [], ["_null", "source"], {"rank": "_one"})
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("_ratio", F.col("cap") / F.col("w"))
    s = running(s, [], ["_ratio", "rank"], {"_caps": "cap", "_ws": "w"})
    all_ = s.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    if all_.w is None:
        return s.select("source", "source_size", "rank", F.lit(0.0).alias("target"))
    d = lambda c: F.expr(f"CAST({c} AS DECIMAL(19,0))")
    full = d("cap") * d(f"{all_.w} - (_ws - w)") < d("w") * d(f"{all_.t} - (_caps - cap)")
    s = stage(s.withColumn("full", full).select("source", "source_size", "rank", "w", "cap", "full"), "sources")
    spent = s.where("full").agg(F.sum("cap").alias("c"), F.sum("w").alias("w")).first()
    left, open_ = all_.t - (spent.c or 0), all_.w - (spent.w or 0)
    level = left / open_ if open_ else 0.0
    limit = F.col("cap").cast("double")
    target = F.when(F.col("full"), limit).otherwise(F.least(limit, F.col("w") * F.lit(level)))
    return s.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, packet: int = 512, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, packets): every row with its size and its source's size and target, and what the mix takes, in order.

    1. Each source's documents are shuffled by a digest of seed and id, and up to ``most`` passes over them form its queue, in packets
       of at most ``packet`` words. A packet's virtual finish time is the words queued up to its end over the source's target.
    2. All packets are range-sorted by finish time (then source and place in the queue), and a running sum of their words cuts the
       order at the budget, the sum of all targets. The packet at the cut is cut there, so the total is exact, and
       a source is off its target by few packets.

    Before the sort a histogram of finish times finds the bucket that holds the cut; packets of later buckets can't be taken and
    aren't sorted. Running sums add ranges, so a source with most of the rows is many tasks.

    ``packets``: place (words before it), id, source, pass, start and words inside the document. ``rows`` and ``packets`` share a
    row's ``_file`` and ``_row``.
    """
    spark = docs.sparkSession
    r = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256), 1, 16).alias("_h"),
    )
    r = stage(r, "sizes").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    shares = stage(targets(r.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rows = r.alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.source_size", "s.rank", "s.target")
    rows = stage(rows, "rows")
    queued = running(rows.where("size > 0"), ["rank"], ["_h", "id", "size", "_file", "_row"], {"_upto": "size"})
    cut = queued.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet))).alias("_k"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    cut = cut.withColumn("start", F.col("_k") * packet).withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("start")))
    cut = cut.withColumn("_end", F.col("pass") * F.col("source_size") + F.col("_upto") - F.col("size") + F.col("start") + F.col("words"))
    cut = cut.withColumn("finish", F.col("_end").cast("double") / F.col("target"))
    cut = cut.select("id", "source", "rank", "pass", "start", "words", "_end", "finish", "_file", "_row")
    bucket = F.floor(F.least(F.col("finish"), F.lit(float(EDGE))) * FINE)
    budget = rows.agg(F.sum("size").alias("t")).first().t or 0
    seen, last = 0, EDGE * FINE
    # At most EDGE * FINE + 1 rows reach the driver.
    for b, n in cut.groupBy(bucket.alias("b")).agg(F.sum("words").alias("n")).orderBy("b").collect():
        seen, last = seen + n, b
        if seen >= budget:
            break
    order = running(cut.where(bucket <= last), [], ["finish", "rank", "_end"], {"_sum": "words"})
    place = F.col("_sum") - F.col("words")
    taken = order.where(place < budget).withColumn("place", place).withColumn("words", F.least("words", F.lit(budget) - F.col("place")))
    return rows, taken.select("place", "id", "source", F.col("pass").cast("int").alias("pass"), "start", "words", "finish", "_file", "_row")


def report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per row: id, size, source_size, target, taken (the words of all its packets in the mix).

    A null text has no words and a document without words is never taken; null sources are one source; a null id is
    shuffled as ``null``; repeated rows are documents of their own; texts of any length are counted whole; other columns aren't read.
    """
    rows, packets = mix(docs, id_col=id_col, **how)
    got = packets.groupBy("_file", "_row").agg(F.sum("words").alias("taken"))
    out = rows.join(got, ["_file", "_row"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
