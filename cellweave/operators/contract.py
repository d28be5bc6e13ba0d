"""Greedy contraction of neighbouring pieces in a fixed order: many small groups at a time in one task, large ones in parallel rounds."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, stage
from . import runs as R

BOX = ["x0", "x1", "y0", "y1"]


def contract(nodes: DataFrame, edges: DataFrame, keys: list[str], max_size: int | None = None, min_share: float | None = None, later_only: bool = False, boxed: bool = False, room: int = R.ROOM) -> DataFrame:
    """``(keys, pid, owner)``: the piece that each piece ends in, by the sequential rule.

    The rule visits the pieces of a key once, in the order of (size, pid) that they start with. A piece that has merged away, or has
    more than ``max_size`` cells by then, is passed over. Any other merges into the neighbour with the longest common border
    (ties: smallest pid), borders and sizes as they are then; it stays if it has no neighbour. With ``later_only`` only pieces
    later in the order are neighbours, with ``min_share`` only those with a longer share of its outline, with ``boxed``
    only those whose first box touches its present one.

    Keys of at most ``room`` pieces are visited in that very order, many keys in one task (``in_turn``); larger ones go by rounds over all tasks.

    Rounds: a piece is decided once no earlier undecided piece is its neighbour or its neighbours' neighbour. Until then
    such a piece could merge into it, or change or remove a neighbour; no other can, since a common border with a merged piece is one with
    a member of it. So a round decides many pieces at once and the result is that of the sequence. Each round adds up
    borders, sizes and outlines of what has merged; groups are never gathered.

    ``nodes``: keys, pid, n, sides, x0, x1, y0, y1; ``edges``: keys, a, b, k in both directions.
    """
    nodes = cut_lineage(nodes.select(*keys, "pid", *[F.col(c).cast("long").alias(c) for c in ("n", "sides", *BOX)]))
    edges = cut_lineage(edges.select(*keys, "a", "b", F.col("k").cast("long").alias("k")))
    rule = {"max_size": max_size, "min_share": min_share, "later_only": later_only, "boxed": boxed}
    large = stage(nodes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > room).select(*keys), "large")
    part = lambda how: [t.join(F.broadcast(large), keys, how) for t in (nodes, edges)]
    small = _in_turn(*part("left_anti"), keys, rule)
    return small if large.isEmpty() else small.unionByName(_by_rounds(*part("left_semi"), keys, **rule))


def in_turn(n: list[int], sides: list[int], box: list[list[int]], near: list[dict[int, int]], order: Iterable[int], max_size: int | None, min_share: float | None, later_only: bool, boxed: bool) -> list[int]:
    """The piece that each piece of one key ends in; pieces are numbered by pid, ``near`` has their neighbours with the common border."""
    order = list(order)
    turn = {p: i for i, p in enumerate(order)}
    owner, first = list(range(len(n))), [tuple(b) for b in box]
    for p in order:
        if max_size is not None and n[p] > max_size:
            continue
        x0, x1, y0, y1 = box[p]
        best = None
        for q, k in near[p].items():
            if later_only and turn[q] < turn[p] or min_share is not None and not k / sides[p] > min_share:
                continue
            if boxed:
                b = first[q]
                if b[0] > x1 + 1 or x0 > b[1] + 1 or b[2] > y1 + 1 or y0 > b[3] + 1:
                    continue
            by = -k, turn[q] if later_only else q
            if best is None or by < best[0]:
                best = by, q
        if best is None:
            continue
        q = owner[p] = best[1]
        k = near[q].pop(p)
        del near[p][q]
        n[q] += n[p]
        sides[q] += sides[p] - 2 * k
        b = box[q]
        box[q] = [min(b[0], x0), max(b[1], x1), min(b[2], y0), max(b[3], y1)]
        for r, k in near[p].items():
            del near[r][p]
            near[r][q] = near[q][r] = near[q].get(r, 0) + k
    for p in range(len(owner)):  # a piece may have joined one that merged later
        while owner[p] != owner[owner[p]]:
            owner[p] = owner[owner[p]]
    return owner


def _in_turn(nodes: DataFrame, edges: DataFrame, keys: list[str], rule: dict) -> DataFrame:
    """``contract`` of keys that fit a batch: their pieces, each followed by its borders, sorted by key and pid."""
    numbers = ["n", "sides", *BOX]
    null = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    rows = nodes.select(*keys, "pid", *numbers, null("b", edges), null("k", edges)).unionByName(
        edges.select(*keys, F.col("a").alias("pid"), *[null(c, nodes) for c in numbers], "b", "k"))
    fields = nodes.select(*keys, "pid", F.col("pid").alias("owner")).schema

    def plain(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return list(zip(*[c.to_pylist() for c in column.flatten()])) if pa.types.is_struct(column.type) else column.to_pylist()

    def f(table, key):
        is_piece = table.column("n").is_valid().to_numpy()
        at = np.flatnonzero(is_piece)
        piece = table.take(pa.array(at))
        name, of = plain(piece.column("pid")), key[at]
        place = {x: i for i, x in enumerate(zip(of.tolist(), name))}
        n, sides, *box = (piece.column(c).to_pylist() for c in numbers)
        # Rows are sorted by key and pid, so pieces are, too.
        cut = np.concatenate([np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), [len(of)]]).tolist()
        base = np.repeat(cut[:-1], np.diff(cut)).tolist()
        near: list[dict[int, int]] = [{} for _ in name]
        border = table.take(pa.array(np.flatnonzero(~is_piece)))
        for g, a, b, k in zip(key[~is_piece].tolist(), plain(border.column("pid")), plain(border.column("b")), border.column("k").to_pylist()):
            i = place[g, a]
            near[i][place[g, b] - base[i]] = k
        owner = np.zeros(len(name), np.int64)
        for a, b in zip(cut, cut[1:]):
            order = sorted(range(b - a), key=lambda i: (n[a + i], i))  # noqa: B023
            owner[a:b] = in_turn(n[a:b], sides[a:b], [list(x) for x in zip(*[c[a:b] for c in box])], near[a:b], order, **rule)
            owner[a:b] += a
        return pa.table([*[piece.column(k) for k in keys], piece.column("pid"), piece.column("pid").take(pa.array(owner))], names=[*keys, "pid", "owner"])

    return R.whole_keys(rows, keys, ["pid"], f, T.StructType([T.StructField(x.name, x.dataType) for x in fields]))


def _by_rounds(nodes: DataFrame, edges: DataFrame, keys: list[str], max_size: int | None, min_share: float | None, later_only: bool, boxed: bool) -> DataFrame:
    box = BOX
    start = F.struct(F.col("n").alias("n"), F.col("pid").alias("pid"))
    nodes = cut_lineage(nodes.select(*keys, "pid", start.alias("rank"), "n", "sides", *box, *[F.col(c).alias(f"{c}_0") for c in box], F.lit(False).alias("done")))
    edges = cut_lineage(edges)
    owner = nodes.select(*keys, "pid", F.col("pid").alias("owner"))
    small = F.col("n") <= max_size if max_size is not None else F.lit(True)
    for turn in itertools.count(1):
        todo = nodes.where(~F.col("done") & small).select(*keys, "pid", "rank")
        if todo.isEmpty():
            return owner
        # The earliest undecided neighbour of every piece, and the earliest among the neighbours' neighbours.
        one = edges.join(todo.withColumnsRenamed({"pid": "b", "rank": "r"}), [*keys, "b"], "left").groupBy(*keys, "a").agg(F.min("r").alias("first"))
        two = edges.join(one.withColumnsRenamed({"a": "b", "first": "second"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("second").alias("second"))
        wait = one.join(two, [*keys, "a"]).select(*keys, F.col("a").alias("pid"), F.least("first", "second").alias("least"))
        ready = todo.join(wait, [*keys, "pid"], "left").where(F.col("least").isNull() | (F.col("rank") <= F.col("least"))).select(*keys, "pid")

        mine = nodes.join(ready, [*keys, "pid"], "left_semi").select(*keys, F.col("pid").alias("a"), "rank", "sides", *box)
        other = nodes.select(*keys, F.col("pid").alias("b"), F.col("rank").alias("rank_b"), *[F.col(f"{c}_0").alias(f"{c}_b") for c in box])
        pairs = edges.join(mine, [*keys, "a"]).join(other, [*keys, "b"])
        if later_only:
            pairs = pairs.where("rank_b > rank")
        if min_share is not None:
            pairs = pairs.where(F.col("k") / F.col("sides") > min_share)
        if boxed:
            pairs = pairs.where("x0_b <= x1 + 1 AND x0 <= x1_b + 1 AND y0_b <= y1 + 1 AND y0 <= y1_b + 1")
        best = F.min_by(F.struct("b", "k"), F.struct((-F.col("k")).alias("o"), F.col("rank_b" if later_only else "b").alias("t")))
        moves = cut_lineage(pairs.groupBy(*keys, "a").agg(best.alias("m")).select(*keys, "a", F.col("m.b").alias("to"), "m.k"))

        to = moves.select(*keys, F.col("a").alias("pid"), "to")
        gone = nodes.join(moves.withColumnRenamed("a", "pid"), [*keys, "pid"])
        gain = gone.groupBy(*keys, F.col("to").alias("pid")).agg(
            F.sum("n").alias("gn"), F.sum(F.col("sides") - 2 * F.col("k")).alias("gs"), *[(F.min if c[1] == "0" else F.max)(c).alias(f"g{c}") for c in box])
        now = nodes.join(to, [*keys, "pid"], "left_anti").join(gain, [*keys, "pid"], "left").join(ready.withColumn("_r", F.lit(True)), [*keys, "pid"], "left")
        nodes = cut_lineage(now.select(
            *keys, "pid", "rank", (F.col("n") + F.coalesce("gn", F.lit(0))).alias("n"), (F.col("sides") + F.coalesce("gs", F.lit(0))).alias("sides"),
            *[(F.least if c[1] == "0" else F.greatest)(c, f"g{c}").alias(c) for c in box], *[f"{c}_0" for c in box], (F.col("done") | F.coalesce("_r", F.lit(False))).alias("done"),
        ))
        ends = lambda e, c: e.join(to.withColumnsRenamed({"pid": c, "to": "_to"}), [*keys, c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        edges = cut_lineage(ends(ends(edges, "a"), "b").where("a <> b").groupBy(*keys, "a", "b").agg(F.sum("k").alias("k")))
        owner = owner.join(to.withColumnsRenamed({"pid": "owner", "to": "_to"}), [*keys, "owner"], "left").select(*keys, "pid", F.coalesce("_to", "owner").alias("owner"))
        owner = owner if turn % 6 else cut_lineage(owner)
