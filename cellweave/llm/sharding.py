"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

LEVELS = ("region", "rack", "shard")


def layout(shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> list[dict]:
    """A tree for a shard count: the first ``base`` shards fill regions of ``racks`` racks of ``per_rack`` shards.

    Every shard beyond ``base`` is a region of its own. So one more shard changes the weight of no
    older subtree, and the only draw that can change a document's way is the new region's.
    """
    out = []
    for s in range(shards):
        rack = s // per_rack if s < base else base + s
        out.append({"region": rack // racks if s < base else base + s, "rack": rack, "shard": s, "weight": 1.0})
    return out


def _draws(key: Column, level: str):
    """Exponential race: the least of ``-ln(u) / weight`` wins with probability weight / total."""

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["n"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["w"]).alias("t"), child["n"].alias("n"))

    return draw


def _children(tree: list[dict], parent: str | None, level: str) -> dict:
    """parent node -> its children's total weights. Children of no weight take no rows."""
    out: dict = {}
    for leaf in tree:
        group = out.setdefault(leaf[parent] if parent else 0, {})
        group[leaf[level]] = group.get(leaf[level], 0.0) + leaf["weight"]
    return {p: {c: w for c, w in g.items() if w > 0} for p, g in out.items()}


def descend(key: Column, tree: list[dict]) -> Column:
    """The shard of a key. Node ids must be unique within a level.

    A changed weight moves rows only into or out of the subtree it belongs to at each level: the draws of
    the other nodes stay. Null keys are one key.
    """
    node: Column = F.lit(0)
    for parent, level in zip((None, *LEVELS), LEVELS):
        below = _children(tree, parent, level)
        kids = F.create_map(*[
            c for p, g in below.items() if g
            for c in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in g.items()]))
        ])
        node = F.array_min(F.transform(F.element_at(kids, node), _draws(key, level)))["n"]
    return node


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Law ``key``: the id and the shard count decide the shard; one more shard takes rows only into itself.

    One output row per input row: id, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``shard``, ``grown_shard`` (with one
    more shard) and ``slot`` (gapless from 0 in each shard). Null text counts as empty, rows of a null id go to one
    shard, repeated rows get slots of their own, other columns are not read. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        descend(F.col(id_col), layout(shards)).alias("shard"), descend(F.col(id_col), layout(shards + 1)).alias("grown_shard"),
    )
    return numbered(rows, "shard", "slot")
