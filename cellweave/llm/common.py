"""Helpers shared by the text operators: Arrow passes over whole rows, staged tables, gapless numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stage


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


BATCH = 4 << 20  #: bytes of rows that a task hands to Python at once
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """From now on Arrow batches of the session hold about ``BATCH`` bytes (or one larger row), unless its limit is lower already.

    Spark's own limits, 10000 rows and 64 MB, let a task hold several copies of long texts in the JVM and in Python.
    """
    now = df.sparkSession.conf.get(_LIMIT).rstrip("b")
    if now.isdigit() and int(now) > BATCH:
        df.sparkSession.conf.set(_LIMIT, str(BATCH))
    return df


def map_rows(df: DataFrame, read: list[str], fields: str, make: Callable, keep: list[str] | None = None) -> DataFrame:
    """Add columns computed by a batch function; rows, their order and the kept columns stay.

    ``make()`` runs once a task and returns ``work(*arrays) -> list of value lists``. A new
    column replaces one of the same name. Memory: one Arrow batch of about ``BATCH`` bytes.
    """
    new = StructType.fromDDL(fields)
    names = {f.name for f in new}
    stay = [f for f in df.schema if f.name not in names and (keep is None or f.name in keep)]
    schema = StructType(stay + list(new))
    df = df.select(*[df[f"`{n}`"] for n in dict.fromkeys([f.name for f in stay] + read)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(schema), make()
        for b in batches:
            made = work(*[b.column(b.schema.get_field_index(c)) for c in read])
            cols = [b.column(b.schema.get_field_index(f.name)) for f in stay]
            cols += [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(f.name).type) for f, v in zip(new, made)]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    return small_batches(df).mapInArrow(run, schema)


def numbered(rows: DataFrame, group: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Gapless numbers from 0 within each group, however large the group.

    The rows are written once; a row's place in its file then is its identity. Windows see at most
    ``block`` rows of one file, and a prefix sum over the block counts gives each block its start.
    """
    t = stage(rows, "numbered")
    t = t.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    t = t.withColumn("_block", F.floor(F.col("_row") / block))
    key = [group, "_file", "_block"]
    starts = t.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_row"))
    same = [F.col("r." + k).eqNullSafe(F.col("s." + k)) if k == group else F.col("r." + k) == F.col("s." + k) for k in key]
    t = t.withColumn("_place", place).alias("r").join(starts.alias("s"), same)
    return t.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col("_start") + F.col("_place") - 1).alias(name))


class Marks:
    """A set of 64-bit hashes as a bitmap of fixed size. It may hold too much, never too little."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def has(self, h: np.ndarray) -> np.ndarray:
        spot = h & np.uint64((1 << self.bits) - 1)
        return (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def marks(hashes: DataFrame, bits: int, old: Marks | None = None) -> Marks:
    """The values of column ``hash``, together with an older bitmap: at most 2 ** (bits - 6) words reach the driver."""
    spot = F.col("hash").bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(spot, 6).alias("word"), F.expr("shiftleft(1L, int(hash & 63))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64) if old is None else old.words.copy()
    out[found["word"].to_numpy()] |= found["bits"].to_numpy().view(np.uint64)
    return Marks(bits, out)


def maybe_among(ids: DataFrame, id_col: str, bits: int = 25) -> Callable[[Column], Column]:
    """A condition that holds for every id of a table, of any size, and for few others: what it rejects needs no join.

    The ids' hashes are broadcast as a bitmap of 2 ** bits bits; the more ids there are, the more others it lets pass.
    """
    shared = ids.sparkSession.sparkContext.broadcast(marks(ids.select(F.xxhash64(id_col).alias("hash")), bits))

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h.to_numpy().view(np.uint64)))

    return lambda c: among(F.xxhash64(c))
