"""Session settings and the shared folders the iterative jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "cellweave", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on. Cluster settings come from the submit command."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # A union must not promise a common partitioning that a skew split then breaks.
        .config("spark.sql.unionOutputPartitioning", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared work folder, ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster every
    executor has to see what another one wrote.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="cellweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, scanned by column."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def each(df: DataFrame, keep: list, items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per item of an array.

    The outer generator plus a null test does what ``explode`` does, but the optimizer adds
    no ``size(items) > 0`` filter, which it would push down and so compute a costly array twice.
    """
    gen = F.posexplode_outer(items).alias(pos, name) if pos else F.explode_outer(items).alias(name)
    return df.select(*keep, gen).where(F.col(name).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to ``spark.cellweave.partitions`` partitions, or four for each core: a table of few large row groups would keep few tasks busy."""
    n = df.sparkSession.conf.get("spark.cellweave.partitions", None)
    return df.repartition(int(n) if n else 4 * df.sparkSession.sparkContext.defaultParallelism)
