"""Named tables by day."""

import uuid

import pytest
from pyspark.sql import types as T

from cellweave.sources import catalog

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def name(spark):
    n = f"t_{uuid.uuid4().hex}"
    yield n
    spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_days_of_a_table(spark, name):
    catalog.ensure_table(spark, name, SCHEMA)
    a = spark.createDataFrame([("x", 1, 9), (None, None, 9)], "name string, id int, other int")
    for dt in ("20240101", "20240102", "20240103"):
        catalog.write_day(a, name, dt)
    catalog.ensure_table(spark, name, SCHEMA)
    catalog.write_day(a.where("id = 1"), name, "20240102")
    catalog.write_day(a.limit(0), name, "20240103")
    got = catalog.read_days(spark, name, "20240101", "20240103")
    assert sorted((r.dt, r.id or 0, r.name or "") for r in got.collect()) == [("20240101", 0, ""), ("20240101", 1, "x"), ("20240102", 1, "x")]
    one = catalog.read_days(spark, name, "20240102", cols=["id"])
    assert all("dt=20240102" in f for f in one.inputFiles()) and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "ReadSchema: struct<id:bigint>" in plan
    with pytest.raises(ValueError):
        catalog.ensure_table(spark, name, T.StructType(SCHEMA.fields[:1]))
    with pytest.raises(ValueError):
        catalog.write_day(a, name, "2024' OR")


def test_table_from_a_query(spark, name):
    d = catalog.create_as(spark.range(5).selectExpr("id", "id % 2 = 0 AS even"), name)
    assert d.where("even").count() == 3 and spark.catalog.tableExists(name)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create_as(spark.range(2), name)
