"""Plots' tables above the operators' default number of cells: the queries return every cell, as their SQL does."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from histomesh.operators import plots as pl
from histomesh.plans import catalog

N = pl.MAX_CELLS + 2_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("large"))
    ids = spark.range(0, N, 1, 4)
    day = F.timestamp_seconds(F.lit(1704067200 + 36_000) + F.col("id"))
    ids.select(F.col("id").alias("event_id"), day.alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), (F.lit(25.0) + F.col("id") % 7).alias("value")).write.parquet(f"{at}/events.parquet")
    ids.select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), (F.col("id") % 5).cast("int").alias("label")).write.parquet(f"{at}/embeddings.parquet")
    spark.sql("select 1L as l_orderkey, 1L as l_partkey, 4.0D as l_quantity").write.parquet(f"{at}/lineitem.parquet")
    spark.sql("select 1L as o_orderkey, 3L as o_custkey").write.parquet(f"{at}/orders.parquet")
    spark.sql("select 1L as p_partkey, 'gene' as p_name").write.parquet(f"{at}/part.parquet")
    return at


NAMES = ["plot_spatial_scatter", "plot_scatter", "plot_spatial_expression"]


@pytest.mark.parametrize("name", NAMES)
def test_every_cell(spark, large, name):
    db = duckdb.connect()
    db.sql("set TimeZone = 'UTC'")
    for t in ("events", "embeddings", "lineitem", "orders", "part"):
        db.sql(f"create view {t} as select * from '{large}/{t}.parquet/*.parquet'")
    if name != "plot_scatter":
        db.sql(f"create or replace view events as select * replace (ts::timestamp as ts) from '{large}/events.parquet/*.parquet'")
    want = db.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, large).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == N and rows == sorted(want.fetchall())
