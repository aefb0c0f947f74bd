"""The driver's tables as cells, clusters, expression, embedding and boxes: whole tables, in DataFrame and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.operators.shapes import box_ring, with_bbox

CELLS_SQL = """cells as (select event_id::varchar as cell_id, event_id as cell_idx, epoch_us(ts) / 3.6e9 - 473352 as x, value as y, user_id % 4 as fov_id,
 event_type as cluster, user_id::double as v from events)"""
EXPR_SQL = """expr as (select o_custkey as cell, p_name as gene, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey
 join part on l_partkey = p_partkey group by all)"""
SEGMENT_SQL = "seg as (select c_custkey as cell, c_mktsegment as cluster from customer)"
EMB_SQL = "emb as (select vec_id as cell_id, list_transform(embedding, lambda e: e::double) as v, label from embeddings)"
BOXES_SQL = """boxes as (select p_partkey::varchar as cell_id, (p_partkey % 50) * 10.0 as x_min, floor(p_partkey / 50) * 10.0 as y_min,
 (p_partkey % 50) * 10.0 + 6 + p_size / 5 as x_max, floor(p_partkey / 50) * 10.0 + 6 + p_size / 5 as y_max from part)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, cell_idx, x (hours), y, fov_id, cluster, v of every event."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("cell_id"), F.col("event_id").alias("cell_idx"), (micros / 3.6e9 - 473352).alias("x"), F.col("value").alias("y"),
        (F.col("user_id") % 4).alias("fov_id"), F.col("event_type").alias("cluster"), F.col("user_id").cast("double").alias("v"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("cell_id", "cluster")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = items.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy(F.col("o_custkey").alias("cell"), F.col("p_name").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("cluster"))


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, s = (F.col("p_partkey") % 50) * 10.0, F.floor(F.col("p_partkey") / 50) * 10.0, 6 + F.col("p_size") / 5
    return with_bbox(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("cell_id"), box_ring(x, y, x + s, y + s).alias("ring"), F.col("p_type").alias("cluster")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes made twice as high as wide, with a hole of side 1 at a distance of 1 from the lower left corner."""
    b = boxes(spark, sf_dir).select("cell_id", F.col("x_min").alias("x"), F.col("y_min").alias("y"), (F.col("x_max") - F.col("x_min")).alias("w"))
    ring = box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + 2 * F.col("w"))
    hole = F.reverse(box_ring(F.col("x") + 1, F.col("y") + 1, F.col("x") + 2, F.col("y") + 2))
    return with_bbox(b.select("cell_id", ring.alias("ring"), F.array(hole).alias("rest")))
