"""Annotation-shaped tables, projected from the keys of the given ones.

The tables hold no images, so sizes, boxes, rounds and replies are arithmetic on their keys; each grows with
its table. ``WITH`` is the same in SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.sources.tables import read_table

#: Order keys that make up one image.
ORDERS_PER_IMAGE = 50
CATEGORIES = ["A", "R"]

WITH = f"""
images as (select p_partkey as image_id, cast(320 + (p_partkey * 37) % 1600 as int) as w, cast(240 + (p_partkey * 53) % 1200 as int) as h from part),
boxes as (select cast(l_orderkey // {ORDERS_PER_IMAGE} as bigint) as image_id, l_returnflag as label,
  row_number() over (partition by l_orderkey // {ORDERS_PER_IMAGE} order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) as det_idx,
  (l_partkey * 37) % 700 as x1, (l_suppkey * 53 + l_orderkey * 11) % 700 as y1,
  (l_partkey * 37) % 700 + 60 + (l_suppkey * 7) % 240 as x2,
  (l_suppkey * 53 + l_orderkey * 11) % 700 + 60 + (l_partkey * 13) % 240 as y2, l_partkey, l_suppkey, l_orderkey, l_linenumber from lineitem),
rounds as (select o_custkey as image_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as round,
  cast((o_orderkey * 7) % 11 as int) as score, o_orderkey, 'round of ' || cast(o_orderkey as varchar) as feedback from orders),
replies as (select o_orderkey, '<think>a</think><score> ' || cast(o_orderkey % 14 as varchar) || ' </score><feedback>near (' || cast(o_custkey % 1000 as varchar) || ', ' ||
  cast(o_orderkey % 1000 as varchar) || ')</feedback>' || case when o_orderkey % 3 = 0 then '<actions>REMOVE #1</actions>' else '' end as reply from orders),
yolo as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, '0 0.' || lpad(cast((l_partkey * 37) % 1000 as varchar), 3, '0') || ' 0.5 0.' ||
  lpad(cast(l_suppkey % 1000 as varchar), 3, '0') || case when l_orderkey % 17 = 0 then '' else ' 0.25' end as ln from lineitem)
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, w, h)."""
    return read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey as image_id", "cast(320 + (p_partkey * 37) % 1600 as int) as w", "cast(240 + (p_partkey * 53) % 1200 as int) as h"
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, det_idx, x1, y1, x2, y2 and keys) on the 0-1000 scale."""
    w = Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    return (
        plain_boxes(spark, sf_dir)
        .withColumn("det_idx", F.row_number().over(w))
        .drop("l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    )


def plain_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``boxes``, without the numbering and the shuffle it takes."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(
        f"l_orderkey div {ORDERS_PER_IMAGE} as image_id", "l_returnflag as label",
        "(l_partkey * 37) % 700 as x1", "(l_suppkey * 53 + l_orderkey * 11) % 700 as y1",
        "(l_partkey * 37) % 700 + 60 + (l_suppkey * 7) % 240 as x2",
        "(l_suppkey * 53 + l_orderkey * 11) % 700 + 60 + (l_partkey * 13) % 240 as y2",
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax",
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, round, score, o_orderkey, feedback)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("image_id"), F.row_number().over(w).alias("round"),
        F.expr("cast((o_orderkey * 7) % 11 as int)").alias("score"), "o_orderkey", F.concat(F.lit("round of "), F.col("o_orderkey").cast("string")).alias("feedback"),
    )


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, reply)."""
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "concat('<think>a</think><score> ', cast(o_orderkey % 14 as string), ' </score><feedback>near (', cast(o_custkey % 1000 as string), ', ', "
        "cast(o_orderkey % 1000 as string), ')</feedback>', case when o_orderkey % 3 = 0 then '<actions>REMOVE #1</actions>' else '' end) as reply",
    )


def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, l_suppkey, ln)."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "concat('0 0.', lpad(cast((l_partkey * 37) % 1000 as string), 3, '0'), ' 0.5 0.', lpad(cast(l_suppkey % 1000 as string), 3, '0'), "
        "case when l_orderkey % 17 = 0 then '' else ' 0.25' end) as ln",
    )
