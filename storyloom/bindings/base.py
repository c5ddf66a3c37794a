"""The driver's tables seen as narrative tables: orders are facts, line items evidence, customers characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.catalog import t

FACTS_SQL = """facts AS (SELECT o_orderkey AS node_id, o_custkey AS char_id, CASE WHEN o_orderstatus = 'F' THEN 'CharacterState' ELSE 'Event' END AS label, o_orderpriority || ' ' || o_orderkey AS name,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(year(o_orderdate) - 1991 AS INT) END AS chapter, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 10) / 10 END AS story_order FROM orders)"""
EVIDENCE_SQL = """evidence AS (SELECT l_orderkey AS node_id, l_orderkey * 8 + l_linenumber AS chunk_id, CAST(year(l_shipdate) - 1991 AS INT) AS chapter, l_linenumber AS idx, l_partkey, l_suppkey, l_quantity FROM lineitem)"""


def facts(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("node_id"), F.col("o_custkey").alias("char_id"), F.when(F.col("o_orderstatus") == "F", "CharacterState").otherwise("Event").alias("label"), F.concat_ws(" ", "o_orderpriority", k).alias("name"),
        F.when(k % 4 == 0, None).otherwise(F.year("o_orderdate") - 1991).cast("int").alias("chapter"), F.when(k % 5 == 0, None).otherwise((k % 10) / 10).alias("story_order"),
    )


def evidence(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunk_id"), (F.year("l_shipdate") - 1991).cast("int").alias("chapter"), F.col("l_linenumber").alias("idx"), "l_partkey", "l_suppkey", "l_quantity")
