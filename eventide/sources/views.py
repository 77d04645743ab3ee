"""Canonical interaction views over the driver's tables.

An interaction log is a DataFrame ``(src, dst, t, seq)``: integer ids, integer
seconds, and ``seq`` as the explicit file order that breaks ties in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an interaction log; ``seq`` orders by (ts, event_id), which is event_id order per second."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("long").alias("dst"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).cast("long").alias("t"),
        F.col("event_id").alias("seq"),
    )


#: The same view for DuckDB; oracles prepend it as a common table expression.
IX = """ix AS (
  SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst,
         CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS seq
  FROM events)"""


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-to-supplier interactions dated by shipment; many ties, so only for order-free aggregates."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
    )
