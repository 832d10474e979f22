"""Samples of ordinary tables: (labels, t, v, arrival)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import labels_of


def millis(column: str) -> Column:
    """Milliseconds since the epoch of a zoneless timestamp read as UTC, whatever the session's zone; floors."""
    return F.expr(f"unix_millis(cast(convert_timezone('UTC', current_timezone(), {column}) as timestamp))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    labels = labels_of(metric="event_value", event_type=F.col("event_type"), user_id=F.col("user_id").cast("string"))
    return rows.select(labels.alias("labels"), millis("ts").alias("t"), F.col("value").alias("v"), F.col("event_id").alias("arrival"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    labels = labels_of(metric="order_total", status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))
    return rows.select(labels.alias("labels"), millis("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("arrival"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival is the tuple that makes rows distinct: order and line numbers are not unique together."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    labels = labels_of(metric="line_quantity", returnflag=F.col("l_returnflag"), linestatus=F.col("l_linestatus"))
    arrival = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select(labels.alias("labels"), millis("l_shipdate").alias("t"), F.col("l_quantity").alias("v"), arrival.alias("arrival"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and orders together: each lacks labels that the other has."""
    return events(spark, sf_dir).unionByName(orders(spark, sf_dir))
