"""The native layout of blocks: Parquet, one folder a block, a metrics column promoted out of the labels.

Samples of a block are written sorted by metric, series and time, so a scan prunes blocks by folder, row groups by
metric and time, and reads no labels it does not need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codecs import new_ulid
from tidemark.model import NAME, Matcher, label, series_key
from tidemark.operators.select import select_samples


def write_blocks(samples: DataFrame, path: str, level: int = 1) -> DataFrame:
    """Write samples (labels, t, v, arrival, block_ord) below ``path``; rows (ulid, block_ord, min_time, max_time, ...)."""
    spark = samples.sparkSession
    ords = [r["block_ord"] for r in samples.select("block_ord").distinct().collect()]  # one row a block
    names = spark.createDataFrame([(o, new_ulid()) for o in sorted(ords)], "block_ord long, block_ulid string")
    rows = samples.join(F.broadcast(names), "block_ord").withColumn("metric", label(F.col("labels"), NAME)).withColumn("series_hash", F.xxhash64(series_key(F.col("labels"))))
    rows.repartition("block_ulid", "metric", "series_hash").sortWithinPartitions("block_ulid", "metric", "series_hash", "t").write.mode("append").partitionBy("block_ulid").parquet(f"{path}/samples")
    meta = rows.groupBy("block_ulid", "block_ord").agg(F.min("t").alias("min_time"), F.max("t").alias("max_time"), F.count("*").alias("num_samples"), F.count_distinct("series_hash").alias("num_series"))
    meta = meta.select("block_ulid", "block_ord", "min_time", "max_time", "num_samples", "num_series", F.lit(level).alias("level"), F.array("block_ulid").alias("sources"))
    meta.write.mode("append").parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks")


def scan(spark: SparkSession, path: str, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
    """Samples within the range: blocks are pruned on the driver by their metadata, then files by the promoted column."""
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("min_time") <= maxt) & (F.col("max_time") >= mint))
    live = [r["block_ulid"] for r in blocks.select("block_ulid").collect()]
    rows = spark.read.parquet(f"{path}/samples")
    rows = rows.where(F.col("block_ulid").isin(live)) if live else rows.where(F.lit(False))
    for m in matchers:
        if m.name == NAME:
            rows = rows.where(m.on(F.col("metric")))
    return select_samples(rows, matchers, mint, maxt)

