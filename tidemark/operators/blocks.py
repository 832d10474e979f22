"""Chunks, blocks and compaction as relations.

Samples carry ``block_ord`` (the position of their block among the inputs). Chunks of the native layout are cut by
count, which SQL can check; chunks of the binary format are cut by bytes (operators/chunks.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import TsdbError
from tidemark.model import series_key

CHUNK = 50


def with_chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """Samples with ``chunk_ord`` within their block and series, and ``sample_ord`` within their chunk."""
    keyed = samples.withColumn("series_key", series_key(F.col("labels")))
    place = F.row_number().over(Window.partitionBy("block_ord", "series_key").orderBy("t", "arrival")) - 1
    return keyed.withColumn("place", place).withColumn("chunk_ord", F.floor(F.col("place") / size)).withColumn("sample_ord", F.col("place") % size).drop("place")


def chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(block_ord, series_key, labels, chunk_ord, min_time, max_time, n, samples); a chunk has at most ``size`` samples."""
    grouped = with_chunks(samples, size).groupBy("block_ord", "series_key", "chunk_ord").agg(
        F.min("t").alias("min_time"), F.max("t").alias("max_time"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("sample_ord", "t", "v"))).alias("samples"),
    )
    return grouped.withColumn("labels", F.map_from_entries("series_key"))


def chunk_meta(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(block_ord, labels, chunk_ord, min_time, max_time, n) without the samples."""
    grouped = with_chunks(samples, size).groupBy("block_ord", "series_key", "chunk_ord").agg(F.min("t").alias("min_time"), F.max("t").alias("max_time"), F.count("*").alias("n"))
    return grouped.withColumn("labels", F.map_from_entries("series_key"))


def block_meta(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(block_ord, min_time, max_time, num_samples, num_series, num_chunks): counts per series first, then per block."""
    per = samples.groupBy("block_ord", series_key(F.col("labels")).alias("series_key")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    return per.groupBy("block_ord").agg(
        F.min("lo").alias("min_time"), F.max("hi").alias("max_time"), F.sum("n").alias("num_samples"),
        F.count("*").alias("num_series"), F.sum(F.ceil(F.col("n") / size)).alias("num_chunks"),
    )


def compacted(samples: DataFrame, *order: str) -> DataFrame:
    """One sample for each (labels, t): the last by input block, then by the given order within blocks.

    An arg-max is an aggregate with partial results, so neither a hot series nor a hot timestamp is ever sorted whole.
    """
    last = F.struct("block_ord", *(order or ("arrival",)))
    grouped = samples.groupBy(series_key(F.col("labels")).alias("series_key"), "t").agg(F.max_by("v", last).alias("v"))
    return grouped.select(F.map_from_entries("series_key").alias("labels"), "t", "v")


def compacted_meta(blocks: DataFrame) -> DataFrame:
    """(level, sources) of the block that these (ulid, level, sources) are compacted to; no input is an error."""
    if blocks.isEmpty():
        raise TsdbError("invalid_argument", "nothing to compact")
    exploded = blocks.select("level", F.explode("sources").alias("source"))
    return exploded.agg((F.max("level") + 1).alias("level"), F.array_sort(F.collect_set("source")).alias("sources"))
