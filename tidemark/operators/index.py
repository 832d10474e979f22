"""Inverted-index views over a relation of series (labels, ...): one row a (name, value, series)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import Matcher, series_key


def series(samples: DataFrame) -> DataFrame:
    """Distinct label sets of samples or chunks, as (series_key, labels). Partial distinct happens before the shuffle."""
    return samples.select(series_key(F.col("labels")).alias("series_key")).distinct().withColumn("labels", F.map_from_entries("series_key"))


def postings(of: DataFrame) -> DataFrame:
    """(name, value, series_key) for each label of each series."""
    return of.select("series_key", F.explode("series_key").alias("e")).select("e.key", "e.value", "series_key").toDF("name", "value", "series_key")


def posting_lists(of: DataFrame) -> DataFrame:
    """(name, value, series) with the sorted list of series; for exports, since a list is as long as its series are many."""
    return postings(of).groupBy("name", "value").agg(F.sort_array(F.collect_set("series_key")).alias("series"))


def lookup(of: DataFrame, name: str, value: str) -> DataFrame:
    """Series that hold exactly this pair."""
    return of.where(F.map_contains_key("labels", name) & (F.col("labels")[name] == value))


def for_name(of: DataFrame, name: str) -> DataFrame:
    """Series that hold the name with any value."""
    return of.where(F.col("labels")[name].isNotNull())


def all_series(of: DataFrame) -> DataFrame:
    """Series with a label at all: those without are in no posting list."""
    return of.where(F.size(series_key(F.col("labels"))) > 0)


def for_matcher(of: DataFrame, matcher: Matcher) -> DataFrame:
    return of.where(matcher.column(F.col("labels")))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("series_key").distinct(), "series_key", "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("series_key").distinct(), "series_key", "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["series_key"])


def label_names(of: DataFrame) -> DataFrame:
    return of.select(F.explode(series_key(F.col("labels"))["key"]).alias("name")).distinct()


def label_values(of: DataFrame, name: str) -> DataFrame:
    return of.where(F.col("labels")[name].isNotNull()).select(F.col("labels")[name].alias("value")).distinct()


def symbols(of: DataFrame) -> DataFrame:
    """All strings that an index of these series names, and the empty one."""
    entries = series_key(F.col("labels"))
    parts = F.concat(entries["key"], entries["value"])
    return of.select(F.explode(parts).alias("symbol")).union(of.sparkSession.range(1).select(F.lit(""))).distinct()
