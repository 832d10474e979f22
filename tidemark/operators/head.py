"""Ingest as relations: samples (labels, t, v, arrival) in a total order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import labels_str, series_key


def judged(samples: DataFrame, *arrival: str) -> DataFrame:
    """Samples with ``accepted``: t is not below any earlier t of its series.

    A rejected t is below the greatest accepted one, so the greatest of all earlier t decides as well as that of the
    accepted: a running maximum, which Spark streams over a sorted partition whatever its length.
    """
    before = Window.partitionBy("series_key").orderBy(*(arrival or ("arrival",))).rowsBetween(Window.unboundedPreceding, -1)
    keyed = samples.withColumn("series_key", series_key(F.col("labels")))
    return keyed.withColumn("accepted", F.coalesce(F.col("t") >= F.max("t").over(before), F.lit(True))).drop("series_key")


def accepted(samples: DataFrame, *arrival: str) -> DataFrame:
    return judged(samples, *arrival).where("accepted").drop("accepted")


def rejected(samples: DataFrame, *arrival: str) -> DataFrame:
    return judged(samples, *arrival).where("not accepted").drop("accepted")


def series_refs(samples: DataFrame, first_ref: int = 1, known: DataFrame | None = None) -> DataFrame:
    """(labels, ref): refs count up in the order in which series are first seen; those of ``known`` stay.

    Series first seen at one arrival are ordered by their labels. Samples are grouped first (with partial minima), so the
    ordering runs over the series alone.
    """
    seen = samples.groupBy(series_key(F.col("labels")).alias("series_key")).agg(F.min("arrival").alias("first"))
    if known is not None:
        held = known.select(series_key(F.col("labels")).alias("series_key"), "ref")
        first_ref_of = held.agg(F.coalesce(F.max("ref") + 1, F.lit(first_ref)).alias("next"))
        fresh = seen.join(held.select("series_key"), "series_key", "left_anti").crossJoin(first_ref_of)  # one row
        new = fresh.select("series_key", (F.row_number().over(Window.orderBy("first", "series_key")) - 1 + F.col("next")).alias("ref"))
        out = held.unionByName(new)
    else:
        out = seen.select("series_key", (F.row_number().over(Window.orderBy("first", "series_key")) - 1 + first_ref).alias("ref"))
    return out.select(F.map_from_entries("series_key").alias("labels"), F.col("ref").cast("long").alias("ref"))


def lookup(refs: DataFrame, ref: int) -> DataFrame:
    """The series (labels, ref) of one reference; no row for 0, which is nobody's, and for those not given out."""
    return refs.where(F.col("ref") == ref)


def next_ref(refs: DataFrame) -> DataFrame:
    """(next_ref): what the next new series will get; 1 where there is none yet."""
    return refs.agg((F.coalesce(F.max("ref"), F.lit(0)) + 1).alias("next_ref"))


def ref_conflicts(entries: DataFrame) -> DataFrame:
    """Of (ref, labels) rows, those that no store could hold: ref 0, one ref for two label sets, two refs for one."""
    keyed = entries.withColumn("series_key", series_key(F.col("labels"))).select("ref", "series_key").distinct()
    by_ref = keyed.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1 or ref = 0").select("ref")
    by_key = keyed.groupBy("series_key").agg(F.count("*").alias("n"), F.min("ref").alias("ref")).where("n > 1").select("ref")
    return by_ref.union(by_key).distinct()


def series_state(samples: DataFrame, *arrival: str) -> DataFrame:
    """(labels, num_samples, last_t, last_v) of each series."""
    order: Column = F.struct(*(arrival or ("arrival",)))
    grouped = samples.groupBy(series_key(F.col("labels")).alias("series_key")).agg(
        F.count("*").alias("num_samples"), F.max("t").alias("last_t"), F.max_by("v", order).alias("last_v")
    )
    return grouped.select(F.map_from_entries("series_key").alias("labels"), "num_samples", "last_t", "last_v")


def pending(samples: DataFrame, committed: int) -> DataFrame:
    """(series, samples) that a commit after the arrival ``committed`` would write."""
    old, new = samples.where(F.col("arrival") <= committed), samples.where(F.col("arrival") > committed)
    key = series_key(F.col("labels"))
    fresh = new.select(key.alias("k")).distinct().join(old.select(key.alias("k")).distinct(), "k", "left_anti")
    return fresh.agg(F.count("*").alias("series")).crossJoin(new.agg(F.count("*").alias("samples")))  # one row each


def replay(wal_series: DataFrame, wal_samples: DataFrame) -> DataFrame:
    """Samples of a log with their labels. A sample of an unknown ref, or one out of order, fails the read."""
    named = wal_samples.join(wal_series.select("ref", "labels").dropDuplicates(["ref"]), "ref", "left")
    lost = F.raise_error(F.concat(F.lit("io_error: sample of unknown ref "), F.col("ref").cast("string")))
    named = named.withColumn("labels", F.when(F.col("labels").isNull(), lost).otherwise(F.col("labels")))
    checked = judged(named, "segment", "rec_ord", "sample_ord")
    late = F.raise_error(F.concat(F.lit("io_error: out of order in "), labels_str(F.col("labels"))))
    return checked.withColumn("t", F.when(F.col("accepted"), F.col("t")).otherwise(late)).drop("accepted")
