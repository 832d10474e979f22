"""Delta-of-delta analysis of series, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import series_key


def in_range(x: Column, n: int) -> Column:
    """Whether x takes n bits, in the chunk format's range that is one step above two's complement."""
    return (x > -(1 << (n - 1))) & (x <= 1 << (n - 1))


def encoded_width(dod: Column) -> Column:
    """Payload bits of a delta-of-delta: 0, 14, 17, 20 or 64."""
    width = F.lit(64)
    for n in (20, 17, 14):
        width = F.when(in_range(dod, n), n).otherwise(width)
    return F.when(dod == 0, 0).otherwise(width)


def delta_of_delta(samples: DataFrame, *order: str) -> DataFrame:
    """Samples with ``delta`` and ``dod``, null where there is no predecessor for them."""
    by = Window.partitionBy("series_key").orderBy("t", *(order or ("arrival",)))
    keyed = samples.withColumn("series_key", series_key(F.col("labels")))
    keyed = keyed.withColumn("delta", F.col("t") - F.lag("t").over(by))
    return keyed.withColumn("dod", F.col("delta") - F.lag("delta").over(by)).drop("series_key")


def chunk_ref(seq: Column, offset: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 32).bitwiseOR(offset.cast("long"))


def chunk_ref_seq(ref: Column) -> Column:
    return F.shiftrightunsigned(ref, 32)


def chunk_ref_offset(ref: Column) -> Column:
    return ref.bitwiseAND(0xFFFFFFFF)
