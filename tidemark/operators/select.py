"""Selection: label matchers and inclusive time ranges over samples and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import Matcher, all_of


def select_samples(samples: DataFrame, matchers: Sequence[Matcher], mint: int | None = None, maxt: int | None = None) -> DataFrame:
    """Samples of the series that all matchers accept, within [mint, maxt]."""
    found = samples.where(all_of(matchers, F.col("labels")))
    if mint is not None:
        found = found.where(F.col("t") >= mint)
    return found if maxt is None else found.where(F.col("t") <= maxt)


def overlapping(chunks: DataFrame, mint: int, maxt: int) -> DataFrame:
    """Chunks (or blocks) whose [min_time, max_time] meets [mint, maxt]; each is kept whole."""
    return chunks.where((F.col("min_time") <= maxt) & (F.col("max_time") >= mint))


def select_chunks(chunks: DataFrame, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
    """Whole chunks that overlap the range, of the series that all matchers accept."""
    return overlapping(chunks.where(all_of(matchers, F.col("labels"))), mint, maxt)


def query_pair(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose labels hold the name with exactly this value; an absent label is not the empty value here."""
    return rows.where(F.map_contains_key("labels", name) & (F.col("labels")[name] == value))


def xor_only(chunks: DataFrame) -> DataFrame:
    """The chunks; reading the data of any of another encoding fails."""
    wrong = F.raise_error(F.concat(F.lit("not_supported: encoding "), F.coalesce(F.col("encoding").cast("string"), F.lit("none"))))
    return chunks.withColumn("data", F.when(F.col("encoding") == "XOR", F.col("data")).otherwise(wrong.cast("binary")))
