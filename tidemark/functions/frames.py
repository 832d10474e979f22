"""Scalar codecs over columns, Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codecs, histogram


def crc32c(rows: DataFrame, column: str) -> DataFrame:
    """(column, crc32c) of a string column. Spark's own crc32 is of another polynomial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [None if t is None else codecs.crc32c(t.encode()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, type=pa.int64())], names=[column, "crc32c"])

    return rows.select(column).mapInArrow(run, f"`{column}` string, crc32c long")


def varint_round_trip(rows: DataFrame, column: str) -> DataFrame:
    """(column, encoded, decoded) of a long column as zigzag varints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spelled = [codecs.varint(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spelled), pa.array([codecs.read_varint(s)[0] for s in spelled], type=pa.int64())], names=[column, "encoded", "decoded"])

    return rows.select(F.col(column).cast("long").alias(column)).dropna().mapInArrow(run, f"`{column}` long, encoded binary, decoded long")


def histogram_round_trip(rows: DataFrame, per_chunk: int = 120) -> DataFrame:
    """(t, count, zero_count, first_bucket) written to histogram chunks and read back. Rows need t, count and zero_count;
    the one bucket holds what is not in the zero bucket. A chunk ends where its appender refuses, or at ``per_chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            appender, found = None, []
            samples = sorted(zip(*(c.to_pylist() for c in b.columns)))
            for t, count, zero in samples:
                h = histogram.Histogram(count, zero, 0, pos_spans=((0, 1),), pos=(count - zero,))
                if appender is None or appender.n == per_chunk or not appender.append(t, h):
                    found += histogram.decode(appender.getvalue()) if appender else []
                    appender = histogram.HistogramAppender()
                    appender.append(t, h)
            found += histogram.decode(appender.getvalue()) if appender else []
            columns = list(zip(*((t, h.count, h.zero_count, h.pos[0]) for t, h in found))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in columns], names=["t", "count", "zero_count", "first_bucket"])

    return rows.select("t", "count", "zero_count").mapInArrow(run, "t long, count long, zero_count long, first_bucket long")
