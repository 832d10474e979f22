"""Samples to XOR chunks and back: the only operators that need Python, Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import xor
from tidemark.model import series_key

CHUNKS = "series_key array<struct<key: string, value: string>>, chunk_ord int, min_time long, max_time long, n int, encoding string, data binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (series, t, v) sorted by series: a series is read as a stream and only its open chunk is held."""
    key, open_chunk, first, ordinal, out = None, None, 0, 0, []

    def close() -> None:
        out.append((key, ordinal, first, open_chunk.t, open_chunk.n, "XOR", open_chunk.getvalue()))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = (schema, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["series_key", "chunk_ord", "min_time", "max_time", "n", "encoding", "data"])

    schema = None
    for batch in batches:
        schema = batch.schema.field(0).type
        bits = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64).tolist()
        for k, t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bits):
            if k != key:
                if open_chunk:
                    close()
                key, open_chunk, ordinal, first = k, xor.XorAppender(), 0, t
            elif open_chunk.size() > xor.CUT_ABOVE or open_chunk.n == xor.MAX_SAMPLES:
                close()
                open_chunk, ordinal, first = xor.XorAppender(), ordinal + 1, t
            open_chunk.append(t, v)
        if out:
            yield flush()
    if open_chunk:
        close()
        yield flush()


def encode_chunks(samples: DataFrame, *order: str) -> DataFrame:
    """XOR chunks of samples (labels, t, v), cut as they exceed the target size: rows as in CHUNKS, with labels."""
    keyed = samples.select(series_key(F.col("labels")).alias("series_key"), "t", "v", *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    dealt = keyed.repartition("series_key").sortWithinPartitions("series_key", "t", *[f"o{i}" for i in range(len(order))])
    return dealt.select("series_key", "t", "v").mapInArrow(_encode, CHUNKS).withColumn("labels", F.map_from_entries("series_key"))


#: Samples that leave the decoder in one batch, but for those of its last chunk.
DECODED = 16_384


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows to samples, some chunks at a time; the rows' own columns, without the data, are repeated by index."""

    def samples(kept: pa.RecordBatch, rows: list[int], lengths: list[int], held: list[tuple[int, int]]) -> pa.RecordBatch:
        taken = kept.take(pa.array(np.repeat(rows, lengths))).columns if kept.num_columns else []
        place = np.concatenate([np.arange(k) for k in lengths]).astype(np.int32)
        t = np.fromiter((t for t, _ in held), dtype=np.int64, count=len(held))
        bits = np.fromiter((b for _, b in held), dtype=np.uint64, count=len(held))
        columns = [*taken, pa.array(place), pa.array(t), pa.array(bits.view(np.float64)), pa.array(bits.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "sample_ord", "t", "v", "v_bits"])

    for batch in batches:
        kept, rows, lengths, held = batch.select(range(batch.num_columns - 1)), [], [], []
        for row, data in enumerate(batch.column(batch.num_columns - 1)):
            before = len(held)
            held.extend(xor.decode(data.as_py()))
            rows.append(row)
            lengths.append(len(held) - before)
            if len(held) >= DECODED:
                yield samples(kept, rows, lengths, held)
                rows, lengths, held = [], [], []
        if held:
            yield samples(kept, rows, lengths, held)


def decode_chunks(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep..., sample_ord, t, v, v_bits) of all samples of all chunks."""
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keep)
    return chunks.select(*keep, "data").mapInArrow(_decode, f"{kinds}{', ' if keep else ''}sample_ord int, t long, v double, v_bits long")


def num_samples(data: Column) -> Column:
    """The sample count in a chunk's first two bytes."""
    return F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
