"""One query over immutable blocks and live heads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import TsdbError
from tidemark.model import Matcher, series_key
from tidemark.operators.select import select_chunks

COLUMNS = ("labels", "min_time", "max_time", "samples")
NOTHING = "labels map<string,string>, min_time long, max_time long, samples array<struct<sample_ord: int, t: long, v: double>>, chunk_ord int, src int"


class Querier:
    """Blocks and heads are relations of chunks (labels, chunk_ord, min_time, max_time, samples); None is skipped.

    ``ranges`` gives the (min_time, max_time) of blocks where they are known: blocks outside a query's range are not read.
    Overlapping sources give duplicate samples; nothing is removed here.
    """

    def __init__(self, blocks: Sequence[DataFrame | None] = (), heads: Sequence[DataFrame | None] = (), ranges: Sequence[tuple[int, int] | None] = ()) -> None:
        spans = [*ranges, *[None] * (len(blocks) - len(ranges))]
        self.blocks = [(b, r) for b, r in zip(blocks, spans) if b is not None]
        self.heads = [h for h in heads if h is not None]

    @property
    def block_count(self) -> int:
        return len(self.blocks)

    @property
    def head_count(self) -> int:
        return len(self.heads)

    def chunks(self, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
        """Whole overlapping chunks of all sources with ``src``; without sources, no rows."""
        if not matchers:
            raise TsdbError("invalid_argument", "at least one matcher is needed")
        live = [b for b, r in self.blocks if r is None or (r[0] <= maxt and r[1] >= mint)] + self.heads
        parts = [select_chunks(s, matchers, mint, maxt).withColumn("src", F.lit(i)).select(*COLUMNS, "chunk_ord", "src") for i, s in enumerate(live)]
        return reduce(DataFrame.unionByName, parts) if parts else SparkSession.active().createDataFrame([], NOTHING)

    def select(self, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
        """(labels, chunks): each series once, its chunks by min_time, then max_time, source and position."""
        rows = self.chunks(matchers, mint, maxt)
        grouped = rows.groupBy(series_key(F.col("labels")).alias("series_key")).agg(
            F.array_sort(F.collect_list(F.struct("min_time", "max_time", "src", "chunk_ord", "samples"))).alias("chunks")
        )
        return grouped.select(F.map_from_entries("series_key").alias("labels"), "chunks")

    def samples(self, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
        """(labels, t, v) within the range, duplicates of overlapping sources included."""
        rows = self.chunks(matchers, mint, maxt)
        flat = rows.select("labels", F.explode("samples").alias("s")).select("labels", "s.t", "s.v")
        return flat.where(F.col("t").between(mint, maxt))
