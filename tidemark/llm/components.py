"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, scope


#: Up to so many edges (a few MB) one task joins them, after they have been counted; beyond it, all do, in rounds.
FEW = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) to (node, component), by union-find; the least node of a component is its root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([find(x) for x in nodes], type=pa.int64())], names=["node", "component"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node that an edge (a, b) names; component is the least node it is connected to.

    Each round is two grouped minima, each with a join back, on rows of two numbers; edges never leave the executors.
    Rounds are written to the shared folder, so a lost executor costs one round's tasks. The number of rounds grows
    with the logarithm of the longest path. A table counted to have at most ``few`` edges takes one task and no round.
    """
    with scope(edges.sparkSession) as keep:
        now = cut(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct(), "edges")
        if now.count() <= few:
            return keep(cut(now.coalesce(1).mapInArrow(_joined, "node long, component long"), "components"))
        seen = None
        while True:
            state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
            if seen == state:
                break
            seen = state
            with scope(edges.sparkSession) as keep_round:
                now = keep_round(cut(_round(now), "edges"))
        return keep(cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), "components"))


def _round(now: DataFrame) -> DataFrame:
    """A large star, then a small one."""
    both = now.union(now.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
    return small.distinct()
