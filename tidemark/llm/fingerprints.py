"""Document fingerprints: one-permutation MinHash with optimal densification and packed b-bit values.

Each five-word shingle is hashed once; the top bits name its bin and the rest is its value, of which a bin keeps the
least. An empty bin takes the value of the first non-empty bin in an order of all bins drawn for it alone, the same
for every document: the fixed point of probing with a fresh hash until a full bin is hit. The low bits of the mixed
values are packed into a hexadecimal string. Two fingerprints agree in a share m of bins; chance alone makes 2**-b
agree, so the likeness is (m - 2**-b) / (1 - 2**-b), held to 0..1.

Neighbours: documents are dealt into ranges of doc_id at quantiles of that column; a range also gets the first row of
the next range, so each document meets its successor in one pass and each text is shuffled once.

Defined cases: null texts are empty; an empty text, or one of white space only, has the fingerprint "" which is like
"" and unlike any other; texts of fewer than five words have their whole sequence as one shingle; null ids come first;
rows of one id are ordered by text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.runtime import shuffle_width

BINS, BITS, WORDS = 512, 4, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def _orders(bins: int) -> np.ndarray:
    """_orders(bins)[i, j]: the place of bin j in the order that bin i probes."""
    rng = np.random.Generator(np.random.PCG64(bins))
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)


def values(texts: list[str], bins: int = BINS, bits: int = BITS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The b-bit values (texts x bins) and which texts have words."""
    hashes, bounds = tokens.shingles(*tokens.word_hashes(pa.array(texts, type=pa.string())), words)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    least = np.full(len(texts) * bins, _NONE)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    np.minimum.at(least, owner * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(len(texts), bins)
    full = least != _NONE
    orders = _orders(bins)
    some = full.any(axis=1)
    for i in np.flatnonzero(some & ~full.all(axis=1)):
        have, lack = np.flatnonzero(full[i]), np.flatnonzero(~full[i])
        least[i, lack] = least[i, have[np.argmin(orders[np.ix_(lack, have)], axis=1)]]
    salt = tokens.mix(np.arange(1, bins + 1, dtype=np.uint64))  # bins that share a value still agree by chance one by one
    return (tokens.mix(least ^ salt) & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def pack(v: np.ndarray, bits: int = BITS) -> str:
    return np.packbits(np.unpackbits(v[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes().hex()


def unpack(fingerprint: str, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    raw = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8))[: bins * bits].reshape(bins, bits)
    return raw @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray, bits: int = BITS) -> np.ndarray:
    chance = 2.0**-bits
    near = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, near, (a_some == b_some).astype(float))


def _bucket(x: Column, bounds: list) -> Column:
    """How many bounds are at most x, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < bounds[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(x.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, text, ahead) dealt by bucket and in order. ``ahead`` marks a copy of the first row of the
    next range, or after the last range of the first; its own row is elsewhere."""
    spark = docs.sparkSession
    n = shuffle_width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), [int(b) for b in bounds]))
    # at most one row a range comes to the driver: its first id
    firsts = {r["bucket"]: (r["lo"], r["nulls"]) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    ids = [lo for lo, nulls in firsts.values() if lo is not None and not nulls]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(nulls for _, nulls in firsts.values()):
        first = first | F.col("doc_id").isNull()
    to = F.create_map(*[F.lit(x) for b in used for x in (b, before[b])]) if used else F.create_map(F.lit(0), F.lit(0))
    copies = rows.where(first).groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    copies = copies.select(F.element_at(to, F.col("bucket")).alias("bucket"), "doc_id", "text", F.lit(1).alias("ahead"))
    both = rows.select("bucket", "doc_id", "text", F.lit(0).alias("ahead")).unionByName(copies)
    return both.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # the last row, whose successor is still to come
    for whole in batches:
        for a, b in tokens.chunks(whole.column(2), 1 << 20):
            part = whole.slice(a, b - a)
            held += zip(*(part.column(i).to_pylist() for i in range(4)))
            if done := _chunk(held):
                yield done
            held = held[-1:]


def _chunk(rows: list[tuple]) -> pa.RecordBatch | None:
    own = [i for i in range(len(rows) - 1) if not rows[i][3]]  # each is followed by a row of its range, or its copy
    if not own:
        return None
    texts = [r[2] for r in rows]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
    v, some = values(texts + edited)
    i, e = np.array(own), np.arange(len(rows), len(rows) + len(own))
    prints = [pack(v[k]) if some[k] else "" for k in (*i, *e)]
    columns = [
        pa.array([rows[k][1] for k in own], type=pa.int64()),
        pa.array([len(texts[k]) for k in own], type=pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], type=pa.string()),
        pa.array(prints[: len(own)], type=pa.string()),
        pa.array(prints[len(own) :], type=pa.string()),
        pa.array(likeness(v[i], some[i], v[e], some[e])),
        pa.array(likeness(v[i], some[i], v[i + 1], some[i + 1])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def fingerprint_with_neighbours(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and likenesses to it and to the successor."""
    return with_next(docs).mapInArrow(_fingerprint, SCHEMA)
