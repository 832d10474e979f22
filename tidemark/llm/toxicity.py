"""Toxicity as ordinal regression with cumulative links over sparse text features.

Features are hashed words and their first few bytes, present or absent in a document. One weight vector is shared by
all thresholds: P(grade > k) = sigmoid(w.x - t_k), t_0 < t_1 < ... The expected severity is the sum of these over k.

The model is fitted on the driver, on at most ``MAX_TRAIN`` labelled rows (those least by a hash of their id; of several
documents of one id the one of the least text hash) with at most ``MAX_FEATURES`` features. Features are counted and chosen in
the cluster; a row comes to the driver as the numbers of its chosen features, two bytes each, so neither the corpus nor the
length of texts decides what is collected and sent out. Scoring is one pass over the documents without a shuffle.

Labels that only say toxic or not are graded first: 0 for clean documents; toxic ones 1, or 2 if they hold more than
the median number of chosen features that are far more frequent in toxic documents than in clean ones.

Defined cases: null and empty texts have no features and the least severity; rows with a null id or null label are not
trained on; without labels of both kinds every severity is 0; repeated rows are scored alike; very long texts are read
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.runtime import cut, scope

MAX_TRAIN, MAX_FEATURES, BITS = 8000, 50_000, 22
PREFIXES = (4, 5, 6, 7, 8)
#: A feature counts as far more frequent when its log odds ratio is above this.
STRONG = 3.0

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and prefix, repeats included."""
    scan = tokens.Scan(column, _BREAKS, latin=True)
    row = np.repeat(np.arange(len(column)), np.diff(scan.bounds))
    size = scan.last - scan.first
    kept, found = [row], [scan.hashes() >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        longer = size > k
        kept.append(row[longer])
        found.append(tokens.mix(scan.hashes(k)[longer] + np.uint64(k)) >> np.uint64(64 - BITS))
    return np.concatenate(kept), np.concatenate(found).astype(np.int32)


@dataclass(frozen=True)
class OrdinalModel:
    ids: np.ndarray  # features with a weight, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; none: severity is 0

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return sum((_sigmoid(scores - t) for t in self.thresholds), np.zeros(len(scores)))

    def score(self, column: pa.Array) -> np.ndarray:
        total = np.zeros(len(column))
        if not len(self.ids):
            return total
        dense = np.zeros(1 << BITS, dtype=bool)
        dense[self.ids] = True
        for a, b in tokens.chunks(column):
            row, found = features(column.slice(a, b - a))
            used = dense[found]
            pairs = np.unique(row[used].astype(np.int64) << BITS | found[used])
            weights = self.weights[np.searchsorted(self.ids, pairs & ((1 << BITS) - 1))]
            total[a:b] = np.bincount(pairs >> BITS, weights, minlength=b - a)
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _among(ids: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS, dtype=bool)
    table[ids] = True
    return table


@dataclass(frozen=True)
class Sample:
    """Labelled documents by their chosen features: ``ids`` ascending with their log odds, row i's are codes[bounds[i] : bounds[i + 1]]."""

    ids: np.ndarray
    odds: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    toxic: np.ndarray

    def grades(self) -> np.ndarray:
        """0 for clean, 1 or 2 for toxic documents by how many strong features they hold."""
        if not self.toxic.any():
            return self.toxic.astype(int)
        strong = np.concatenate(([0], np.cumsum(self.odds[self.codes] > STRONG)))
        hits = strong[self.bounds[1:]] - strong[self.bounds[:-1]]
        return np.where(self.toxic, 1 + (hits > np.median(hits[self.toxic])), 0)


def fit(sample: Sample, grades: np.ndarray, steps: int = 400, decay: float = 1e-4) -> OrdinalModel:
    """Cumulative-link regression by full-batch Adam."""
    ids, rows = sample.ids, len(grades)
    if not rows or grades.min() == grades.max() or not len(ids):
        return OrdinalModel(np.zeros(0, dtype=np.int32), np.zeros(0), np.zeros(0))
    row, col = np.repeat(np.arange(rows), np.diff(sample.bounds)), sample.codes
    top = int(grades.max())
    at = np.zeros(len(ids) + top)  # weights, then the first threshold and the logs of the gaps to the others
    at[len(ids)] = 1.0
    m, v = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        w, first, gaps = at[: len(ids)], at[len(ids)], np.exp(at[len(ids) + 1 :])
        bounds = np.concatenate(([-np.inf], first + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        x = np.bincount(row, w[col], minlength=rows)
        above, below = _sigmoid(x - bounds[grades]), _sigmoid(x - bounds[grades + 1])  # P(grade >= own), P(grade > own)
        p = np.maximum(above - below, 1e-12)
        up, down = above * (1 - above) / p, below * (1 - below) / p
        by_x = -(up - down) / rows
        by_bound = np.bincount(grades, up, minlength=top + 1)[1:] / rows - np.bincount(grades, down, minlength=top + 1)[:-1] / rows
        later = np.cumsum(by_bound[::-1])[::-1]
        g = np.concatenate((np.bincount(col, by_x[row], minlength=len(ids)) + decay * w, [later[0]], later[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    thresholds = at[len(ids)] + np.concatenate(([0.0], np.cumsum(np.exp(at[len(ids) + 1 :]))))
    return OrdinalModel(ids, at[: len(ids)], thresholds)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, toxic, text) to (id, toxic, features): each text's distinct features."""
    for batch in batches:
        for a, b in tokens.chunks(batch.column(2)):
            part = batch.slice(a, b - a)
            row, found = features(part.column(2))
            pairs = np.unique(row.astype(np.int64) << BITS | found)
            ends = np.searchsorted(pairs, np.arange(b - a + 1) << BITS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "toxic", "features"])


def _coded(ids: np.ndarray):
    """Rows (id, toxic, features) to the numbers of those features that are among ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(x, dtype=np.int32) for x in batch.column(2).to_pylist()]
            codes = [np.searchsorted(ids, x[np.isin(x, ids)]).astype("<u2").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, type=pa.binary())], names=["id", "toxic", "codes"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Sample:
    """At most ``max_train`` labelled documents with the ``max_features`` features that tell toxic from clean best.

    A feature counts if it is in two rows or more and its log odds ratio is over two standard errors from 0.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic").cast("int") > 0).alias("toxic")).dropna().distinct()
    rows = rows.orderBy(F.xxhash64("id"), "id", "toxic").limit(max_train)
    text = docs.select(docs["doc_id"].cast("long").alias("doc"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # the sample is at most max_train rows of two values
    joined = text.join(F.broadcast(rows), text["doc"] == rows["id"])
    one = joined.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    with scope(docs.sparkSession):
        held = cut(one.select("id", "toxic", "text").mapInArrow(_packed, "id long, toxic boolean, features array<int>"), "labelled")
        sizes = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
        n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
        counts = held.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.when(F.col("toxic"), 1)).alias("k1"), F.count("*").alias("k"))
        a, b = F.col("k1") + 0.5, F.col("k") - F.col("k1") + 0.5
        odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
        judged = counts.where("k > 1").select("feature", odds.alias("odds"), (F.abs(odds) / F.sqrt(1 / a + 1 / b)).alias("strength")).where("strength > 2")
        chosen = cut(judged.orderBy(F.desc("strength"), "feature").limit(min(max_features, 1 << 16)).select("feature", "odds"), "features").toArrow()
        order = np.argsort(chosen["feature"].to_numpy())
        ids = chosen["feature"].to_numpy()[order].astype(np.int32)
        got = held.mapInArrow(_coded(ids), "id long, toxic boolean, codes binary").toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    codes = [np.frombuffer(x, dtype="<u2") for x in got["codes"].to_pylist()]
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64)
    flat = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, dtype=np.int64)
    return Sample(ids, chosen["odds"].to_numpy()[order], flat, bounds, np.array(got["toxic"].to_pylist(), dtype=bool))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    sample = training_sample(docs, labels, max_train)
    return fit(sample, sample.grades())


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """All rows of ``docs`` with what the model says in front: (severity, row)."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity = model.severity(model.score(batch.column(0).field(at)))
            yield pa.RecordBatch.from_arrays([pa.array(severity), batch.column(0)], names=["severity", "row"])

    packed = docs.select(F.struct("*").alias("row"))  # the text travels once
    return packed.mapInArrow(run, f"severity double, row {packed.schema['row'].dataType.simpleString()}")


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows (doc_id, severity, grade, toxic) for each document; toxic where the severity is ``reject`` or more."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, max_train)).select("row.doc_id", "severity")
    return scored.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= reject).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents below ``reject``, with all their columns."""
    return score(docs, train(docs, labels, max_train)).where(F.col("severity") < reject).select("row.*")
