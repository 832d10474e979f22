r"""Token counts of a sentencepiece model: pieces counted once per distinct pre-token, joined to frequencies by document.

A pre-token is a run of word marks with the text up to the next mark, or a line feed. No piece of the model reaches over
such a border (checked against its vocabulary when it is loaded), so a document's count is the sum over its pre-tokens of
frequency x pieces, and no document is ever encoded.

  pieces   the corpus's distinct pre-tokens with their frequency (partial counts before the shuffle); each is encoded once
  common   the most frequent pre-tokens, as many as ``MAX_ROWS`` rows and ``MAX_BYTES`` bytes allow, are broadcast
  rest     what is left of a document are its rare pre-tokens, so no key is hot: they are shuffled once, by pre-token, where
           they become rows (document, pre-token, frequency) and meet their pieces; only (document, tokens) goes back

Rows of one id and one text are one document until the end, where each row comes out again.

Defined cases: a null or empty text has 0 bytes and 0 tokens; very long texts and very long words count whole; control
characters, U+0000 too, are characters like any other; repeated rows each have a row; empty tables give no rows; other
columns are not read. A model with pieces over borders encodes every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.runtime import cut, scope

MARK = "▁"
#: Where pre-tokens end: before and after a line feed, and before a mark (or the space it stands for) after anything else.
BORDER = rf"(?=[ {MARK}\n])(?:(?=\n)|(?<![ {MARK}\n]))|(?<=\n)"
MAX_ROWS, MAX_BYTES = 1 << 18, 1 << 24


class PieceCounter:
    """Counts the pieces of pre-tokens, each with its marks as marks or spaces, with the model at ``path``."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1)]
        self.splits = not crossing and model.encode("a  b\n c") == model.encode("a") + model.encode("\n" + MARK)[2:] + model.encode("b") + model.encode("\n")[1:] + model.encode("c")

    def pieces(self, units: list[str]) -> list[int]:
        # the model itself puts one mark before a text; a line feed before the unit shields those without
        marked = [len(u) > 1 and u[0] in (MARK, " ") for u in units]
        got = self.model.encode([u[1:] if m else "\n" + u for u, m in zip(units, marked)], num_threads=1)
        return [len(g) - (0 if m else 2) for g, m in zip(got, marked)]


@cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _encoder(path: str):
    """Rows (unit, times) with the unit's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.chunks(batch.column(0)):
                part = batch.slice(a, b - a)
                n = pa.array(_counter(path).pieces(part.column(0).to_pylist()), type=pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n], names=["unit", "times", "pieces"])

    return run


def units(text: Column) -> Column:
    """A text's pre-tokens in order, those of an empty text too: the model puts a mark before it, but drops that of nothing."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_remove(F.split(F.concat(F.lit(" "), text), BORDER), ""))


def _common_from(pieces: DataFrame, max_rows: int, max_bytes: int) -> int:
    """The least power of two such that the pre-tokens that are as frequent or more stay within both bounds."""
    power = F.floor(F.log2("times")).cast("int").alias("power")
    sizes = pieces.groupBy(power).agg(F.count("*").alias("n"), F.sum(F.octet_length("unit") + 32).alias("size")).collect()  # a row a power
    least, rows, held = 64, 0, 0
    for power, n, size in sorted(sizes, reverse=True):
        rows, held = rows + n, held + size
        if rows > max_rows or held > max_bytes:
            break
        least = power
    return 1 << min(least, 62)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of ``docs``."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = _joined(rows, model_path, max_rows, max_bytes) if _counter(model_path).splits else _whole(rows, model_path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _joined(rows: DataFrame, model_path: str, max_rows: int, max_bytes: int) -> DataFrame:
    key = ["doc_id", "h"]
    with scope(rows.sparkSession) as keep:
        # the text's hash tells apart the texts of one id: where no id is repeated, no row has to carry it
        repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        rows = rows if repeated else rows.withColumn("h", F.lit(0).cast("long"))
        frequency = rows.select(F.explode(units(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("times"))
        pieces = cut(frequency.mapInArrow(_encoder(model_path), "unit string, times long, pieces long"), "pieces")
        from_ = _common_from(pieces, max_rows, max_bytes)
        own = rows.sparkSession.range(1).select(F.lit("").alias("unit"), F.lit(0).cast("long").alias("pieces"))  # a row's own: no pre-token is empty
        common = own.union(pieces.where(F.col("times") >= from_).select("unit", "pieces"))
        each = rows.select(*key, "n_bytes", F.explode(F.concat(F.array(F.lit("")), units(F.col("text")))).alias("unit"))
        of_common = each.join(F.broadcast(common), "unit").groupBy(*key).agg(F.sum("pieces").alias("n"), F.count(F.when(F.col("unit") == "", 1)).alias("copies"), F.max("n_bytes").alias("n_bytes"))
        # dealt by pre-token once, for the frequencies and for their join
        rare = rows.select(*key, F.explode(units(F.col("text"))).alias("unit")).join(F.broadcast(common.select("unit")), "unit", "left_anti").repartition("unit")
        rare = rare.groupBy("unit", *key).agg(F.count("*").alias("times")).join(pieces.where(F.col("times") < from_).select("unit", "pieces"), "unit")
        rare = rare.select(*key, (F.col("times") * F.col("pieces")).alias("n"))
        total = of_common.unionByName(rare, allowMissingColumns=True).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "copies")], F.max("n_bytes").alias("n_bytes"))
        total = keep(cut(total, "token-counts"))
    # equal rows have been counted together
    return total.select("doc_id", "n_bytes", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


def _whole(rows: DataFrame, model_path: str) -> DataFrame:
    """The same by encoding each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _counter(model_path).model
        for batch in batches:
            for a, b in tokens.chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                n = np.array([len(model.encode(t)) for t in part.column(2).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "n_bytes", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
