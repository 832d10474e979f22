"""Mixing sources to target weights: whole repeats plus one seeded Bernoulli copy. DataFrame functions only.

Tokens are summed by source (partial sums before the shuffle), a source's target is its weight's share of the
mix, held at ``cap`` times what it has, and the excess goes to the others by weight. A document is emitted
floor(rate) times, and once more when a hash of the seed and the document falls below the rate's fraction.

Defined cases: a null text has size 0; null is a source of its own, last in order; empty tables give empty
results; repeated rows are decided alike; columns of the caller's table are kept apart in a struct, so none
can clash; a source without tokens has target 0 and rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target and rate of each source, from rows (source, size).

    The result has one row a source; its windows run over those rows, never over documents. With sources in
    ascending order of cap * size / weight, the level is the first (T - capped so far) / (weight left) that
    does not exceed the source's own ratio: where sharing the excess again and again ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.select(
        "source", "source_size", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("weight")
    ).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("ratio", F.col("limit") / F.col("weight"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("limit").over(filled), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    )
    per = per.withColumn("level", level)
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_size", "level"))).over(everything)["level"]
    target = F.when(water.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), water * F.col("weight")))
    per = per.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("rate", rate)


def seeded_unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that only the seed and the parts decide: 32 bits of MD5, which any SQL engine has."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """Rows (row, size, source_size, target, copies): ``row`` is the document's own row as a struct."""
    rows = docs.select(
        F.struct("*").alias("row"),
        docs["source"].alias("source"),
        word_count(docs["text"]).alias("size"),
        seeded_unit(seed, docs["doc_id"], docs["text"]).alias("u"),
    )
    plan = source_plan(docs.select(docs["source"].alias("source"), word_count(docs["text"]).alias("size")), weights, share, cap)
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"]))
    whole = F.floor("rate")
    copies = whole + (F.col("u") < F.col("rate") - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document's row ``copies`` times, with ``copy`` from 1 unless a column has that name."""
    names = mixed.schema["row"].dataType.names
    out = mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("row.*", *([] if "copy" in [n.lower() for n in names] else ["copy"]))
