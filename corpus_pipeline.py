"""The corpus pipeline: toxic documents, near duplicates and benchmark leaks go, secrets are redacted, sources are mixed.

Each stage is a function (spark, docs, sf_dir) over all that its predecessor kept. All but the last return the columns
of ``docs``; the last adds ``copy``, the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, jaccard, mixing, secrets, toxicity
from tidemark.llm.runtime import cut, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of less than half a grade of expected severity stay (ordinal regression on the labelled rows)."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one of the least id stays."""
    return jaccard.keep_one(docs, 5, jaccard.Threshold(80, 100))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go (positional index)."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that the forest takes for secrets are replaced in the text; every document stays."""
    return secrets.redact(docs, secrets.Forest(secrets.labelled_findings(spark), dictionary=secrets.corpus_dictionary(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at random so that sources reach their target shares."""
    return mixing.emit(mixing.mix_sources(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The toxicity model is fitted, and the forest too; SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
