"""The corpus pipeline: from raw documents to packed training sequences.

Each stage gets what the stage before it kept, written as Parquet and read again, and passes on
documents with all their columns; the last one returns packed pieces. Stages whose decision drops
documents are toxicity, near duplicates and decontamination; the PII stage rewrites texts. Each
stage begins with the executors' free memory given back, as the stages share their executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folia.llm import decontamination, ngram_join, packing, pii, toxicity
from folia.llm.common import giving_back, materialize, table


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, with memory given back before it and between the tables that it writes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with giving_back(spark):
            return stage(spark, docs, sf_dir)

    return run


@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@lean
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of documents linked by 80 % of their five-word shingles one stays."""
    return ngram_join.keep_one(docs, words=5, percent=80)


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@lean
def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data gives way to surrogates."""
    return pii.pseudonymise(docs).select(*docs.columns)


@lean
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of the documents, with their sequences and places."""
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("packing", pack),
]

#: Tokenizing, tiling and the classifier have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
