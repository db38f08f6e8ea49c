"""The corpus pipeline: toxic and low-quality documents go, then near-duplicates and leaked benchmarks; tokens remain.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs. Models are fitted on the
labelled rows of the documents table that are not held out, not on what a stage before has kept, so that each stage is
the operator's own query. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seglattice.llm import bpe, decontam, quality, simhash, toxicity
from seglattice.llm.common import materialize, table
from seglattice.llm.queries import vocabulary_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic unit scores below one half."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, labels, model=toxicity.train(table(spark, sf_dir, "documents"), labels))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose share of good lines scores one half or more."""
    labels = table(spark, sf_dir, "labels")
    return quality.drop_low_quality(docs, labels, model=quality.train(table(spark, sf_dir, "documents"), labels))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least id: fingerprints of op2, or 0.8 of five-word shingles."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document that is left."""
    return bpe.token_digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("near-duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("tokens", tokens),
]

#: Fitted models and fingerprints have no form in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; the result of each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
