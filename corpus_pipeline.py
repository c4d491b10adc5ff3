"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
each stage's result to the shared folder and reads it back for the next. All stages but the last
return the columns of ``documents``. SQL expresses none of the first four (hashing, automata and
fitted evidence), so ``ORACLE_SQL`` is None; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, quality, simhash, substring
from helixframe.llm.common import forget, saved
from helixframe.llm.queries import packed

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: they share at least 0.8 of their distinct shingles of five words."""
    return simhash.survivors(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id has are cut; documents with nothing left go."""
    return substring.remove_repeats(docs, window=50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that share 10 words with a benchmark item are cut; documents that are mostly such spans go."""
    return decontam.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        found = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            found = saved(found, f"stage{i}")
            forget(docs)
        docs = found
    return docs
