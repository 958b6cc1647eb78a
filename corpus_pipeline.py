"""The corpus pipeline: five stages from raw documents to packed token ids.

Each stage takes all that the one before kept and is written as Parquet to the shared folder before the next reads it, so
a lost executor costs a stage's tasks at most. All stages but the last return the columns of documents, whatever other columns
these have and however they are named.

Defined results: a null or empty text is scored, linked with nothing, free of benchmark items, of size 0, and packed as a
document of just the end id if its source's rate takes it. Rows with a null id are scored like others, stay in the near-duplicate
stage, go with any null-id row that holds an item, and draw alike in the mix. Of rows with equal ids and texts the near-duplicate
stage leaves one. Empty documents give no packed rows; without labels every score is 0.5, which keeps all, and without benchmark
items nothing is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import classifier, decontaminate, mixing, ngram_join, packing
from tessera.llm._common import Scratch, table

#: Near duplicates: shingles of five words, Jaccard similarity of 80 percent.
SHINGLE_WORDS = 5
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, shingle_words=SHINGLE_WORDS, percent=PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out to the target weights of their sources."""
    return mixing.mix(docs)


def packed_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
    ("packing", packed_ids),
]

#: The classifier is fitted in floating point and byte-pair encoding is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir; the rows of the last one."""
    scratch = Scratch(spark)
    before, docs = None, table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        after = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs = after
    return docs
