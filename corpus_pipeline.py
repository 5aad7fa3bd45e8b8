"""The corpus pipeline: filters, de-duplicates, decontaminates and encodes ``documents``.

Each stage reads all that the stage before has kept. ``run`` writes each stage's result as Parquet to
the shared folder and reads it again, so a lost executor never costs more than a stage.

Edge cases: a null or empty text fails the base quality rule and goes in the first stage; rows without
an id are documents like others; of rows that share an id one stays; columns beside those of
``documents`` are kept up to the last stage; no documents, labels or benchmark items give what is left
(without labels the base rules alone decide).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import decontam, neardup, quality, spm
from corpusflow.llm.common import saved, small_batches, table
from corpusflow.llm.queries import PIECES, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the isolation forest rejects go."""
    small_batches(spark)
    return quality.kept_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, a Jaccard similarity of 0.8, verified) the document with the smallest id stays."""
    small_batches(spark)
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    small_batches(spark)
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is encoded in pieces (``ids``, 4 bytes each) and decoded again to compare it with the text."""
    small_batches(spark)
    return spm.report(docs, tokenizer_path(PIECES), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: SQL can't express the forest, the fingerprints or the encoding; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
