"""All queries of the core library, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans import chunk_queries, file_queries, memory_queries, retrieval_queries, source_queries, text_queries
from corpusflow.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunk_queries", "file_queries", "flagship", "memory_queries", "retrieval_queries", "source_queries", "text_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the documents and answer the benchmark's questions from them."""
    return retrieval_queries.rag_answers(spark, sf_dir)
