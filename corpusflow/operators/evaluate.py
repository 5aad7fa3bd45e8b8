"""Evaluation of retrieval: topic coverage, top scores, reciprocal ranks, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_coverage(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """(query_id, docs_retrieved, top_score, topics_found, total_topics, topic_coverage) of each question.

    ``hits`` is (query_id, text, score), ``topics`` (query_id, topics): a topic is found if any text
    that was retrieved contains it, whatever its case.
    """
    both = topics.join(hits, "query_id", "left")
    each = F.transform("topics", lambda t: F.coalesce(F.contains(F.lower("text"), F.lower(t)), F.lit(False)))
    one = both.select("query_id", "topics", "score", F.col("text").isNotNull().cast("long").alias("_n"), F.posexplode_outer(each).alias("_i", "_hit"))
    found = one.groupBy("query_id", "_i").agg(F.bool_or("_hit").alias("_hit"), F.sum("_n").alias("_n"), F.max("score").alias("_s"), F.first(F.size("topics")).alias("_t"))
    out = found.groupBy("query_id").agg(F.max("_n").alias("docs_retrieved"), F.max("_s").alias("top_score"), F.count_if("_hit").alias("topics_found"), F.max("_t").cast("long").alias("total_topics"))
    return out.withColumn("topic_coverage", F.when(F.col("total_topics") > 0, F.round(F.col("topics_found") / F.col("total_topics"), 2)))


def by_tier(coverage: DataFrame, tier: str = "tier") -> DataFrame:
    """Means of each tier, and over all questions (tier is null)."""
    return coverage.rollup(tier).agg(F.count("*").alias("questions"), F.avg("topic_coverage").alias("coverage"), F.avg("top_score").alias("score"))


def mean_reciprocal_rank(ranked: DataFrame, relevant: str = "relevant", rank: str = "rank", k: int = 10) -> DataFrame:
    """The mean over all queries of 1 / rank of the first relevant hit within k; 0 where there is none."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col(relevant) & (F.col(rank) <= k), F.col(rank))).alias("_r"))
    return first.agg(F.avg(F.coalesce(1 / F.col("_r"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"))


def ingest_summary(results: DataFrame) -> DataFrame:
    """Totals of an ingestion: documents, how many succeeded and failed, chunks, characters."""
    ok = F.col("status") == "STORED"
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))


def health(checks: DataFrame) -> DataFrame:
    """healthy if all components are, else degraded."""
    return checks.agg(F.bool_and("ok").alias("_ok"), F.count("*").alias("components")).select(F.when(F.col("_ok"), "healthy").otherwise("degraded").alias("status"), "components")
