"""Reranking of candidates: by score, and by score and diversity (maximal marginal relevance)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.providers import scorer
from corpusflow.settings import DEFAULTS


def scored(candidates: DataFrame, provider: str = "overlap") -> DataFrame:
    return candidates.withColumn("rerank_score", scorer(provider)(F.col("query"), F.col("text")))


def rerank(candidates: DataFrame, n: int | None = None, provider: str = "overlap", default: int = DEFAULTS.rerank) -> DataFrame:
    """The n best candidates of each query; equal scores keep their order of retrieval. 0 means the default."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "retrieval_rank")
    return scored(candidates, provider).withColumn("rerank_rank", F.row_number().over(best)).where(F.col("rerank_rank") <= (n or default))


def min_max(candidates: DataFrame, score: str = "rerank_score") -> DataFrame:
    """``relevance``: the score between the query's least and largest; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return candidates.withColumn("relevance", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)))


def select_diverse(relevance: list[float], similarity: np.ndarray, n: int, lam: float) -> list[int]:
    """Greedy choice: relevance against the largest similarity to what is chosen; ties to the earliest."""
    chosen: list[int] = []
    left = list(range(len(relevance)))
    while left and len(chosen) < n:
        gain = [lam * relevance[i] - (1 - lam) * (max(similarity[i][j] for j in chosen) if chosen else 0.0) for i in left]
        chosen.append(left.pop(int(np.argmax(gain))))
    return chosen


def rerank_diverse(candidates: DataFrame, n: int = DEFAULTS.rerank, lam: float = DEFAULTS.mmr_lambda, provider: str = "overlap", k: int = DEFAULTS.retrieve) -> DataFrame:
    """(query_id, retrieval_rank, rerank_score, mmr_rank): n candidates of each query that differ from each other.

    The similarity of two candidates is their score as query and text. Only the first k candidates of
    a query enter, so a group is small. A query with no more than n candidates is plainly reranked.
    """
    rows = scored(candidates.where(F.col("retrieval_rank") <= k), provider)
    a = rows.select("query_id", F.col("retrieval_rank").alias("i"), F.col("text").alias("query"))
    b = rows.select(F.col("query_id").alias("_q"), F.col("retrieval_rank").alias("j"), "text")
    pairs = a.join(b, (F.col("query_id") == F.col("_q")) & (F.col("i") < F.col("j")))
    pairs = pairs.select("query_id", "i", "j", scorer(provider)(F.col("query"), F.col("text")).alias("s"))
    s = F.when(F.col("s") < 0, (F.col("s") + 1) / 2).otherwise(F.least(F.col("s"), F.lit(1.0)))
    matrix = pairs.groupBy("query_id").agg(F.collect_list(F.struct("i", "j", s.alias("s"))).alias("pairs"))
    lists = min_max(rows).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("retrieval_rank", "rerank_score", "relevance"))).alias("own"))

    def pick(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for q, own, near in zip(batch["query_id"], batch["own"], batch["pairs"], strict=True):
                place = {r["retrieval_rank"]: k for k, r in enumerate(own)}
                m = np.eye(len(own))
                for p in near if near is not None else []:
                    m[place[p["i"]], place[p["j"]]] = m[place[p["j"]], place[p["i"]]] = p["s"]
                if len(own) <= n:
                    order = sorted(range(len(own)), key=lambda i: -own[i]["rerank_score"])
                else:
                    order = select_diverse([r["relevance"] for r in own], m, n, lam)
                out += [(q, own[i]["retrieval_rank"], own[i]["rerank_score"], r + 1) for r, i in enumerate(order)]
            yield pd.DataFrame(out, columns=["query_id", "retrieval_rank", "rerank_score", "mmr_rank"])

    kind = candidates.schema["query_id"].dataType.simpleString()
    return lists.join(matrix, "query_id", "left").mapInPandas(pick, f"query_id {kind}, retrieval_rank int, rerank_score double, mmr_rank int")


def joined_texts(rank: str) -> Column:
    """An aggregate: the texts of a group in their order, with a blank line between them."""
    texts = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), "text")))
    return F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n")


def context(ranked: DataFrame, rank: str = "rerank_rank") -> DataFrame:
    """(query_id, context) of the few candidates that are left for each query."""
    return ranked.groupBy("query_id").agg(joined_texts(rank).alias("context"))
