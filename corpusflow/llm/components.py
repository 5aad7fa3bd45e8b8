"""Connected components of a large graph, in rounds of joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import merged, saved


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours, the larger ones or the smaller ones, to the least of its neighbourhood.

    The least neighbour is found by a grouped minimum, which is summed before the shuffle, and an
    equi-join, in which adaptive execution can split a node with very many links.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both.where("v < u" if small else "true")
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if small:
        out = side.join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = both.where("v > u").join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the least node that can be reached.

    ``edges`` has the long columns u and v. The number of rounds grows with the logarithm of the
    number of nodes; each round is written to the shared folder, so a lost executor costs one round.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == seen:
            break
        seen = sign
        now = saved(_star(_star(now, small=False), small=True), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
