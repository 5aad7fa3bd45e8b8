"""The approximate index against exact search: recall, pruning, exactness with all lists, edge cases."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ann, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 32))
    rows = [(i, (centres[i % 30] + r.normal(scale=0.5, size=32)).tolist()) for i in range(3000)] + [(9000, None), (None, [1.0] * 32), (9001, [0.0] * 32)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return ann.build(corpus, str(tmp_path_factory.mktemp("ann")), 24, parts=8)


def asked(corpus):
    return corpus.where("vec_id % 100 = 0 AND vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def rows(df, name):
    return {(r.query_id, r[name], round(r.score, 9), r["rank"]) for r in df.collect()}


def test_recall_and_exactness(spark, corpus, index):
    exact = rows(retrieval.search_all(corpus, asked(corpus), 15), "vec_id")
    near = rows(ann.search(spark, index, asked(corpus), 15, probes=6), "id")
    assert len({x[:2] for x in near} & {x[:2] for x in exact}) >= 0.95 * len(exact)
    assert {x[:3] for x in near if x[:2] in {e[:2] for e in exact}} <= {x[:3] for x in exact}  # scores are the exact ones
    loaded = ann.Index.load(spark, index.path)
    assert rows(ann.search(spark, loaded, asked(corpus), 15, probes=24, keep=4000), "id") == exact


def test_only_probed_lists_are_scanned(spark, corpus, index, capsys):
    one = asked(corpus).where("query_id = 100")
    ids, q = next(retrieval._blocks(one))
    whole = spark.read.parquet(f"{index.path}/lists")
    ann._candidates(whole, index, np.asarray(ids), q, 3, 10).explain("formatted")
    plan = capsys.readouterr().out
    lists = re.search(r"PartitionFilters: \[.*?list#\d+ IN \(([\d,]+)\)", plan) or re.search(r"PartitionFilters: \[(.*?)\]", plan)
    assert len(lists[1].split(",")) == 3 and "ReadSchema: struct<id:bigint,code:binary>" in plan
    assert len({r.list for r in spark.read.parquet(f"{index.path}/lists").select("list").distinct().collect()}) > 12


def test_every_vector_is_in_the_index_and_edge_cases(spark, corpus, index, tmp_path):
    assert spark.read.parquet(f"{index.path}/lists").count() == 3001
    none = ann.build(corpus.limit(0), str(tmp_path / "none"), 4)
    assert ann.search(spark, none, asked(corpus)).count() == 0
    few = ann.build(corpus.where("vec_id < 3"), str(tmp_path / "few"), 8)
    assert ann.search(spark, few, asked(corpus), 15).where("query_id = 0").count() == 3


def test_recall_of_many_vectors(spark, tmp_path):
    """Codes are fine enough that a hundred candidates hold the nearest ones in larger tables too."""
    from corpusflow.plans.retrieval_queries import vector_index_recall

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(40_000), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    row = vector_index_recall(spark, str(tmp_path)).first()
    assert (row.queries, row.enough) == (400, True)
