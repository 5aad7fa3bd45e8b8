"""The lexical index against a plain count over all documents: exactness, early termination, edge cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import lexical

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=3):
    r = np.random.default_rng(seed)
    share = 1 / np.arange(1, len(WORDS) + 1)
    return [(i, " ".join(r.choice(WORDS, size=int(r.integers(1, 60)), p=share / share.sum()))) for i in range(n)]


def plain(docs, queries, k):
    """(query, id, score, rank), over all documents one by one."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    own = {}
    for i, t in docs:
        if i is not None and cut(t):
            own.setdefault(i, []).extend(cut(t))
    mean = sum(map(len, own.values())) / max(1, len(own))
    df = {}
    for ws in own.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    weight = {w: math.floor(1000 * math.log(1 + (len(own) - d + 0.5) / (d + 0.5)) + 0.5) for w, d in df.items()}
    out = set()
    for q, t in queries:
        scores = []
        for i, ws in own.items():
            found = [w for w in set(cut(t)) if w in ws]
            impact = lambda tf: math.floor(1000 * (2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))) + 0.5)  # noqa: B023, E731
            if found:
                scores.append((-sum(weight[w] * impact(ws.count(w)) for w in found), i))
        out |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def docs():
    return texts(1500) + [(2000, None), (2001, ""), (None, "w1 w2"), (2002, "W1, w1! ünd w59"), (2003, "w7 " * 30_000), (5, "w3 w4")] + [(3000 + i, "w1 w2 w40") for i in range(300)]


QUERIES = [(1, "w1 w2 w40"), (2, "W59 w58 w58"), (3, "nothing here"), (4, ""), (5, None), (6, "ünd"), (7, " ".join(WORDS)), (8, "w7")]


def found(spark, docs, queries, path, **more):
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("word", F.lit(1)).repartition(3), path)
    rows = lexical.search(spark, lexical.Index.load(spark, path), spark.createDataFrame(queries, "query_id long, query string"), **more).collect()
    assert index == lexical.Index.load(spark, path)
    return {(r.query_id, r.id, r.score, r["rank"]) for r in rows}


@pytest.mark.parametrize("slice_blocks", [512, 3])
def test_equals_plain(spark, docs, tmp_path, slice_blocks, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 64)
    assert found(spark, docs, QUERIES, str(tmp_path / "index"), k=15, slice_blocks=slice_blocks) == plain(docs, QUERIES, 15)


def test_ids_of_one_row_each(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 50)
    some = [d for n, d in enumerate(docs) if d[1] != "w3 w4"]
    assert found(spark, some, QUERIES, str(tmp_path / "index"), k=15, slice_blocks=4) == plain(some, QUERIES, 15)


def test_blocks_of_queries(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 2)
    assert found(spark, docs, QUERIES, str(tmp_path / "index"), k=4) == plain(docs, QUERIES, 4)


def test_empty(spark, tmp_path):
    assert found(spark, [], QUERIES, str(tmp_path / "a")) == set()
    assert found(spark, [(1, "w1")], [], str(tmp_path / "b")) == set()


def test_ends_early():
    """Blocks whose bound is below the k-th score aren't scored, with or without a known floor."""
    r = np.random.default_rng(5)
    block = np.repeat(np.arange(400), 2)
    ids = [np.arange(b * 100, b * 100 + 100) for b in block]
    impacts = [r.integers(0, 1000 if b % 40 == 0 else 500, 100) for b in block]
    tops = np.array([i.max() for i in impacts])
    names, scores, done = lexical.best(block, tops, ids, impacts, 10)
    score = np.zeros(40_000, np.int64)
    for i, x in zip(ids, impacts, strict=True):
        np.add.at(score, i, x)
    order = np.lexsort((np.arange(len(score)), -score))[:10]
    assert names.tolist() == order.tolist() and scores.tolist() == score[order].tolist()
    assert done < 40
    again = lexical.best(block, tops, ids, impacts, 10, floor=int(scores[-1]))
    assert again[0].tolist() == order.tolist() and again[2] <= done


def test_a_task_holds_the_lists_of_few_documents():
    """Lists of a slice lie in a worker's memory as a whole; 65,536 documents took over 600 MB there."""
    assert lexical.SLICE * lexical.BLOCK <= 1 << 14
