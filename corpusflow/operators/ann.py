"""Approximate vector search: an inverted-file index with product-quantised codes, re-ranked exactly.

``build`` trains ``lists`` centroids by rounds of Lloyd's algorithm over all vectors (each task sends sums for each centroid, so what
is gathered doesn't depend on the corpus) and writes every vector to the list of its nearest centroid: Parquet
partitioned by list, with a code of one byte for each of ``parts`` slices of what is left after the centroid is subtracted. The codes' tables of
256 entries a slice are fitted on at most ``CODE_SAMPLE`` vectors, those with the smallest hashes of their ids.

``search`` sends blocks of queries to the lists: partition pruning leaves only lists that some query probes, and only
ids and codes are read there. A task adds up table entries and keeps ``keep`` candidates a query; these few are read again, with their vectors, and
ranked by the exact cosine. More ``probes`` or candidates raise the recall; with all lists and enough candidates it is 1.

Edge cases: null vectors and ids are left out; vectors of length 0 have the score 0 and some list; an empty corpus gives an empty index and no
results; repeated ids are rows of their own. Ids are integers; all vectors have one width.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions.vector import cosine
from corpusflow.operators.retrieval import _blocks
from corpusflow.settings import DEFAULTS

CODE_SAMPLE = 16_384
_ROWS = 4096


def _units(column: pa.Array, rows: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre at the least distance from each row."""
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _lloyd(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        own = _near(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def centroids(vectors: DataFrame, lists: int, rounds: int = 6) -> np.ndarray:
    """[list, component], trained on all rows of (id, v); they begin as the vectors with the smallest hashes of their ids."""
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(lists).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0))
    centres = _units(first.column("v").combine_chunks(), first.num_rows)

    def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = _units(batch.column(1), batch.num_rows)
            own = _near(x, centres)
            np.add.at(total, own, x)
            counts += np.bincount(own, minlength=len(centres))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["list", "n", "v"])

    for _ in range(rounds):
        parts = vectors.mapInArrow(lambda b, c=centres: sums(b, c), "list int, n long, v array<double>")
        added = parts.select("list", "n", F.posexplode("v")).groupBy("list", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum"))
        means = added.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("sum") / F.col("n")).alias("x")))).alias("v")).select("list", "v.x")
        centres = centres.copy()
        for r in means.collect():  # a row for each list
            centres[r.list] = r.x
    return centres


@dataclass
class Index:
    """What a search needs beside the lists on disk: centroids and the codes' tables [slice, entry, component]."""

    path: str
    centres: np.ndarray
    tables: np.ndarray

    def save(self, spark: SparkSession) -> None:
        rows = [(json.dumps({"centres": self.centres.tolist(), "tables": self.tables.tolist()}),)]
        spark.createDataFrame(rows, "model string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        held = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        return cls(path, np.array(held["centres"]), np.array(held["tables"]))


def build(corpus: DataFrame, path: str, lists: int, parts: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Write the index of all vectors to ``path``; ``parts`` must divide their width."""
    rows = corpus.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    centres = centroids(rows, lists)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(CODE_SAMPLE).toArrow()
    tables = np.zeros((parts, 0, 0))
    if sample.num_rows:
        x = _units(sample.column("v").combine_chunks(), sample.num_rows)
        rest = (x - centres[_near(x, centres)]).reshape(len(x), parts, -1)
        tables = np.stack([_lloyd(rest[:, k], rest[:256, k], 8) for k in range(parts)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            x = _units(batch.column(1), batch.num_rows)
            own = _near(x, centres)
            rest = (x - centres[own]).reshape(len(x), parts, -1)
            codes = np.stack([_near(rest[:, k], tables[k]) for k in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own.astype(np.int32))], names=["id", "v", "code", "list"])

    rows.mapInArrow(encode, "id long, v array<double>, code binary, list int").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    index = Index(path, centres, tables)
    index.save(corpus.sparkSession)
    return index


def search(
    spark: SparkSession, index: Index, queries: DataFrame, k: int = DEFAULTS.retrieve, probes: int = 8, keep: int = 100, query_id: str = "query_id", query_vector: str = "query_vector"
) -> DataFrame:
    """(query_id, id, score, rank): about the k most similar vectors of each query, in order of the exact cosine."""
    whole = spark.read.schema("id long, v array<double>, code binary, list int").parquet(f"{index.path}/lists") if len(index.centres) else None
    asked = queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector)
    found = None
    for ids, q in _blocks(asked) if whole is not None else ():
        part = _candidates(whole, index, np.asarray(ids, np.int64), q, probes, keep)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    few = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).select("query_id", "id", "list").distinct()
    vectors = asked.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q"))
    exact = few.join(whole.select("list", "id", "v"), ["list", "id"]).join(vectors, "query_id").select("query_id", "id", cosine("q", "v").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _candidates(whole: DataFrame, index: Index, ids: np.ndarray, q: np.ndarray, probes: int, keep: int) -> DataFrame:
    """(query_id, id, list, near): from the lists that each query probes the rows whose codes promise most."""
    length = np.linalg.norm(q, axis=1, keepdims=True)
    q = q / np.where(length > 0, length, 1)
    centres, tables = index.centres, index.tables
    away = (centres * centres).sum(axis=1) - 2 * (q @ centres.T)
    probed = np.argsort(away, axis=1, kind="stable")[:, :probes]
    parts = len(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = np.einsum("qpd,ped->qpe", q.reshape(len(q), parts, -1), tables)  # [query, slice, entry]: products to add up
        asks = {c: np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
        for batch in batches:
            own, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for c in np.unique(lists):
                rows, who = np.flatnonzero(lists == c), asks.get(c, ())
                if not len(who):
                    continue
                near = np.repeat((q[who] @ centres[c])[:, None], len(rows), axis=1)
                for p in range(parts):
                    near += slices[who, p][:, codes[rows, p]]
                n = min(keep, len(rows))
                top = np.argsort(-near, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[who], n)), pa.array(own[rows][top].reshape(-1)), pa.array(np.full(top.size, c, np.int32)), pa.array(np.take_along_axis(near, top, axis=1).reshape(-1))],
                    names=["query_id", "id", "list", "near"],
                )

    wanted = whole.where(F.col("list").isin([int(c) for c in np.unique(probed)])).select("id", "code", "list")
    return wanted.mapInArrow(run, "query_id long, id long, list int, near double")
