"""Lexical search by BM25: an inverted index with block maxima, searched with early termination.

``build`` makes blocks of ``BLOCK`` documents that lie together. A row of the index is a word's list in one block: ids,
impacts, and the largest impact. No list is longer than its block, however frequent the word is, and nothing but ids is shuffled. An impact is the part of the
score that depends on word and document, as an integer; the word's weight comes in at search time from a table of document frequencies,
so the index is built without a join on words. Where rows share an id, their words are counted by id before blocks are made.

``search`` reads the rows of the queries' words and gives each task some blocks. The sum of a block's largest impacts bounds the score
of every document in it; blocks are taken from the highest bound down, until the bound falls below the k-th best score. The k-th
scores of a first slice of the blocks, which can only be too low, are where all other slices begin. The result is exact: scores are integers, ties go to the smaller id.

The score of a document is the sum over the query's distinct words of ``weight * impact``, with
``weight = floor(1000 ln(1 + (n - df + 0.5) / (df + 0.5)) + 0.5)`` and
``impact = floor(1000 * 2.2 tf / (tf + 1.2 (0.25 + 0.75 len / mean len)) + 0.5)`` for the usual parameters.

Edge cases: rows without an id are left out; null and empty texts have no words and aren't documents; rows that share an id are one document;
queries without words that occur find nothing; an empty table gives an empty index. Ids are integers; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.retrieval import all_words, words
from corpusflow.settings import DEFAULTS
from corpusflow.shared import saved

#: Documents in a block.
BLOCK = 512
#: Blocks whose lists meet in one task.
SLICE = 32
#: So few words are looked for in the row groups of the files, which are sorted by word.
FEW = 10
LISTS = "block long, word string, ids array<long>, impacts array<int>, top int, n int"
#: Queries, and their distinct words, that are searched at once.
QUERIES = 4096
WORDS = 4096
#: Blocks that are scored together.
_STEP = 8
SCALE = 1000


@dataclass(frozen=True)
class Index:
    path: str
    documents: int
    mean: float
    blocks: int

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(LISTS).parquet(f"{self.path}/lists")

    def frequencies(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word string, df long").parquet(f"{self.path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(path, **json.loads(spark.read.text(f"{path}/about").first()[0]))


def _whole(x: Column) -> Column:
    return F.floor(SCALE * x + 0.5)


def _packer(k1: float, b: float, mean: float):
    """What each task of the build does: rows (id, words) to the lists of blocks of rows that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            size = np.diff(lists.offsets.to_numpy())
            n = np.int64(len(size))
            pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
            word, row = pair // n, pair % n
            impact = np.floor(SCALE * ((k1 + 1) * tf / (tf + k1 * ((1 - b) + b * size[row] / mean))) + 0.5).astype(np.int32)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            ends = pa.array(np.append(starts, len(word)), pa.int32())
            columns = [
                pa.array(np.full(len(starts), block)), coded.dictionary.take(pa.array(word[starts])), pa.ListArray.from_arrays(ends, batch.column(0).take(pa.array(row))),
                pa.ListArray.from_arrays(ends, pa.array(impact)), pa.array(np.maximum.reduceat(impact, starts)), pa.array(np.diff(ends.to_numpy())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "word", "ids", "impacts", "top", "n"])
            block += 1

    return run


def _merged(docs: DataFrame, k1: float, b: float) -> tuple[DataFrame, int, float]:
    """(lists, documents, mean length) where rows share ids: words are counted by id first, and blocks are dealt by a hash of the id."""
    own = Window.partitionBy("id")
    counts = docs.select("id", F.explode(all_words("text")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))
    counts = saved(counts.select("id", "word", "tf", F.sum("tf").over(own).alias("length"), (F.min("word").over(own) == F.col("word")).alias("first")), "lexical-counts")
    about = counts.agg(F.count_if("first").alias("n"), F.sum("tf").alias("total")).first()
    mean = (about.total or 0) / max(1, about.n)
    share = (k1 + 1) * F.col("tf") / (F.col("tf") + k1 * ((1 - b) + b * F.col("length") / F.lit(mean)))
    rows = counts.select(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-about.n // BLOCK)))).alias("block"), "word", "id", _whole(share).cast("int").alias("impact"))
    lists = rows.groupBy("block", "word").agg(F.sort_array(F.collect_list(F.struct("id", "impact"))).alias("l"), F.max("impact").alias("top"))
    return lists.select("block", "word", F.col("l.id").alias("ids"), F.col("l.impact").alias("impacts"), "top", F.size("l").alias("n")), about.n, mean


def build(docs: DataFrame, path: str, id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> Index:
    """Write the index of all documents to ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "text")
    if own.groupBy("id").count().where("count > 1").isEmpty():
        length = F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+")).cast("long")
        about = own.select(length.alias("length")).where("length > 0").agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
        n, mean = about.n, (about.total or 0) / max(1, about.n)
        lists = own.select("id", all_words("text").alias("words")).where(F.size("words") > 0).mapInArrow(_packer(k1, b, mean), LISTS)
    else:
        lists, n, mean = _merged(own, k1, b)
    lists.sortWithinPartitions("word").write.parquet(f"{path}/lists")
    made = {"documents": n, "mean": mean, "blocks": max(1, -(-n // BLOCK))}
    spark.read.schema(LISTS).parquet(f"{path}/lists").groupBy("word").agg(F.sum("n").alias("df")).write.parquet(f"{path}/words")
    spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.text(f"{path}/about")
    return Index(path, **made)


def _asked(queries: DataFrame) -> Iterator[dict[int, list[str]]]:
    """The query set in blocks of bounded size."""
    some: dict[int, list[str]] = {}
    seen: set[str] = set()
    for r in queries.select("query_id", words("query").alias("own")).where(F.size("own") > 0).toLocalIterator():
        if some and (len(some) >= QUERIES or len(seen) + len(r.own) > WORDS):
            yield some
            some, seen = {}, set()
        some[r.query_id] = r.own
        seen.update(r.own)
    if some:
        yield some


def best(block: np.ndarray, tops: np.ndarray, ids: list[np.ndarray], impacts: list[np.ndarray], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, blocks scored) of the k best documents of one query with a score of ``floor`` at least.

    The arguments are the rows of the query's words: block number, largest impact, ids and impacts, the latter two weighted.
    """
    found, where = np.unique(block, return_inverse=True)
    bound = np.bincount(where, tops, len(found)).astype(np.int64)
    turn = np.argsort(-bound, kind="stable")
    rows = np.argsort(where, kind="stable")
    ends = np.searchsorted(where[rows], np.arange(len(found) + 1))
    kept_ids, kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done = 0
    for at in range(0, len(turn), _STEP):
        now = [t for t in turn[at : at + _STEP].tolist() if bound[t] >= floor]
        if not now:
            break
        done += len(now)
        own = [r for t in now for r in rows[ends[t] : ends[t + 1]].tolist()]
        docs, place = np.unique(np.concatenate([ids[r] for r in own]), return_inverse=True)
        score = np.bincount(place, np.concatenate([impacts[r] for r in own]), len(docs)).astype(np.int64)
        kept_ids, kept = np.concatenate([kept_ids, docs]), np.concatenate([kept, score])
        order = np.lexsort((kept_ids, -kept))[:k]
        order = order[kept[order] >= floor]
        kept_ids, kept = kept_ids[order], kept[order]
        if len(kept) == k:
            floor = max(floor, int(kept[-1]))
    return kept_ids, kept, done


def _searcher(asked: dict[int, list[str]], weights: dict[str, int], k: int, floors: dict[int, int]):
    """What each task does with the lists of its blocks."""
    users: dict[str, list[int]] = {}
    for q, own in asked.items():
        for w in own:
            users.setdefault(w, []).append(q)

    def run(table: pa.Table) -> pa.Table:
        block, tops = table.column("block").to_numpy(), table.column("top").to_numpy().astype(np.int64)
        ids = [x.values.to_numpy() for x in table.column("ids")]
        impacts = [x.values.to_numpy().astype(np.int64) for x in table.column("impacts")]
        mine: dict[int, list[int]] = {}
        for row, w in enumerate(table.column("word").to_pylist()):
            impacts[row] = impacts[row] * weights[w]
            tops[row] *= weights[w]
            for q in users[w]:
                mine.setdefault(q, []).append(row)
        out = [(q, *best(block[own], tops[own], [ids[r] for r in own], [impacts[r] for r in own], k, floors.get(q, 0))[:2]) for q, own in mine.items()]
        names = np.repeat(np.array([q for q, _, _ in out], np.int64), [len(i) for _, i, _ in out])
        return pa.table({"query_id": names, "id": np.concatenate([i for _, i, _ in out]), "score": np.concatenate([s for _, _, s in out])})

    return run


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = DEFAULTS.retrieve, slice_blocks: int = SLICE) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query; ``queries`` is (query_id, query)."""
    kind = "query_id long, id long, score long"
    parts = []
    for asked in _asked(queries):
        known = spark.createDataFrame([(w,) for w in sorted({w for own in asked.values() for w in own})], "word string")
        seen = index.frequencies(spark).join(F.broadcast(known), "word")
        weight = _whole(F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weights = {r.word: r.weight for r in seen.select("word", weight.alias("weight")).collect()}
        lists = index.lists(spark).join(F.broadcast(known), "word", "left_semi")
        if len(weights) <= FEW:
            lists = lists.where(F.col("word").isin(list(weights)))
        slices = max(1, -(-index.blocks // slice_blocks))
        dealt = lists.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)))
        floors = {}
        if slices > 1:
            scored = dealt.where("slice = 0").groupBy("slice").applyInArrow(_searcher(asked, weights, k, {}), kind)
            floors = {r.query_id: r.floor for r in scored.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).collect()}
        parts.append(dealt.groupBy("slice").applyInArrow(_searcher(asked, weights, k, floors), kind))
    found = parts[0] if parts else spark.createDataFrame([], kind)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
