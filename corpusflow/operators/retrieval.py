"""Search: exact top-k by vectors for one query or for a set of queries, and by shared words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.vector import cosine, mapped_similarity
from corpusflow.settings import DEFAULTS

#: Query vectors that are sent to all executors at once; more queries are searched in several blocks.
BLOCK_BYTES = 32 << 20
#: Rows and queries that are compared at once (1 MB of scores), and results that leave a task together.
_ROWS, _QUERIES, _SENT = 1024, 128, 1 << 16
#: Groups of queries, and of rows, into which ``search_grid`` deals a table that needn't be cut finer.
_SIDE = 8
_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
#: Scores that differ by less are equal: a product's last bits depend on where a row lies.
_TIE = 1e-12


def search(corpus: DataFrame, vector: list[float] | Column, k: int = DEFAULTS.retrieve, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar rows to one vector, with their ``score``: a partial top-k in each task."""
    q = vector if isinstance(vector, Column) else F.array(*(F.lit(float(x)) for x in vector))
    return corpus.withColumn("score", cosine(vector_col, q)).orderBy(F.desc("score"), id_col).limit(k)


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """The query set in blocks of bounded size, at length 1."""
    ids, rows, room = [], [], BLOCK_BYTES
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(np.asarray(r[1], np.float64))
        room -= 8 * len(rows[-1])
        if room < 0:
            yield ids, np.vstack(rows)
            ids, rows, room = [], [], BLOCK_BYTES
    if ids:
        yield ids, np.vstack(rows)


def search_all(
    corpus: DataFrame, queries: DataFrame, k: int = DEFAULTS.retrieve, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector"
) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows of each query.

    A block of queries goes to the corpus, which is read where it lies: some rows and queries at a time are one matrix
    product, and a task keeps and passes on k rows a query, so what is shuffled is a small multiple of the
    result, whatever the corpus. Ties go to the smaller id.
    """
    parts = [_nearest(corpus, ids, q, k, id_col, vector_col) for ids, q in _blocks(queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector))]
    if not parts:
        parts = [_nearest(corpus.limit(0), [], np.zeros((0, 1)), k, id_col, vector_col)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return _ranked(found, k, id_col, query_id)


def search_grid(
    corpus: DataFrame, queries: DataFrame, k: int = DEFAULTS.retrieve, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector"
) -> DataFrame:
    """What ``search_all`` gives, for query sets as large as the corpus: no vector passes the driver.

    Queries and corpus are dealt into groups by their ids, and each pair of groups is a cell, which passes on k rows a query.
    A vector goes to as many cells as the other side has groups. Every pair is compared, so the time grows with the product of both sizes.
    """
    asked, held = _given(queries, query_id, query_vector), _given(corpus, id_col, vector_col)
    (down, across) = map(_groups, (asked, held))
    dealt = lambda groups: F.pmod(F.xxhash64("id"), F.lit(groups))
    cells = lambda rows, r, c: rows.select("id", "vector", r.alias("r"), c.alias("c")).select("id", "vector", (F.col("r") * across + F.col("c")).alias("cell")).repartition(4 * down * across, "cell")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, q = _rows(left.combine_chunks())
        best = _Best(_unit(q), k)
        for batch in right.to_batches(_ROWS):
            best.add(*_rows(batch))
        return pa.Table.from_batches(best.found(names), _FOUND)

    one, other = cells(asked, dealt(down), every(across)), cells(held, every(down), dealt(across))
    found = one.groupBy("cell").cogroup(other.groupBy("cell")).applyInArrow(run, "query_id long, id long, score double")
    return _ranked(found, k, id_col, query_id)


def _given(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))


def _groups(rows: DataFrame) -> int:
    """Into how many groups rows are dealt: a group's vectors stay near ``BLOCK_BYTES``, and small tables are spread as well."""
    n, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    return max(1, -(-n * 8 * (size or 1) // BLOCK_BYTES), min(_SIDE, -(-n // (2 * _ROWS))))


def _ranked(found: DataFrame, k: int, id_col: str, query_id: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumnRenamed("id", id_col).withColumnRenamed("query_id", query_id)


def _rows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch's first two columns."""
    own, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns[:2])
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return own.to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


class _Best:
    """The k most similar rows of each query (at length 1) among those that were added."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.score, self.ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def add(self, own: np.ndarray, x: np.ndarray) -> None:
        """Some rows are compared with all queries; only scores that may be among a query's k best leave the product."""
        x, k = _unit(x), self.k
        for some in (slice(at, at + _QUERIES) for at in range(0, len(self.q), _QUERIES)):
            score = self.q[some] @ x.T
            near = score >= self.score[some, -1:] - _TIE
            number = near.sum(axis=1)
            enters = np.flatnonzero(number)
            if not len(enters):
                continue
            number = number[enters]
            r, c = np.nonzero(near[enters])
            place = np.arange(len(r)) - np.repeat(np.cumsum(number) - number, number)
            row = enters + some.start
            all_scores, all_ids = np.full((len(row), k + number.max()), -np.inf), np.full((len(row), k + number.max()), np.iinfo(np.int64).max)
            all_scores[:, :k], all_ids[:, :k] = self.score[row], self.ids[row]
            all_scores[r, k + place], all_ids[r, k + place] = score[enters[r], c], own[c]
            least = np.partition(all_scores, -k, axis=1)[:, -k]  # what the k-th best has: all that reach it are sorted
            most = max(k, int((all_scores >= least[:, None] - _TIE).sum(axis=1).max()))
            first = np.argpartition(-all_scores, min(most, all_scores.shape[1]) - 1, axis=1)[:, :most]
            all_scores, all_ids = np.take_along_axis(all_scores, first, axis=1), np.take_along_axis(all_ids, first, axis=1)
            order = np.lexsort((all_ids, -np.round(all_scores, 12)), axis=1)[:, :k]
            self.score[row], self.ids[row] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)

    def found(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        query, place = np.nonzero(self.score > -np.inf)
        for at in range(0, len(query), _SENT):
            r, c = query[at : at + _SENT], place[at : at + _SENT]
            yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(self.ids[r, c]), pa.array(self.score[r, c])], schema=_FOUND)


def _nearest(corpus: DataFrame, ids: list, q: np.ndarray, k: int, id_col: str, vector_col: str) -> DataFrame:
    q, names = _unit(q), np.asarray(ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(q, k)
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            best.add(*_rows(batch))
        yield from best.found(names)

    return _given(corpus, id_col, vector_col).mapInArrow(run, "query_id long, id long, score double")


def all_words(text: str | Column) -> Column:
    """The words of a text, in lower case: runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def words(text: str | Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(all_words(text))


def _word_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
    """The query set's words in blocks whose matrix of queries and words has a bounded size."""
    ids, rows, seen = [], [], set()
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        seen.update(r[1])
        if 4 * len(ids) * len(seen) > BLOCK_BYTES or len(seen) > 1 << 16:
            yield np.asarray(ids, np.int64), rows
            ids, rows, seen = [], [], set()
    if ids:
        yield np.asarray(ids, np.int64), rows


def search_words(docs: DataFrame, queries: DataFrame, k: int = DEFAULTS.retrieve, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank): the k documents that share most of a query's distinct words.

    The words of a block of queries go to the documents, which are read where they lie. A group of documents is an inverted list for
    each word that some query has: two matrices of zeros and ones, whose product counts the shared words. A task keeps k rows a query
    and passes over the documents whose best score can't enter them, so what is shuffled is a small multiple of the result, however
    frequent a word is. ``queries`` is (query_id, query); ids are integers; ties go to the smaller id.
    """
    own = queries.select("query_id", words("query").alias("own")).where(F.size("own") > 0)
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), words("text").alias("words"))
    parts = [held.mapInArrow(_word_counter(ids, rows, k), "query_id long, id long, score double") for ids, rows in _word_blocks(own)]
    if not parts:
        parts = [held.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def _word_counter(ids: np.ndarray, rows: list[list[str]], k: int):
    """What each task does: the k best documents of each query of a block."""
    vocabulary = sorted({w for own in rows for w in own})
    place = {w: n for n, w in enumerate(vocabulary)}
    asked = np.zeros((len(ids), len(vocabulary)), np.float32)
    for n, own in enumerate(rows):
        asked[n, [place[w] for w in own]] = 1
    sizes = asked.sum(axis=1).astype(np.float64)
    step = max(1, min(512, (1 << 22) // max(1, len(vocabulary))))  # documents at once: 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        known = pa.array(vocabulary, pa.string())
        best_counts = np.zeros((len(ids), k), np.float32)  # 0: no document yet, as one without shared words is none
        best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            lists, own = batch.column(1), batch.column(0).to_numpy()
            word = pc.index_in(lists.flatten(), value_set=known)
            doc = np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))[pc.is_valid(word).to_numpy(zero_copy_only=False)]
            held = np.zeros((len(own), len(vocabulary)), np.float32)
            held[doc, word.drop_null().to_numpy()] = 1
            counts = asked @ held.T
            enters = np.flatnonzero(((counts >= best_counts[:, -1:]) & (counts > 0)).any(axis=0))
            if not len(enters):
                continue
            counts, own = counts[:, enters], own[enters]
            all_counts = np.concatenate([best_counts, counts], axis=1)
            all_ids = np.concatenate([best_ids, np.broadcast_to(own, counts.shape)], axis=1)
            all_ids = np.where(all_counts > 0, all_ids, np.iinfo(np.int64).max)
            order = np.lexsort((all_ids, -all_counts), axis=1)[:, :k]
            best_counts, best_ids = np.take_along_axis(all_counts, order, axis=1), np.take_along_axis(all_ids, order, axis=1)
        q, n = np.nonzero(best_counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_ids[q, n]), pa.array(best_counts[q, n].astype(np.float64) / sizes[q])], names=["query_id", "id", "score"])

    return run


def pair_similarities(candidates: DataFrame, group: str = "query_id", place: str = "retrieval_rank", vector: str = "embedding") -> DataFrame:
    """(group, i, j, similarity) of all candidates of a query, i before j. Candidates are few: the top k."""
    a = candidates.select(group, F.col(place).alias("i"), F.col(vector).alias("_a"))
    b = candidates.select(F.col(group).alias("_g"), F.col(place).alias("j"), F.col(vector).alias("_b"))
    pairs = a.join(b, (a[group] == b["_g"]) & (F.col("i") < F.col("j")))
    return pairs.select(group, "i", "j", mapped_similarity(cosine("_a", "_b")).alias("similarity"))
