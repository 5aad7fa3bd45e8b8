"""Operator 12: hard negatives by a vantage-point tree over norm-augmented vectors.

The largest inner product isn't the least distance, but it becomes one when each vector x gets another
component, sqrt(M - |x|^2) with M the largest squared norm, and an anchor q gets a zero there and the length
sqrt(M): with c = sqrt(M) / |q|, |q' - x'|^2 = 2 M - 2 c q.x. A window of scores is an annulus around the anchor, and the
higher scores lie nearer. All points lie on one sphere, where vantage points tell most. Distances obey the triangle inequality, so a vantage point's distances bound the scores of whole groups:

1. The upper tree is fitted on at most ``SAMPLE`` rows (those whose id's hash is small; 8 MB at most). It deals
   all rows into cells, each with the annulus around every vantage point on its path that holds its rows.
2. The rows of a cell are packed in blocks of about ``BLOCK`` rows, so a cell that holds a third of all rows
   is many blocks. Each block holds a vantage-point tree of its own with leaves of ``LEAF`` rows.
3. An anchor goes to the cells that its annulus meets, and there its leaves are taken nearest first, inside the annulus,
   until the next leaf can't hold a better row than the k that it has. ``search_block`` does that for hundreds of anchors together.
4. A window keeps the best k of what the blocks return.

The sample's rows are rows of the table, so the k-th best of them is a bound that prunes from the start. The first
round finds each anchor's positives, the second the negatives within the windows that the positives' scores
give. Scores are sums of products of integers, exact in double precision while squared norms stay below 2^53 (beyond,
they are computed as 64-bit integers); bounds have a slack for rounding, and nothing is left out.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows that share an
id the one with the least label, then the least vector, takes part; shorter vectors count as padded with zeros;
equal scores go by the id; an anchor without positives or a window without rows gives no row; an empty
table gives an empty result; other columns are ignored. Ids are integers; scores beyond 64 bits aren't defined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import saved

SAMPLE = 4096
SAMPLE_BYTES = 8 << 20
#: Rows of a cell that are aimed at, cells at most, rows of a block, of a leaf, and anchors that are searched together.
CELL, CELLS, BLOCK, LEAF, GROUP = 4096, 256, 8192, 64, 512
#: Slack of a distance, in lengths of the longest vector: far above what rounding does to the root of a difference.
_SLACK = 1e-6
_NONE = np.iinfo(np.int64).min
_ALL = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) with integer components, floor(256 x), one row for each id."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    fine &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(256 * c)).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.label", "one.v")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of 64-bit integers; shorter lists are padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """All inner products as 64-bit integers; ``exact`` says that double precision holds them."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


@dataclass
class Space:
    """The width of the vectors and the largest squared norm."""

    width: int
    most: float

    @property
    def exact(self) -> bool:
        return self.most < 2**53

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all of them equally long."""
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def flat(self, q: np.ndarray) -> np.ndarray:
        """Anchors at the common length, with a zero in that place."""
        return np.concatenate([q * self.stretch(q), np.zeros((len(q), 1))], axis=1)

    def stretch(self, q: np.ndarray) -> np.ndarray:
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))[:, None]
        return np.sqrt(self.most) / np.where(length > 0, length, np.inf)

    def scores_at(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the least score that rows between two distances from each anchor can have."""
        slack, by = _SLACK * np.sqrt(self.most), self.stretch(q)
        by = np.where(by > 0, by, np.inf)  # an anchor of length 0 has the score 0 with all rows
        top = (2 * self.most - np.maximum(near - slack, 0) ** 2) / 2 / by + 1
        return top, (2 * self.most - np.minimum(far + slack, 3 * np.sqrt(self.most)) ** 2) / 2 / by - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Tree:
    """A vantage-point tree of complete levels: its vantage points, and for each leaf and level the annulus that holds its rows."""

    points: np.ndarray
    radii: np.ndarray
    depth: int

    @classmethod
    def grown(cls, x: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
        """The tree over the rows of ``x``, halved at the median of the distances, and each row's leaf."""
        points, radii = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
        groups = {0: np.arange(len(x))}
        for node in range(2**depth - 1):
            own = groups.pop(node)
            if len(own):
                points[node] = x[own[np.argmax(distances(x[own], x[own[:1]])[:, 0])]]  # far from another: a point at the edge
                d = distances(x[own], points[node : node + 1])[:, 0]
                by = np.argsort(d, kind="stable")
                half = (len(own) + 1) // 2
                radii[node] = d[by[half - 1]]
                groups[2 * node + 1], groups[2 * node + 2] = own[by[:half]], own[by[half:]]
            else:
                groups[2 * node + 1] = groups[2 * node + 2] = own
        leaves = np.zeros(len(x), np.int32)
        for node, own in groups.items():
            leaves[own] = node - (2**depth - 1)
        return cls(points, radii, depth), leaves

    def path(self, leaves: np.ndarray) -> np.ndarray:
        """[leaf, level]: the nodes above each leaf, the root first."""
        node, out = leaves + (2**self.depth - 1), []
        for _ in range(self.depth):
            node = (node - 1) // 2
            out.append(node)
        return np.stack(out[::-1], axis=1) if out else np.zeros((len(leaves), 0), int)

    def dealt(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances from the vantage points on the way."""
        d, node, levels = distances(x, self.points), np.zeros(len(x), int), []
        for _ in range(self.depth):
            own = d[np.arange(len(x)), node]
            levels.append(own)
            node = np.where(own <= self.radii[node], 2 * node + 1, 2 * node + 2)
        return (node - (2**self.depth - 1)).astype(np.int32), np.stack(levels, axis=1) if levels else np.zeros((len(x), 0))

    def reach(self, q: np.ndarray, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[anchor, leaf]: the least and the largest distance that a leaf's rows can have, from its annuli [leaf, level]."""
        near, far = np.zeros((len(q), len(leaves))), np.full((len(q), len(leaves)), np.inf)
        d, path = distances(q, self.points), self.path(leaves)
        for level in range(self.depth):
            own = d[:, path[:, level]]
            near = np.maximum(near, np.maximum(own - high[:, level], low[:, level] - own))
            far = np.minimum(far, own + high[:, level])
        return near, far


@dataclass
class Queries:
    """Anchors that are searched together: ids, labels, vectors, and for each of their windows the scores from ``low`` to ``high``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def at(self, rows: np.ndarray) -> Queries:
        return Queries(self.ids[rows], self.labels[rows], self.vectors[rows], self.low[rows], self.high[rows])

    def fitting(self, ids: np.ndarray, labels: np.ndarray, same: bool) -> np.ndarray:
        """[anchor, row]: rows of the anchor's label other than itself, or of different labels."""
        alike = self.labels[:, None] == labels
        return alike & (self.ids[:, None] != ids) if same else ~alike


def best(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (anchor, window, score, id) the k best of each window, in order."""
    found = found[np.lexsort((found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return found[np.arange(len(found)) - start < k]


def hits(queries: Queries, floor: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (anchor, window, score, id) within the windows, from ``floor`` up; ``rows`` are the anchors' numbers."""
    for w in range(floor.shape[1]):
        a, b = np.nonzero(fits & (scores >= floor[:, w, None]) & (scores <= queries.high[:, w, None]))
        yield np.stack([rows[a], np.full(len(a), w), scores[a, b], ids[b]], axis=1)


def raised_floor(floor: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """The windows' lower ends, or the k-th best score where k rows are known."""
    floor = floor.copy()
    if len(found) >= k:
        full = (found[k - 1 :, :2] == found[: len(found) - k + 1, :2]).all(axis=1)
        a, w, score = found[k - 1 :][full][:, :3].T
        np.maximum.at(floor, (a, w), score)
    return floor


@dataclass
class Block:
    """Up to some thousand rows in the order of the leaves of their tree."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tree: Tree
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def made(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, space: Space) -> Block:
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        x = space.raised(vectors)
        tree, leaves = Tree.grown(x, depth)
        order = np.argsort(leaves, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(leaves, minlength=2**depth))])
        low, high = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
        d = distances(x, tree.points) if depth else np.zeros((len(x), 0))
        path = tree.path(leaves)
        for level in range(depth):
            own = d[np.arange(len(x)), path[:, level]]
            np.minimum.at(low[:, level], leaves, own)
            np.maximum.at(high[:, level], leaves, own)
        return cls(ids[order], labels[order], vectors[order], tree, ends, low, high)


def search_block(block: Block, queries: Queries, space: Space, k: int, same: bool) -> np.ndarray:
    """Rows (anchor's number, window, score, id): the k best of the block in each window.

    Each anchor takes its leaves nearest first, some at a time, and stops when the next one's scores lie below
    the k-th best that it has in every window. The leaves of one round are multiplied with all anchors that take them.
    """
    n_leaves = len(block.ends) - 1
    near, far = block.tree.reach(space.flat(queries.vectors), np.arange(n_leaves), block.low, block.high)
    top, bottom = space.scores_at(queries.vectors, near, far)
    order = np.argsort(-top, axis=1, kind="stable")
    floor, found = queries.low.copy(), np.zeros((0, 4), np.int64)
    live, start, step = np.arange(len(queries.ids)), 0, 2
    while start < n_leaves and len(live):
        taken = order[live, start : start + step]
        own_top, own_bottom = (np.take_along_axis(x[live], taken, axis=1) for x in (top, bottom))
        meets = ((own_top[:, :, None] >= floor[live][:, None, :]) & (own_bottom[:, :, None] <= queries.high[live][:, None, :])).any(axis=2)
        who, which = np.nonzero(meets)
        leaf, who = taken[who, which], live[who]
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by])) + 1
        new = [found]
        for part in np.split(by, cuts) if len(by) else []:
            rows, at = who[part], slice(block.ends[leaf[part[0]]], block.ends[leaf[part[0]] + 1])
            some = queries.at(rows)
            scores = products(some.vectors, block.vectors[at], space.exact)
            new += hits(some, floor[rows], scores, some.fitting(block.ids[at], block.labels[at], same), block.ids[at], rows)
        found = best(np.concatenate(new), k)
        floor = raised_floor(floor, found, k)
        start, step = start + step, 2 * step
        if start < n_leaves:
            live = live[(top[live, order[live, start]][:, None] >= floor[live]).any(axis=1)]
    return found


class Index:
    """All usable rows in packed blocks below the shared folder, with the upper tree (bounded) on the driver."""

    def __init__(self, rows: DataFrame):
        self.rows = saved(rows, "negatives-rows")
        squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        n, width, most = self.rows.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
        self.n, self.space = n, Space(int(width or 0), float(most or 0))
        sample = min(SAMPLE, max(64, SAMPLE_BYTES // (8 * max(1, self.space.width))))
        small = F.xxhash64("id") < int(-(2.0**63) + min(1.0, sample / max(1, n)) * (2.0**64 - 4096))
        held = self.rows.where(small).limit(2 * sample).toArrow() if n else None
        self.sample_ids, self.sample_labels = ((held.column(c).combine_chunks().to_numpy() for c in ("id", "label")) if held else (np.zeros(0, np.int64),) * 2)
        self.sample = matrix(held.column("v").combine_chunks(), self.space.width) if held else np.zeros((0, self.space.width), np.int64)
        depth = min(int(np.log2(CELLS)), max(0, int(np.ceil(np.log2(max(1, n) / CELL)))))
        self.tree = Tree.grown(self.space.raised(self.sample), depth)[0]
        self._pack()

    def _pack(self) -> None:
        tree, space = self.tree, self.space
        levels = tree.depth

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, d = tree.dealt(space.raised(matrix(batch.column(2), space.width)))
                ways = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * levels, pa.int32()), pa.array(d.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), ways], names=["id", "label", "v", "cell", "way"])

        dealt = saved(self.rows.mapInArrow(deal, "id long, label long, v array<long>, cell int, way array<double>"), "negatives-dealt")
        ends = [f(F.get("way", F.lit(i))).alias(f"{name}{i}") for i in range(levels) for name, f in (("low", F.min), ("high", F.max))]
        cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), *ends)
        known = sorted(cells.collect())  # CELLS rows at most
        self.cells = np.array([r.cell for r in known], int)
        self.low, self.high = (np.array([[r[f"{name}{i}"] for i in range(levels)] for r in known], float).reshape(len(known), levels) for name in ("low", "high"))
        parts = cells.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
        salted = dealt.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int").alias("part"), "id", "label", "v")

        def pack(group: pa.Table) -> pa.Table:
            ids, labels = (group.column(c).combine_chunks().to_numpy() for c in ("id", "label"))
            b = Block.made(ids, labels, matrix(group.column("v").combine_chunks(), space.width), space)
            packed = [b.ids, b.labels, b.vectors, b.tree.points, b.tree.radii, b.ends, b.low, b.high]
            return pa.table({"cell": group.column("cell").slice(0, 1), "block": pa.array([_packed(packed)], pa.binary())})

        self.blocks = saved(salted.groupBy("cell", "part").applyInArrow(pack, "cell int, block binary"), "negatives-blocks")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(id, window, score, other, rank): for each window of the anchors the k best rows, of the anchor's label or of others.

        ``anchors`` is (id, label, v, low, high): the windows are arrays of least and largest scores.
        """
        tree, space, cells, low, high = self.tree, self.space, self.cells, self.low, self.high
        ids, labels, sample = self.sample_ids, self.sample_labels, self.sample
        groups = max(1, -(-anchors.count() // GROUP))
        schema = "id long, label long, v array<long>, low array<long>, high array<long>, cell int"

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(at, GROUP) for whole in batches for at in range(0, whole.num_rows, GROUP)):
                q = _queries(batch.columns, space.width)
                every = np.arange(len(q.ids))
                scores = products(q.vectors, sample, space.exact)
                known = best(np.concatenate([np.zeros((0, 4), np.int64), *hits(q, q.low, scores, q.fitting(ids, labels, same), ids, every)]), k)
                floor = raised_floor(q.low, known, k)
                near, far = tree.reach(space.flat(q.vectors), cells, low, high)
                top, bottom = space.scores_at(q.vectors, near, far)
                meets = ((top[:, :, None] >= floor[:, None, :]) & (bottom[:, :, None] <= q.high[:, None, :])).any(axis=2)
                a, c = np.nonzero(meets)
                rows = batch.take(pa.array(a))
                offsets = rows.column(3).offsets
                held = np.arange(floor.shape[1]) < np.diff(offsets.to_numpy())[:, None]
                lows = pa.ListArray.from_arrays(offsets, pa.array(floor[a][held]))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], lows, rows.column(4), pa.array(cells[c].astype(np.int32))], names=["id", "label", "v", "low", "high", "cell"])

        routed = anchors.select("id", "label", "v", "low", "high").mapInArrow(route, schema)
        routed = routed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int"))

        def pack(group: pa.Table) -> pa.Table:
            q = _queries([group.column(c).combine_chunks() for c in ("id", "label", "v", "low", "high")], space.width)
            return pa.table({"cell": group.column("cell").slice(0, 1), "asked": pa.array([_packed([q.ids, q.labels, q.vectors, q.low, q.high])], pa.binary())})

        asked = saved(routed.groupBy("cell", "part").applyInArrow(pack, "cell int, asked binary"), "negatives-asked")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, some in zip(batch.column(0), batch.column(1)):
                    i, l, v, points, radii, ends, lows, highs = _unpacked(block.as_py())
                    q = Queries(*_unpacked(some.as_py()))
                    found = search_block(Block(i, l, v, Tree(points, radii, lows.shape[1]), ends, lows, highs), q, space, k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[found[:, 0]]), *(pa.array(found[:, c]) for c in (1, 2, 3))], names=["id", "window", "score", "other"])

        met = asked.join(self.blocks, "cell").select("block", "asked").mapInArrow(look, "id long, window long, score long, other long")
        order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "other")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _queries(columns: list, width: int) -> Queries:
    ids, labels, v, low, high = columns
    sizes = np.diff(low.offsets.to_numpy())
    most = int(sizes.max(initial=0))
    held = np.arange(most) < sizes[:, None]
    ends = []
    for column, rest in ((low, _ALL), (high, _NONE)):  # a window that an anchor lacks is empty
        x = np.full((len(sizes), most), rest, np.int64)
        x[held] = column.flatten().to_numpy(zero_copy_only=False)
        ends.append(x)
    return Queries(ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), matrix(v, width), *ends)


def _packed(arrays: list[np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    for x in arrays:
        np.save(out, x, allow_pickle=False)
    return out.getvalue()


def _unpacked(data: bytes) -> list[np.ndarray]:
    import io

    file, out = io.BytesIO(data), []
    while file.tell() < len(data):
        out.append(np.load(file, allow_pickle=False))
    return out


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, k: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``anchor_every`` divides; an anchor's positives are its best rows of the same label. For
    each, the best ``k`` rows of other labels whose score is ``least`` to ``most`` per cent of the positive's.
    ``vectors`` is (vec_id, label, embedding).
    """
    index = Index(usable(vectors))
    anchors = index.rows.where(F.col("id") % anchor_every == 0)
    whole = anchors.withColumns({"low": F.array(F.lit(_NONE)), "high": F.array(F.lit(_ALL))})
    pairs = saved(index.search(whole, positives, same=True).select("id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    score = F.col("positive_score")
    # the smallest and the largest integers within the shares, by integer division: -floor(-least * s / 100) and floor(most * s / 100)
    low, high = -_floor_share(score, -least), _floor_share(score, most)
    one = F.struct("positive_id", "positive_score", low.alias("low"), high.alias("high"))
    windows = pairs.where(low <= high).groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("w"))  # ``positives`` entries at most
    asked = anchors.join(windows, "id").select("id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = index.search(asked, k, same=False).join(windows, "id").withColumn("own", F.get("w", F.col("window").cast("int")))
    return found.select(
        F.col("id").alias("anchor_id"), F.col("own.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), F.col("own.positive_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _floor_share(score, share: int):
    """floor(share * score / 100) in integers."""
    return F.floor((score.cast("decimal(38,0)") * share) / F.lit(100).cast("decimal(3,0)")).cast("long")
