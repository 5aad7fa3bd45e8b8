"""Operator 11: a Jaccard join over word shingles that skips along set relations.

A document's set are its distinct shingles of three words; two documents link when 10 |x & y| >= 9 |x | y|. All links
are found, or made unnecessary, in these steps:

1. Shingles are ordered by frequency. The order comes from a sketch of all shingles of all documents, 2^20 counts whatever the
   corpus; any order gives the same links, and a better one only fewer meetings. Documents with equal sets are one node.
2. Index lists hold, for each shingle, the nodes in whose prefix it is, with its position: two sets that link share a
   shingle among the first |x| - ceil(0.9 |x|) + 1 of both. Shingles of one list entry only are dropped at once.
3. Stars: each entry is compared with the list's most central node, the one that has the shingle earliest for its size, and with
   its least one. This ties families of near copies together by as many comparisons as they have members. A member
   keeps its ``leader``, the partner it differs least from, with the differences: what it adds and what it lacks.
4. Index-level skipping: lists are cut into blocks by the component that is known so far, size and position. Blocks meet blocks, not
   entries entries: those of one component never, and others only if the sizes and positions in their headers leave room
   for a link (with |x| + |y| known, a shingle shared too late leaves too few to share). Only then members are looked at.
5. Answer-level skipping: the overlap of two leaders is computed once. A member's overlaps follow from it, as |u & v| differs by at
   most what u and v add or lack. This decides most pairs, either way; for the rest the exact overlap is derived from the
   leaders' by looking up the differences only (``derived``). Pairs between components that are linked already are dropped.

Members of one component aren't compared with each other, so the result is components, not all pairs. Nothing
is capped: a list that a third of the nodes share is many blocks, which the join on the shingle deals out.

Shingles are 64-bit hashes, and equal sets are told by a 128-bit hash. Edge cases: texts without words and null
texts have the empty set, which is linked with nothing; a text of one or two words has one shingle, the whole; rows without an id
have no component unless they hang together with others; rows that share an id are one document, with all links of its
texts; an empty table gives an empty result; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import filtered, lists, merged, saved, utf8
from corpusflow.llm.components import components
from corpusflow.llm.neardup import FEW, shingle_sets
from corpusflow.llm.simhash import NO_ID

WORDS = 3
#: A link: SHARE[1] * overlap >= SHARE[0] * union, or (SHARE[0] + SHARE[1]) * overlap >= SHARE[0] * (sum of the sizes).
SHARE = (9, 10)
SKETCH_BITS = 20
_SLICES = 16
#: Entries of a block, and pairs whose overlap is derived from one pair of leaders at a time.
BLOCK, TOGETHER = 256, 128
_ROWS = 1024


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, _ROWS) for batch in batches for at in range(0, batch.num_rows, _ROWS))


def sketch(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall into each of 2^20 classes of hashes.

    A task sends its counts in compressed slices, and each slice is summed where it is gathered: what comes to the
    driver is one array of fixed size.
    """
    width = (1 << SKETCH_BITS) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in _sliced(batches):
            own = [*shingle_sets(part.column(0).to_pylist(), WORDS)]
            total += np.bincount((np.concatenate(own) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        rows = [(k, zstandard.compress(x.tobytes(), 1)) for k, x in enumerate(total.reshape(_SLICES, width)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sums: dict[int, np.ndarray] = {}
        for part in _sliced(batches):
            for k, x in zip(part.column(0).to_pylist(), part.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    found = docs.select(utf8("text").alias("text")).mapInArrow(count, schema).repartition(_SLICES, "slice").mapInArrow(add, schema)
    out = np.zeros((_SLICES, width), np.int64)
    for r in found.toLocalIterator():
        out[r.slice] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.reshape(-1), np.iinfo(np.uint32).max).astype(np.uint32)


def prefix(n: int) -> int:
    """So many of a set's n shingles, in order, must be looked at: a partner lacks fewer."""
    return n - -(-SHARE[0] * n // SHARE[1]) + 1 if n else 0


def parities(own: np.ndarray) -> bytes:
    """For each residue of the hashes whether an odd number of them has it; about two hashes come to a bit.

    Two sets differ in as many shingles at least as their parities differ in bits, whatever the hashes.
    """
    width = 1 << max(6, (max(1, len(own)) - 1).bit_length() - 1)
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The number of bits in which two parities differ, the longer one folded to the other's length."""
    x, y = (int.from_bytes(p, "little") for p in sorted((a, b), key=len))
    for half in range((len(max(a, b, key=len)) // len(min(a, b, key=len))).bit_length() - 2, -1, -1):
        bits = (8 * len(min(a, b, key=len))) << half
        y = (y & ((1 << bits) - 1)) ^ (y >> bits)
    return (x ^ y).bit_count()


def prints(docs: DataFrame, frequency: np.ndarray) -> DataFrame:
    """(doc_id, copy, same, n, bits, tokens): ``copy`` stands for the text, ``same`` for the set of n shingles; its parities, and its prefix in the order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in _sliced(batches):
            same, sizes, bits, tokens = [], [], [], []
            for own in shingle_sets(part.column(2).to_pylist(), WORDS):
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                bits.append(parities(own))
                often = frequency[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                tokens.append(own[np.argsort(often, kind="stable")[: prefix(len(own))]].view(np.int64))
            columns = [part.column(0), part.column(1), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), _lists(tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "same", "n", "bits", "tokens"])

    return _texts(docs).mapInArrow(run, "doc_id long, copy long, same binary, n int, bits binary, tokens array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), utf8("text").alias("text"))


def _lists(values: list[np.ndarray]) -> pa.Array:
    return lists(pa.array(np.concatenate([np.zeros(0, np.int64), *values])), np.cumsum([0, *map(len, values)]))


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, same, n, bits, tokens), one for each set, and links (u, v) between sets of documents that share an id.

    A node's number is the smallest id of its documents; a set without one has a number above all ids.
    """
    own = F.xxhash64("same").bitwiseOR(F.lit(NO_ID)).bitwiseAND(F.lit((1 << 63) - 1))
    grouped = rows.where("n > 0").groupBy("same").agg(F.coalesce(F.min("doc_id"), own).alias("node"), *(F.first(c).alias(c) for c in ("n", "bits", "tokens")))
    nodes = saved(grouped, "jaccard-nodes")
    twice = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high")
    if twice.isEmpty():
        return nodes, nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    twice = saved(twice.select("doc_id"), "jaccard-shared-ids")
    first = nodes.join(merged(twice.withColumnRenamed("doc_id", "node")), "node", "left_semi").groupBy("node").agg(F.min("same").alias("holder"))
    apart = saved(nodes.join(merged(first), "node", "left").withColumn("node", F.when(F.col("holder") != F.col("same"), own).otherwise(F.col("node"))).drop("holder"), "jaccard-nodes")
    held = rows.join(merged(twice), "doc_id", "left_semi").select("doc_id", "same").distinct().join(merged(apart.select("same", "node")), "same")
    least = held.groupBy("doc_id").agg(F.min("node").alias("v"))
    return apart, held.join(merged(least), "doc_id").select(F.col("node").alias("u"), "v").where("u <> v")


def _room(a: str, b: str) -> Column:
    """Whether two entries of one list can link: their sizes fit, and neither has the shingle too late for the other's size."""
    low, high = SHARE
    n = lambda x: F.col(f"{x}.n").cast("long")
    late = lambda x, y: (low + high) * F.col(f"{x}.pos") <= high * n(x) - low * n(y)
    return (high * n(a) >= low * n(b)) & (high * n(b) >= low * n(a)) & late(a, b) & late(b, a)


def _linked(overlap: Column, sizes: Column) -> Column:
    return (SHARE[0] + SHARE[1]) * overlap >= SHARE[0] * sizes


def entries(nodes: DataFrame) -> DataFrame:
    """(token, node, n, pos, size) of all index lists with two entries or more; ``size`` is the list's."""
    rows = nodes.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    many = rows.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(many, "token").select("token", "node", "n", "pos", "size")


def stars(index: DataFrame) -> DataFrame:
    """Candidates (u, v): each entry u with the most central node of its list, and with the least one."""
    one = F.struct((F.col("pos") / F.col("n")).alias("place"), "node", "n", "pos")
    hubs = index.groupBy("token").agg(F.min(one).alias("central"), F.min(F.struct("node", "n", "pos")).alias("least"))
    part = lambda x: F.struct(f"{x}.node", f"{x}.n", f"{x}.pos")
    hubs = hubs.select("token", F.explode(F.array_distinct(F.array(part("central"), part("least")))).alias("b"))
    met = index.select("token", F.struct("node", "n", "pos").alias("a")).join(merged(hubs), "token").where((F.col("a.node") != F.col("b.node")) & _room("a", "b"))
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) that may link by their parities; nothing that links is lost, and little else is kept that isn't alike."""
    ends = [nodes.select(F.col("node").alias(s), F.struct("n", "bits").alias(f"cf_{s}")) for s in "uv"]
    rows = pairs.join(merged(ends[0]), "u").join(merged(ends[1]), "v")

    def make():
        def test(some: list) -> list[bool]:
            low, high = SHARE
            return [(low + high) * differing(p["cf_u"]["bits"], p["cf_v"]["bits"]) <= (high - low) * (p["cf_u"]["n"] + p["cf_v"]["n"]) for p in some]

        return test

    return filtered(rows, F.struct("cf_u", "cf_v"), make).drop("cf_u", "cf_v")


class Sets:
    """The sets of nodes, made again from their texts when they are asked for."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame):
        self.texts, self.nodes, self.rows = _texts(docs), nodes, rows

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in ``wanted``. A node's text is found by its id and a hash of it, and told by its set."""
        asked = self.nodes.join(merged(wanted.distinct()), "node", "left_semi").select("node", "same")
        one = F.min(F.struct("copy", "doc_id")).alias("one")
        holders = saved(self.rows.join(merged(asked), "same").groupBy("node", "same").agg(one).select("node", "same", F.col("one.copy").alias("c"), F.col("one.doc_id").alias("i")), "jaccard-wanted")
        few = holders.count() <= FEW
        texts = self.texts.join(F.broadcast(holders) if few else merged(holders), (F.col("copy") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("node", "same", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for part in _sliced(batches):
                sets = [*shingle_sets(part.column(2).to_pylist(), WORDS)]
                mine = [xxhash.xxh3_128_digest(x.tobytes()) == same for x, same in zip(sets, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(mine, pa.bool_())), _lists([x.view(np.int64) for x, own in zip(sets, mine) if own])], names=["node", "shingles"])

        sets = saved(texts.mapInArrow(run, "node long, shingles array<long>"), "jaccard-sets")
        if not sets.groupBy("node").count().where("count > 1").isEmpty():  # repeated rows
            sets = sets.dropDuplicates(["node"])
        return sets


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v, ...) with the sets x and y."""
    x, y = (sets.select(F.col("node").alias(node), F.col("shingles").alias(name)) for node, name in (("u", "x"), ("v", "y")))
    return pairs.join(merged(x), "u").join(merged(y), "v")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, both, adds, lacks): of linked pairs, what u has and v hasn't, and the other way."""
    rows = with_sets(pairs, sets).withColumn("both", F.size(F.array_intersect("x", "y")))
    linked = rows.where(_linked(F.col("both"), F.size("x") + F.size("y")))
    return linked.select("u", "v", "both", F.array_except("x", "y").alias("adds"), F.array_except("y", "x").alias("lacks"))


def blocks(index: DataFrame) -> DataFrame:
    """(token, part, low, high, first, nodes, sizes, places): index lists in blocks of one component, of like sizes and positions.

    The header has the least and the largest size and the earliest position. A long list has several blocks of a kind.
    """
    mixed = index.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("token")
    size_class = F.floor(F.log("n") / F.log(F.lit(SHARE[1] / SHARE[0])))
    place_class = F.floor(8 * F.col("pos") * SHARE[1] / ((SHARE[1] - SHARE[0]) * F.col("n")))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    rows = index.join(mixed, "token").withColumns({"size_class": size_class, "place_class": place_class, "salt": salt})
    one = F.collect_list(F.struct("node", "n", "pos"))
    held = rows.groupBy("token", "part", "size_class", "place_class", "salt").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("first"), one.alias("own"))
    return held.select("token", "part", "low", "high", "first", F.col("own.node").alias("nodes"), F.col("own.n").alias("sizes"), F.col("own.pos").alias("places"))


def across(index: DataFrame) -> DataFrame:
    """Candidates (u, v, pu, pv) in different components: blocks meet where their headers leave room, then their members."""
    held = blocks(index)
    low, high = SHARE
    n = lambda x: F.col(x).cast("long")
    skip = lambda x, y: (low + high) * F.col(f"{x}.first") > high * n(f"{x}.high") - low * n(f"{y}.low")
    fits = (high * n("a.high") >= low * n("b.low")) & (high * n("b.high") >= low * n("a.low"))
    met = held.alias("a").join(merged(held.alias("b")), (F.col("a.token") == F.col("b.token")) & (F.col("a.part") < F.col("b.part")) & fits & ~skip("a", "b") & ~skip("b", "a"))
    columns = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in "ab" for name in ("part", "nodes", "sizes", "places")]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            out = []
            for pu, us, ns, ps, pv, vs, ms, qs in zip(*(c if k % 4 == 0 else (x.values for x in c) for k, c in enumerate(part.columns))):
                n, p, m, q = (x.to_numpy().astype(np.int64)[:, None] if k < 2 else x.to_numpy().astype(np.int64) for k, x in enumerate((ns, ps, ms, qs)))
                room = (high * n >= low * m) & (high * m >= low * n) & ((low + high) * p <= high * n - low * m) & ((low + high) * q <= high * m - low * n)
                i, j = np.nonzero(room)
                out.append(np.stack([us.to_numpy()[i], vs.to_numpy()[j], np.full(len(i), pu.as_py()), np.full(len(i), pv.as_py())], axis=1))
            rows = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *out]), axis=0)  # two sets often share several shingles
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names=["u", "v", "pu", "pv"])

    return met.select(*columns).mapInArrow(members, "u long, v long, pu long, pv long").distinct()


def derived(both: int, u: tuple[np.ndarray, np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """The overlap of two sets from that of their leaders; each is (the leader's sorted set, what it adds, what it lacks)."""
    (x, adds, lacks), (y, more, less) = u, v

    def held(some: np.ndarray, whole: np.ndarray) -> np.ndarray:
        at = np.searchsorted(whole, some)
        return whole[np.minimum(at, len(whole) - 1)] == some if len(whole) else np.zeros(len(some), bool)

    in_u = lambda some: (held(some, x) & ~np.isin(some, lacks)) | np.isin(some, adds)
    own = both - held(lacks, y).sum() + held(adds, y).sum()  # u with v's leader
    return int(own - in_u(less).sum() + in_u(more).sum())


def settled(found: DataFrame, nodes: DataFrame, leaders: DataFrame, sets: Sets) -> DataFrame:
    """The links (pu, pv) between components that the candidates (u, v, pu, pv) give.

    ``leaders`` is (node, leader, adds, lacks) of the nodes that have one; others lead themselves.
    """
    sizes = nodes.select("node", "n")
    counts = leaders.select("node", "leader", F.size("adds").alias("more"), F.size("lacks").alias("less"))
    about = saved(sizes.join(merged(counts), "node", "left").select("node", "n", F.coalesce("leader", "node").alias("leader"), F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("less", F.lit(0)).alias("less")), "jaccard-about")
    side = lambda s: about.select(*(F.col(c).alias(f"{s}_{c}" if c != "node" else s) for c in about.columns))
    rows = saved(found.join(merged(side("u")), "u").join(merged(side("v")), "v"), "jaccard-candidates")
    led = rows.groupBy(F.col("u_leader").alias("u"), F.col("v_leader").alias("v")).agg(F.count("*").alias("pairs"))
    led = saved(led, "jaccard-led")
    held = sets.of(led.select(F.col("u").alias("node")).union(led.select("v")))
    known = saved(with_sets(led, held).select(F.col("u").alias("u_leader"), F.col("v").alias("v_leader"), "pairs", F.size(F.array_intersect("x", "y")).alias("both")), "jaccard-overlaps")
    total, least, most = F.col("u_n") + F.col("v_n"), F.col("both") - F.col("u_less") - F.col("v_less"), F.col("both") + F.col("u_more") + F.col("v_more")
    rows = saved(rows.join(merged(known), ["u_leader", "v_leader"]).withColumn("sure", _linked(least, total)).where(_linked(most, total)), "jaccard-open")
    sure = saved(rows.where("sure").select("pu", "pv").distinct(), "jaccard-sure")
    rest = rows.where("NOT sure").join(merged(sure), ["pu", "pv"], "left_anti")

    ends = leaders.select("node", "adds", "lacks")
    none = F.array().cast("array<long>")
    differ = lambda s: ends.select(F.col("node").alias(s), F.struct("adds", "lacks").alias(f"{s}_differs"))
    own = lambda s: F.coalesce(f"{s}_differs", F.struct(none.alias("adds"), none.alias("lacks")))
    pair = F.struct("pu", "pv", "both", "u_n", "v_n", own("u").alias("du"), own("v").alias("dv"))
    batch = F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("pairs") / TOGETHER)).alias("batch")
    asked = rest.join(merged(differ("u")), "u", "left").join(merged(differ("v")), "v", "left").select(F.col("u_leader").alias("u"), F.col("v_leader").alias("v"), batch, pair.alias("pair"))
    asked = asked.groupBy("u", "v", "batch").agg(F.collect_list("pair").alias("pairs"))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            out = set()
            for pairs, x, y in zip(*part.columns):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                for p in pairs.as_py():
                    du, dv = ([np.array(p[d][k], np.int64) for k in ("adds", "lacks")] for d in ("du", "dv"))
                    if (SHARE[0] + SHARE[1]) * derived(p["both"], (x, *du), (y, *dv)) >= SHARE[0] * (p["u_n"] + p["v_n"]):
                        out.add((p["pu"], p["pv"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["pu", "pv"])

    sorted_sets = held.withColumn("shingles", F.array_sort("shingles"))
    return sure.union(with_sets(asked, sorted_sets).select("pairs", "x", "y").mapInArrow(derive, "pu long, pv long")).distinct()


def near_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the component is the smallest id that links reach."""
    rows = saved(prints(docs, sketch(docs)), "jaccard-prints")
    nodes, shared = _numbered(rows)
    index = saved(entries(nodes), "jaccard-entries")
    sets = Sets(docs, rows, nodes)
    near = saved(possible(stars(index), nodes), "jaccard-stars")
    held = sets.of(near.select(F.col("u").alias("node")).union(near.select("v")))
    linked = saved(compared(near, held), "jaccard-linked")
    first = components(linked.select("u", "v").union(shared))
    least = F.min(F.struct(F.size("adds") + F.size("lacks"), "v", "adds", "lacks")).alias("one")
    leaders = saved(linked.groupBy(F.col("u").alias("node")).agg(least).select("node", F.col("one.v").alias("leader"), "one.adds", "one.lacks"), "jaccard-leaders")
    parts = saved(nodes.select("node").join(merged(first), "node", "left").select("node", F.coalesce("root", "node").alias("part")), "jaccard-parts")
    found = saved(possible(across(index.join(merged(parts), "node")), nodes), "jaccard-across")
    joined = components(settled(found, nodes, leaders, sets).toDF("u", "v"))
    roots = parts.join(merged(joined.withColumnRenamed("node", "part")), "part", "left").select("node", F.coalesce("root", "part").alias("root"))
    named = nodes.select("same", "node").join(merged(roots), "node").select("same", F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))
    return rows.join(merged(named), "same", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
