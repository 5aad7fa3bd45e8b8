"""Operator 5 at a similarity of 0.8: SimHash and multi-index hashing, verified on the shingles.

At a distance of 4 bits of 64 only very close copies link. Texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 differ in about 15 bits of 100, so this module takes 126 bits in two words,
cut into ``SEGMENTS`` segments of ``BITS`` bits, and three steps:

1. Index and search enumerate a small Hamming ball around each segment's value: all values that differ
   in at most ``RADIUS`` of the ``UNSURE`` bits whose majority is narrowest. Those are the bits in
   which near copies differ, so two balls meet, at a similarity of 0.8, in two segments of three, and
   in some of the six segments for 998 pairs in 1000 (``corpusflow.llm.recall`` measures it).
2. Of the pairs that meet, the complete distance is verified: ``DISTANCE`` bits at most, which is 3.5
   standard deviations above the mean at 0.8.
3. What is left is verified on the complete sets of shingles: a pair links if the exact Jaccard
   similarity is 4/5 or more, so no other document is lost.

Texts with equal sets are one node, however many they are; a node's number is the smallest id of its
texts, so components carry the smallest id that can be reached. Nodes are first tied to few others that
share a segment's value, and only pairs of different groups are formed after that.

A key near which far more nodes lie than chance gives (``CROWD``) tells little about them: whole families of
texts that are only somewhat alike lie around it. Nodes that hold such a key are crowded. Two crowded nodes
don't meet in the index but in their rarest shingles: of two sets with a similarity of 4/5 the rarest
fifths, in an order by frequency, have a shingle in common, so no link gets lost this way. Complete distance,
sizes, the places of the shared shingle and the parities of the sets (which never differ in more bits than
the sets do in shingles) are tested in the join, and then step 3 follows. Frequencies come from ``SLOTS``
counters; any order gives the same links, a good one gives few candidates.

With more than ``2 ** BITS`` nodes more of them share a segment's value by chance; ``BITS`` can then be
raised, at the cost of more segments. Members of a group that aren't linked directly may be less alike.

Edge cases are those of ``simhash``: null and empty texts are copies of each other, repeated rows are
copies, rows without an id have no component unless they hang together with others, an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import lists, merged, saved, utf8
from corpusflow.llm.components import components
from corpusflow.llm.simhash import NO_ID, SEED, WORDS, kept_rows

BITS = 21
SEGMENTS = 6
UNSURE = 6
RADIUS = 2
DISTANCE = 34
#: A key is crowded if, beyond four times what chance gives, more nodes than this hold it in their balls of radius 1.
CROWD = 8
#: Counters of shingles; a shingle's leading bits name its counter.
SLOTS = 1 << 20
#: Parities of a set's shingles.
PARITIES = 512
_ODD = [f"odd{k}" for k in range(PARITIES // 64)]
#: Shingles, and words, that are worked on at once.
_CHUNK = 1 << 14
_GROUP = 1 << 16
#: Up to so many wanted texts their ids (24 bytes each) are sent to where the texts lie; beyond, texts are shuffled.
FEW = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(values: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of the word hashes, in order."""
    out = _mix(values[0] + np.uint64(len(values)))
    for v in values[1:]:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + v)
    return out


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles (of the whole sequence, if it is shorter).

    Words are split at white space, A-Z in lower case; each distinct word of a group of texts is hashed
    once, and numpy puts the hashes of neighbours together.
    """
    import xxhash

    held: list[list[bytes]] = []

    def flush() -> Iterator[np.ndarray]:
        coded = pa.array([w for own in held for w in own], pa.binary()).dictionary_encode()
        table = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        flat = table[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
        n = len(flat) - words + 1
        whole = _fold([flat[k : k + n] for k in range(words)]) if n > 0 else np.zeros(0, np.uint64)
        at = 0
        for own in held:
            k = len(own)
            yield np.unique(whole[at : at + k - words + 1]) if k >= words else _fold([flat[at + j : at + j + 1] for j in range(k)]) if k else np.zeros(0, np.uint64)
            at += k

    size = 0
    for text in texts:
        held.append((text or b"").lower().split())
        size += len(held[-1])
        if size > _GROUP:
            yield from flush()
            held, size = [], 0
    yield from flush()


def bit_majorities(shingles: np.ndarray) -> np.ndarray:
    """For each of the 126 bits: how many hashes have it more than lack it."""
    total = np.zeros(128, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        both = np.stack([part, _mix(part + np.uint64(0x9E3779B97F4A7C15))], axis=1).view(np.uint8)
        total += np.unpackbits(both, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([total[: 3 * BITS], total[64 : 64 + 3 * BITS]]) * 2 - len(shingles)


def segments(majorities: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each segment, and its least certain bits: [text, segment] and [text, segment, UNSURE]."""
    cut = majorities.reshape(-1, SEGMENTS, BITS)
    values = ((cut > 0) << np.arange(BITS)).sum(axis=2)
    return values, np.argsort(np.abs(cut), axis=2, kind="stable")[:, :, :UNSURE].astype(np.uint8)


def ball(values: np.ndarray, unsure: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """All keys of each text: [text, key]; a key is a value near the segment's with the segment's number above it."""
    one = np.int64(1) << unsure.astype(np.int64)
    masks = [np.bitwise_or.reduce(one[:, :, list(c)], axis=2) if c else np.zeros(values.shape, np.int64) for k in range(radius + 1) for c in combinations(range(UNSURE), k)]
    named = values | (np.arange(SEGMENTS, dtype=np.int64) << BITS)
    return (named[:, :, None] ^ np.stack(masks, axis=2)).reshape(len(values), -1)


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, copy, same, n, fp, fp2, unsure): ``same`` stands for the set of n shingles, ``copy`` for the very text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in (whole.slice(at, 256) for whole in parts for at in range(0, whole.num_rows, 256)):
            same, sizes, found = [], [], []
            for own in shingle_sets(part.column(2).to_pylist(), words):
                same.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                found.append(bit_majorities(own))
            values, unsure = segments(np.array(found, np.int64).reshape(-1, SEGMENTS * BITS))
            low, high = ((values[:, h : h + 3] << (BITS * np.arange(3))).sum(axis=1) for h in (0, 3))
            near = [row.tobytes() for row in unsure.reshape(len(unsure), -1)]
            columns = [part.column(0), part.column(1), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(low), pa.array(high), pa.array(near, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "same", "n", "fp", "fp2", "unsure"])

    return _texts(docs).mapInArrow(run, "doc_id long, copy long, same long, n int, fp long, fp2 long, unsure binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), utf8("text").alias("text"))


def indexed(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, node, part, fp, fp2): each node under every value in the balls around its segments."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                node, group, fp, fp2 = (c.to_numpy() for c in some.columns[:4])
                values = np.stack([(w >> (BITS * k)) & ((1 << BITS) - 1) for w in (fp, fp2) for k in range(3)], axis=1)
                unsure = np.frombuffer(b"".join(some.column(4).to_pylist()), np.uint8).reshape(len(node), SEGMENTS, UNSURE)
                keys = ball(values, unsure, radius)
                each = keys.shape[1]
                columns = [pa.array(keys.reshape(-1).astype(np.int32)), *(pa.array(np.repeat(x, each)) for x in (node, group, fp, fp2))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "part", "fp", "fp2"])

    return nodes.select("node", "part", "fp", "fp2", "unsure").mapInArrow(run, "key int, node long, part long, fp long, fp2 long")


def _close() -> Column:
    return F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) + F.bit_count(F.col("a.fp2").bitwiseXOR(F.col("b.fp2"))) <= DISTANCE


def _sizes_fit() -> Column:
    """Sets at 4/5 have sizes at 4/5."""
    return (5 * F.col("a.n") >= 4 * F.col("b.n")) & (5 * F.col("b.n") >= 4 * F.col("a.n"))


def stars(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v): each node with the least, the largest and the longest one that share a segment's value.

    This ties most of a large group of near copies together by links in proportion to its size.
    """
    one = F.struct("node", "n", "fp", "fp2")
    rows = indexed(nodes.withColumn("part", F.col("node")), radius=0).select("key", "node").join(merged(nodes.select("node", one.alias("a"))), "node").select("key", "a")
    ends = rows.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max_by("a", F.struct("a.n", "a.node")).alias("rich"))
    hubs = ends.where("low.node <> high.node").select("key", F.explode(F.array_distinct(F.array("low", "high", "rich"))).alias("b"))
    met = rows.join(merged(hubs), "key").where((F.col("a.node") != F.col("b.node")) & _close() & _sizes_fit())
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def crowded(nodes: DataFrame) -> DataFrame:
    """The nodes one of whose keys is crowded; see ``CROWD``."""
    chance = nodes.count() * 7 / 2**BITS  # nodes that a key of these balls holds by chance
    full = saved(indexed(nodes, radius=1).groupBy("key").count().where(F.col("count") > CROWD + 4 * chance).select("key"), "near-full")
    return indexed(nodes).join(F.broadcast(full) if full.count() <= FEW else merged(full), "key", "left_semi").select("node").distinct()


def index_meetings(marked: DataFrame) -> DataFrame:
    """(u, v) for each key under which two nodes meet, not both of them ``many``: in different groups, within the complete distance.

    The join tests all 126 bits. Nodes meet by chance in numbers that grow with the square of the input; one word's
    bits, of which the key holds a third where it is of that word's segments, would let too many of them through.
    """
    some, many = indexed(marked.where("many is null")), indexed(marked.where("many"))
    fits = _close() & (F.col("a.part") != F.col("b.part"))
    ends = [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]
    within = some.alias("a").join(merged(some.alias("b")), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & fits)
    between = some.alias("a").join(many.alias("b"), (F.col("a.key") == F.col("b.key")) & fits)
    return within.select(*ends).union(between.select(*ends))


def pairs(nodes: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Candidates (u, v) in different groups of column ``part``, within the complete distance."""
    marked = saved(nodes.join(merged(crowded(nodes).withColumn("many", F.lit(True))), "node", "left"), "near-marked")
    met, one = index_meetings(marked).distinct(), F.struct("n")
    both = met.join(merged(nodes.select(F.col("node").alias("u"), one.alias("a"))), "u").join(merged(nodes.select(F.col("node").alias("v"), one.alias("b"))), "v")
    return both.where(_sizes_fit()).select("u", "v").union(rare_pairs(marked.where("many"), docs, words))


def _rarity(sets: DataFrame) -> np.ndarray:
    """For each counter a step of its logarithm, two to a doubling; 0 where it counted one place or none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for part in parts:
            values = part.column(0).flatten().to_numpy().view(np.uint64)
            np.add.at(counts, (values >> np.uint64(44)).astype(np.int64), 1)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["slot", "n"])

    summed = sets.select("shingles").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = summed.where("n > 1").select("slot", F.floor(2 * F.log2("n")).cast("byte").alias("step")).toArrow()
    out = np.zeros(SLOTS, np.int8)
    out[found.column("slot").to_numpy()] = found.column("step").to_numpy()
    return out


def rare(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shingle, node, part, fp, fp2, n, place, prev, odd): the rarest fifth of each set, and one more, but for shingles that occur once.

    ``place`` is the shingle's place in the set by frequency, then by hash; ``prev`` is the set's shingle in the row before, null in the first. ``odd`` has a bit for each hash modulo ``PARITIES``: 1 if
    an odd number of the set's shingles have it. Two sets differ in as many shingles at least as these bits differ.
    """
    steps = _rarity(sets)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            heads, places, prev, sizes, odd = [], [], [], [], []
            for own in part.column(4):
                values = own.values.to_numpy().view(np.uint64)
                step = steps[(values >> np.uint64(44)).astype(np.int64)]
                first = np.lexsort((values, step))[: len(values) - (4 * len(values) + 4) // 5 + 1]
                at = np.flatnonzero(step[first] > 0)
                heads.append(values[first[at]])
                places.append(at)
                prev.append(np.roll(heads[-1], 1))
                sizes.append(len(values))
                odd.append(np.packbits(np.bincount((values % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1 > 0).view(np.int64))
            each = np.fromiter(map(len, heads), np.int64, len(heads))
            columns = [pa.array(np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64))]
            columns += [pa.array(np.repeat(part.column(k).to_numpy(), each)) for k in range(4)]
            columns += [pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int32))]
            begins = np.zeros(each.sum(), bool)
            begins[(np.cumsum(each) - each)[each > 0]] = True
            columns.append(pa.array(np.concatenate([np.zeros(0, np.uint64), *prev]).view(np.int64), mask=begins))
            bits = np.repeat(np.array(odd, np.int64).reshape(-1, PARITIES // 64), each, axis=0)
            columns += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITIES // 64)]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "node", "part", "fp", "fp2", "n", "place", "prev", *_ODD])

    rows = nodes.select("node", "part", "fp", "fp2").join(merged(sets), "node").select("node", "part", "fp", "fp2", "shingles")
    return rows.mapInArrow(run, "shingle long, node long, part long, fp long, fp2 long, n int, place int, prev long, " + ", ".join(f"{c} long" for c in _ODD))


def rare_meetings(rows: DataFrame) -> DataFrame:
    """(u, v) for shingles of ``rare`` that two nodes in different groups share, where the pair may link.

    Most nodes that hold a shingle may be of one group; of a pair in different groups one node isn't of
    the shingle's largest group, so only such nodes search.

    A pair need only meet in the first shingle that both sets have: what they share is that one and, at most,
    what comes after it in either. Where the rows before hold one shingle in both sets, the pair has met there.
    """
    held = rows.groupBy("shingle", "part").agg(F.count("*").alias("k"))
    main = held.groupBy("shingle").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    told = rows.join(merged(main.select("shingle", "main")), "shingle").withColumn("lone", F.expr("part <> main")).drop("main")
    a, b = told.where("lone").alias("a"), told.alias("b")
    once = ~F.col("b.lone") | (F.col("a.node") < F.col("b.node"))
    first = F.coalesce(F.col("a.prev") != F.col("b.prev"), F.lit(True))
    room = F.least(F.expr("a.n - a.place"), F.expr("b.n - b.place"))
    fits = (F.col("a.part") != F.col("b.part")) & once & first & _sizes_fit() & _close() & (9 * room >= 4 * (F.col("a.n") + F.col("b.n")))
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in _ODD), F.lit(0))
    met = a.join(merged(b), (F.col("a.shingle") == F.col("b.shingle")) & fits & (9 * differ <= F.col("a.n") + F.col("b.n")))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))


def rare_pairs(nodes: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Candidates (u, v) in different groups that share one of the rarest shingles of both."""
    return rare_meetings(saved(rare(shingled(nodes, docs, words), nodes), "near-rare")).distinct()


def _lists(values: list[np.ndarray]) -> pa.Array:
    return lists(pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)), np.cumsum([0, *map(len, values)]))


def shingled(nodes: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) of each of ``nodes``, written as a table."""
    wanted = saved(nodes.select("node", F.col("one.copy").alias("c"), F.col("one.doc_id").alias("i")), "near-wanted")
    few = wanted.count() <= FEW
    texts = _texts(docs)
    texts = texts.join(F.broadcast(wanted) if few else merged(wanted), (texts["copy"] == wanted["c"]) & texts["doc_id"].eqNullSafe(wanted["i"])).select("node", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(at, 128) for whole in parts for at in range(0, whole.num_rows, 128)):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(list(shingle_sets(part.column(1).to_pylist(), words)))], names=["node", "shingles"])

    sets = saved(texts.mapInArrow(run, "node long, shingles array<long>"), "near-sets")
    return sets if sets.groupBy("node").count().where("count > 1").isEmpty() else sets.dropDuplicates(["node"])  # repeated rows


def verified(candidates: DataFrame, docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """The candidates (u, v) whose sets of shingles have a Jaccard similarity of 4/5 at least."""
    found = saved(candidates, "near-candidates")
    needed = found.select("u").union(found.select("v")).distinct().withColumnRenamed("u", "node")
    sets = shingled(nodes.join(merged(needed), "node", "left_semi"), docs, words)
    x, y = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return found.join(merged(x), "u").join(merged(y), "v").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component is the smallest id that can be reached."""
    rows = saved(prints(docs, words), "near-prints")
    alike = [F.first(c).alias(c) for c in ("n", "fp", "fp2", "unsure")]
    whole = rows.groupBy("same").agg(F.coalesce(F.min("doc_id"), F.col("same").bitwiseOR(F.lit(NO_ID)).bitwiseAND(F.lit((1 << 63) - 1))).alias("node"), F.min(F.struct("copy", "doc_id")).alias("one"), *alike)
    nodes = saved(whole, "near-nodes")
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():  # an id that several texts share: one node
        return _with_shared_ids(rows, nodes, docs, words)
    return _named(rows, nodes.select("same", "node"), _roots(nodes, docs, words))


def _roots(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, root) of every node."""
    first = components(verified(stars(nodes), docs, nodes, words))
    parts = saved(nodes.join(merged(first), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "near-parts")
    across = verified(pairs(parts, docs, words), docs, nodes, words)
    ends = parts.select("node", "part")
    linked = across.join(merged(ends.toDF("u", "pu")), "u").join(merged(ends.toDF("v", "pv")), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
    second = components(linked).withColumnRenamed("node", "part")
    return ends.join(merged(second), "part", "left").select("node", F.coalesce("root", "part").alias("root"))


def _named(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    known = nodes.join(merged(roots), "node").select("same", F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))
    print_ = F.concat(*(F.lower(F.lpad(F.hex(p), 16, "0")) for p in ("fp", "fp2")))
    return rows.join(merged(known), "same").select("doc_id", print_.alias("fingerprint"), "component_id")


def _with_shared_ids(rows: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """As ``near_duplicates``, where different texts have one id: nodes get numbers of their own, named by ids at the end."""
    own = saved(nodes.select("same", F.col("node").alias("least"), F.col("same").alias("node"), "one", "n", "fp", "fp2", "unsure"), "near-own")
    roots = saved(_roots(own, docs, words), "near-roots")
    named = saved(own.join(merged(roots), "node").groupBy("root").agg(F.min("least").alias("name")), "near-names")
    return _named(rows, own.select("same", "node"), roots.join(merged(named), "root").select("node", F.col("name").alias("root")))


def representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The document with the smallest id of each group, with all its columns; see ``simhash.kept_rows``."""
    return kept_rows(docs, lambda named: near_duplicates(named, words))
