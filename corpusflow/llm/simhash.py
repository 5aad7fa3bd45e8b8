"""Operator 5: near-duplicates by SimHash and multi-index hashing.

Each text becomes a 64-bit fingerprint. Two fingerprints link when at most ``DISTANCE`` bits differ.
The fingerprint is cut into two halves. A pair at a distance of 4 differs in the first one by at most two bits, or else in
the second by at most one, so no pair is missed by the balls of radius 2 around the first half's value and of radius 1 around the
second's. A ball of radius 2 has 529 values; instead of enumerating them, the index holds each fingerprint under the 33 values of
a ball of radius 1, and the search enumerates another ball of radius 1, fetches what the index holds there and verifies the complete
distance in the join itself. Each row carries the bits that it has flipped, so that two fingerprints meet once and not
under every value between them (``balls``). Halves of 32 bits meet by chance a hundred times less than thirds.

Exact copies have equal fingerprints and count as one node, however many they are. Fingerprints that
already hang together through the least one that shares a segment's value with them aren't paired again, so
a group of thousands of near copies gives links in proportion to its size. Components then come from
rounds of joins. Nothing is collected.

Edge cases: null and empty texts have the fingerprint zero and link like any other; a null id counts
as no id (a group of such rows only has a null component); repeated rows are copies; an empty table
gives an empty result; other columns are kept by ``representatives`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import map_columns, merged, saved, utf8
from corpusflow.llm.components import components

WORDS = 5
SEED = 42
DISTANCE = 4
#: Segments that nodes of one group are first tied together by, at equal values.
SEGMENTS = 3
#: A node without an id has a number from here on.
NO_ID = 1 << 62
_CHUNK = 1 << 17


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is set if it is set in over half the hashes of the word shingles, repeats included."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    n, total = len(w) - k + 1, np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        parts = zip(*(w[i + start : i + stop] for i in range(k)), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), np.uint64, stop - start)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        def run(ids: list, texts: list) -> list[list]:
            return [ids, np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)]

        return run

    return map_columns(docs.select(id_col, utf8(text_col)), make, "doc_id long, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment."""
    ends = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _key(fp: Column, number: int, first: int, width: int) -> Column:
    """The segment's value, with the segment's number in the highest bits."""
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(number << 58))


def index(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(key, fp, ...): each fingerprint under the value of each of its segments."""
    keys = [_key(F.col("fp"), i, a, n) for i, (a, n) in enumerate(_segments(segments))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), *fps.columns)


def radii(distance: int) -> list[tuple[int, int]]:
    """For each half how many bits the search flips at most, and how many the index."""
    whole = (distance // 2, distance - distance // 2 - 1)  # more bits in the first half than whole[0] leave whole[1] in the second at most
    return [(r - r // 2, r // 2) for r in whole if r >= 0]


def balls(fps: DataFrame, distance: int = DISTANCE, search: bool = True) -> DataFrame:
    """(key, bit, fp, ...): each fingerprint under every value within the radius around each of its halves.

    Two halves that differ in the bits D meet under several values, of which one counts: the index flips nothing if the search can
    flip all of D, and else the search flips as many bits as it can, all above those that the index flips. So ``bit`` is, for the
    search, the lowest bit that it flips, if it flips as many as it can, and for the index the highest that it flips; else it is -1.
    A meeting counts if the index's is -1 or lower than the search's.
    """
    flips = []
    for i, ((a, n), (out, own)) in enumerate(zip(_segments(2), radii(distance))):
        for size in range((out if search else own) + 1):
            for bits in combinations(range(n), size):
                mark = (min(bits) if size and size == out else -1) if search else max(bits, default=-1)
                flips.append((_key(F.col("fp"), i, a, n).bitwiseXOR(F.lit(sum(1 << b for b in bits))), mark))
    return fps.select(F.explode(F.array(*(F.struct(key.alias("key"), F.lit(mark).alias("bit")) for key, mark in flips))).alias("at"), *fps.columns).select("at.*", *fps.columns)


def near(a: str, b: str, distance: int = DISTANCE) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) with u < v: links between the groups of column ``part``, one row for each pair of groups.

    ``fps`` has (fp, part); pairs inside a group are known to hang together and don't leave the join. A
    search that would meet its own group only is dropped before it.
    """
    probe = balls(fps, distance).select("key", "bit", F.col("fp").alias("a"), F.col("part").alias("pa"))
    held = balls(fps, distance, search=False).select("key", F.col("bit").alias("own"), F.col("fp").alias("b"), F.col("part").alias("pb"))
    ends = held.groupBy("key").agg(F.min("pb").alias("low"), F.max("pb").alias("high"))
    probe = probe.join(merged(ends), "key").where((F.col("low") != F.col("pa")) | (F.col("high") != F.col("pa"))).select("key", "bit", "a", "pa")
    once = (F.col("own") < 0) | (F.col("own") < F.col("bit"))
    found = probe.join(merged(held), (probe["key"] == held["key"]) & once & (F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & near("a", "b", distance))
    return found.select(F.least("pa", "pb").alias("u"), F.greatest("pa", "pb").alias("v")).distinct()


def stars(fps: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """(u, v): each node with the one of the least fingerprint that shares a segment's value, where they are near."""
    rows = index(fps.select("fp", "node"), segments)
    least = rows.groupBy("key").agg(F.min(F.struct("fp", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", F.col("hub.fp").alias("b"), F.col("hub.node").alias("v"))
    return rows.join(merged(least), "key").where((F.col("fp") != F.col("b")) & near("fp", "b", distance)).select(F.col("node").alias("u"), "v").distinct()


def roots(fps: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of distinct fingerprints (fp, node): the root is the least node that can be reached."""
    first = components(stars(fps, segments, distance))
    parts = saved(fps.join(merged(first), "node", "left").select("fp", F.coalesce("root", "node").alias("part")), "parts")
    second = components(links(parts, distance))
    return parts.join(merged(second.withColumnRenamed("node", "part")), "part", "left").select("fp", F.coalesce("root", "part").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, segments: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component is the smallest id that can be reached.

    A node of the graph is a fingerprint. Its number is the smallest id of its documents, so the roots of
    the components are the result. Where several fingerprints share their smallest id (repeated ids), links
    of that number to itself join them, as the same id is the same document.
    """
    rows = saved(fingerprints(docs, words), "fingerprints")
    own = F.col("fp").bitwiseOR(F.lit(NO_ID)).bitwiseAND(F.lit((1 << 63) - 1))
    fps = saved(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), own).alias("node")), "nodes")
    known = roots(fps, segments, distance).select("fp", F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))
    return rows.join(merged(known), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The document with the smallest id of each group, with all its columns."""
    return kept_rows(docs, lambda named: near_duplicates(named, words))


def kept_rows(docs: DataFrame, marked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of ``docs`` for each component that ``marked`` finds.

    Rows that share an id are one document, of which the row with the smallest hash stays. Rows without
    an id get one from their hash, beyond all ids below 2 to the power of 61, so a document with an id
    stays before one without. The text is shuffled once, by the id.
    """
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    own = F.col("cf_tie").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))
    rows = docs.withColumn("cf_tie", tie).withColumn("cf_id", F.coalesce(F.col("doc_id").cast("long"), own))
    marks = marked(rows.select(F.col("cf_id").alias("doc_id"), "text"))
    kept = marks.where("doc_id = component_id").select(F.col("doc_id").alias("cf_id")).distinct()
    first = Window.partitionBy("cf_id").orderBy("cf_tie")
    out = rows.join(merged(kept), "cf_id", "left_semi").withColumn("cf_place", F.row_number().over(first)).where("cf_place = 1")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
