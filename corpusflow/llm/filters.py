"""Operator 13: how document filters interact, in any order they may be applied in.

Each document gets a mask of five bits, one for each filter that it fails (``FILTERS``), from built-in
expressions over its whole text. Filter E needs the other documents: the smallest id of each text comes
from a grouping by the text (its SHA-256), and a document fails E unless that id is its own. After that
no text is needed: a part is described by its mask histogram, 32 cells with the numbers of documents,
of good and of toxic ones, and what a filter removes after any others is a sum over cells:

* after the filters of a set S, those cells are left whose mask has no bit of S;
* over all orders, a filter removes a document with k failures first in 120 / k of them, which gives
  the sum over the orders (the Shapley value times 120) without going through them.

The groupings are summed before the shuffle, so neither a text, a part nor a label that a third of the
rows share meets in one task. The join that tells first copies from others is by id, not by text.

Edge cases: a null text is empty, and empty texts are copies of each other; null sources and empty ones
are one part; a row without an id is never a copy of a smaller one, and has no labels; repeated rows
count each, and fail E together or not at all; of several labels of one id, any good one makes it good
and any toxic one toxic; an empty table has no parts; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import saved

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Percentages: of distinct words at least, of capitals at most.
MIN_DISTINCT, MAX_CAPITALS = 65, 5
_SPACE = r"[\x20\x09-\x0D]+"
_SIGNS = "[#$%&*|]"


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    tests = (n < MIN_WORDS, 100 * distinct.cast("long") < MIN_DISTINCT * n.cast("long"), 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"), text.rlike(_SIGNS))
    return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the five failure bits of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = saved(docs.select("doc_id", part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask")), "masks")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the cells of each part that hold documents."""
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masked(docs).join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _steps() -> Column:
    """Every step of every order: the order, the step, its filter's bit and the bits of the filters before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append((f"'{''.join(FILTERS[i] for i in order)}'", step, 1 << k, before))
            before |= 1 << k
    names = "filter_order", "step", "bit", "before"
    columns = [F.expr(f"array({', '.join(str(row[i]) for row in rows)})").alias(name) for i, name in enumerate(names)]
    return F.explode(F.arrays_zip(*columns))


def audited(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from a histogram."""
    cell = F.struct("mask", "n", "good", "toxic", F.bit_count("mask").alias("bits"))
    rows = cells.groupBy("part").agg(F.collect_list(cell).alias("cells")).select("part", "cells", _steps().alias("at")).select("part", "cells", "at.*")
    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    bit, before = F.col("bit"), F.col("before")

    def total(name: str, test, weight=lambda c: F.lit(1)) -> Column:
        own = F.transform(F.filter("cells", test), lambda c: c[name] * weight(c))
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))

    removed = lambda c: has(c, bit) & ~has(c, before)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda c: ~has(c, before.bitwiseOR(bit))).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda c: has(c, bit) & has(c, before)).alias("redundant"),
        total("n", lambda c: c["mask"] == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", lambda c: has(c, bit), lambda c: (F.lit(120) / c["bits"]).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; see ``audited``."""
    return audited(histogram(docs, labels))
