"""Chunkers as folds over sentences and lines: column in, array of chunks out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.structure import CHUNK_SIZES, chunk_size, content_type
from corpusflow.functions.text import col, lines, once, search, strip
from corpusflow.settings import DEFAULTS

#: Fixed value: the characters that end a sentence.
SENTENCE_ENDS = ".؟!،"
#: What every chunk is made of.
CHUNK = "struct<text:string,content_type:string,chunking_strategy:string,chunk_index:int,total_chunks:int,chunk_size_used:int,section_index:int,section_header:string>"


#: Elements that a fold takes at once.
BLOCK = 256


def fold(values: Column, empty: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column], kind: str = "string") -> Column:
    """``aggregate`` for a state with a growing list ``out``, in time that grows with the number of values.

    Each appending copies the list, so the values are folded in blocks, each with a list of its own, and
    the lists are put together at the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def block(a: Column, own: Column) -> Column:
        return once(F.aggregate(own, a["state"], step), lambda r: F.struct(r.withField("out", none).alias("state"), F.array_append(a["outs"], r["out"]).alias("outs")))

    def blocks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(v, i, F.lit(BLOCK)))

    start = F.struct(empty.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
    return once(values, lambda v: F.aggregate(blocks(v), start, block, lambda a: F.flatten(F.array_append(a["outs"], last(a["state"])))))


def sentences(c: str | Column) -> Column:
    """One sign stands for all, as a split at a single character needs no regular expression."""
    one, *others = SENTENCE_ENDS
    out = col(c)
    for sign in others:
        out = F.replace(out, F.lit(sign), F.lit(one))
    return F.filter(F.transform(F.split(out, "\\" + one, -1), strip), lambda s: s != "")


def sentence_chunks(c: str | Column, size: int | Column = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk) -> Column:
    """Sentences put together while they fit; the next chunk starts with the tail of the last one.

    A chunk that is too short is not given out, but its tail is still carried over; a sentence is
    never split, so a chunk may be longer than ``size``.
    """
    size = F.lit(size) if isinstance(size, int) else size
    empty = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def given(a: Column) -> Column:
        return F.when(F.length(a["now"]) >= least, F.array_append(a["out"], strip(a["now"]))).otherwise(a["out"])

    def step(a: Column, s: Column) -> Column:
        tail = F.right(a["now"], F.lit(overlap)) if overlap > 0 else F.lit("")
        fits = F.length(a["now"]) + F.length(s) + 1 < size
        return F.when(fits, F.struct(F.concat(a["now"], s, F.lit(" ")).alias("now"), a["out"].alias("out"))).otherwise(
            F.struct(F.concat(tail, s, F.lit(" ")).alias("now"), given(a).alias("out"))
        )

    return fold(sentences(c), empty, step, given)


def row_chunks(c: str | Column, size: int | Column, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Lines put together up to ``size`` characters; a chunk of several lines gives its last one to the next."""
    size = F.lit(size) if isinstance(size, int) else size
    strings = F.array().cast("array<string>")
    empty = F.struct(strings.alias("now"), F.lit(0).alias("n"), strings.alias("out"))
    keep = lambda a: F.lit(overlap > 0) & (F.size(a["now"]) > 1)

    def step(a: Column, line: Column) -> Column:
        full = (a["n"] + F.length(line) > size) & (F.size(a["now"]) > 0)
        last = F.element_at(a["now"], F.when(F.size(a["now"]) > 0, -1).otherwise(F.lit(None)))
        return F.when(
            full,
            F.struct(
                F.when(keep(a), F.array(last, line)).otherwise(F.array(line)).alias("now"),
                (F.when(keep(a), F.length(last)).otherwise(0) + F.length(line)).alias("n"),
                F.array_append(a["out"], F.array_join(a["now"], "\n")).alias("out"),
            ),
        ).otherwise(F.struct(F.array_append(a["now"], line).alias("now"), (a["n"] + F.length(line)).alias("n"), a["out"].alias("out")))

    finish = lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["out"], F.array_join(a["now"], "\n"))).otherwise(a["out"])
    return fold(lines(c), empty, step, finish)


def _chunk(text: Column, kind: Column, **more: Column) -> Column:
    null = {"chunking_strategy": "string", "chunk_index": "int", "total_chunks": "int", "chunk_size_used": "int", "section_index": "int", "section_header": "string"}
    return F.struct(text.alias("text"), kind.alias("content_type"), *(more.get(k, F.lit(None)).cast(t).alias(k) for k, t in null.items()))


def plain_chunks(c: str | Column, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk) -> Column:
    """Sentence chunks with their number and their total."""
    found = sentence_chunks(c, size, overlap, least)
    return once(found, lambda a: F.transform(a, lambda x, i: _chunk(x, F.lit("text"), chunk_index=i, total_chunks=F.size(a))))


def dynamic_chunks(c: str | Column, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk, dynamic: bool = True) -> Column:
    """Sentence chunks of the size that suits the text's content type."""
    kind = content_type(c)

    def made(k: Column) -> Column:
        size = chunk_size(k, dynamic)
        return once(
            sentence_chunks(c, size, overlap, least),
            lambda a: F.transform(a, lambda x, i: _chunk(x, k, chunk_index=i, total_chunks=F.size(a), chunk_size_used=size)),
        )

    return once(kind, made)


def sections(c: str | Column, headers: str | Column) -> Column:
    """(header, content) of each section: the lines after a header; a header without any line makes none."""
    def cut(x: Column, heads: Column) -> Column:
        starts = F.array_sort(F.array_distinct(F.filter(heads, lambda i: (i >= 0) & (i < F.size(x)))))
        return _between(x, F.concat(F.array(F.lit(-1)), starts), lambda x, start: F.when(start >= 0, strip(F.get(x, start))).alias("header"), 1)

    return once(lines(c), lambda x: once(col(headers).cast("array<int>"), lambda heads: F.filter(cut(x, heads), lambda s: s["content"].isNotNull())))


def _between(x: Column, starts: Column, first: Callable[[Column, Column], Column], skip: int) -> Column:
    """For each start: what ``first`` makes of it, and the lines from there (``skip`` left out) up to the next start; null for no line."""

    def of(starts: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            n = F.coalesce(F.get(starts, i + 1), F.size(x)) - start - skip
            return F.struct(first(x, start), F.when(n > 0, F.array_join(F.slice(x, start + skip + 1, n), "\n")).alias("content"))

        return F.transform(starts, one)

    return once(starts, of)


def section_chunks(c: str | Column, headers: str | Column, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk, dynamic: bool = True) -> Column:
    """Chunks that never cross a header. They are numbered through, and know their section."""
    size = chunk_size(F.lit("text"), dynamic)

    def of(s: Column, i: Column) -> Column:
        return F.transform(
            sentence_chunks(s["content"], size, overlap, least),
            lambda x: _chunk(x, F.lit("text"), chunking_strategy=F.lit("section_aware"), section_index=i, section_header=s["header"]),
        )

    whole = F.flatten(F.transform(sections(c, headers), of))
    return F.transform(whole, lambda x, i: x.withField("chunk_index", i.cast("int")))


def regions(c: str | Column) -> Column:
    """(is_table, content): runs of table lines and of other lines."""
    def cut(x: Column, table: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(x) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(table, i) != F.get(table, i - 1)))
        return _between(x, starts, lambda x, start: F.get(table, start).alias("table"), 0)

    return once(lines(c), lambda x: once(F.transform(x, _table_line), lambda table: cut(x, table)))


def _table_line(line: Column) -> Column:
    of = lambda sign: F.length(line) - F.length(F.replace(line, F.lit(sign)))
    return (of("|") >= 2) | (of("\t") >= 2) | search(line, r"^[-─]{3,}")


def table_chunks(c: str | Column, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk, dynamic: bool = True) -> Column:
    """Tables in one chunk where they are small, else by rows; the text around them by sentences."""
    text_size, table_size = chunk_size(F.lit("text"), dynamic), chunk_size(F.lit("table"), dynamic)

    def of(s: Column) -> Column:
        whole = F.array(_chunk(s["content"], F.lit("table"), chunking_strategy=F.lit("table_preserved")))
        rows = F.transform(row_chunks(s["content"], table_size, overlap), lambda x: _chunk(x, F.lit("table"), chunk_size_used=table_size))
        text = F.transform(sentence_chunks(s["content"], text_size, overlap, least), lambda x: _chunk(x, F.lit("text"), chunk_size_used=text_size))
        return F.when(~s["table"], text).when(F.length(s["content"]) <= 2 * CHUNK_SIZES["table"], whole).otherwise(rows)

    def numbered(x: Column, i: Column) -> Column:
        return x.withField("chunk_index", F.when(x["chunking_strategy"] == "table_preserved", i.cast("int")))

    made = lambda r: F.when(F.exists(r, lambda s: s["table"]), F.transform(F.flatten(F.transform(r, of)), numbered)).otherwise(dynamic_chunks(c, overlap, least, dynamic))
    return once(regions(c), made)


def structured_chunks(c: str | Column, structure: str | Column, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk, dynamic: bool = True) -> Column:
    """By sections where there are headers, else around tables, else by content type."""
    s = col(structure)
    return (
        F.when(s["has_headers"], section_chunks(c, s["header_positions"], overlap, least, dynamic))
        .when(s["has_tables"], table_chunks(c, overlap, least, dynamic))
        .otherwise(dynamic_chunks(c, overlap, least, dynamic))
    )
