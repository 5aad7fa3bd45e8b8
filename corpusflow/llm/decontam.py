"""Operator 10: benchmark decontamination with one Aho-Corasick automaton.

The items of the benchmark are normalised (A-Z in lower case, words of letters and digits) and cut
into windows of ``WINDOW`` consecutive words; one automaton holds all windows. Every document is
normalised in the same way and scanned once, whatever the number of windows; a match is mapped to the
words, and to the characters of the original text, that it covers.

The benchmark is a table of test items and doesn't grow with the corpus. It is read item by item in
parts of at most ``PART_BYTES`` of text; a part's windows are broadcast, and each task makes one automaton
of them. A benchmark of one part is one narrow pass. A larger one is scanned part after part: each
pass writes what it has found before the next part is read, so no more than one part is ever
held, and the hits of all parts are united by document.

Edge cases: null texts have no words; items without words have no window; items with fewer words than
a window are one window; repeated items and item ids count once; a null item id is left out; an empty
benchmark hits nothing; an empty table gives an empty result; other columns are kept by
``clean_documents`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import filtered, map_columns, saved, utf8

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes some 300 bytes for each.
PART_BYTES = 1 << 20

#: Bytes that aren't part of a word, after lower-casing.
_GAPS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes(0x20 if b in _GAPS else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_NORMAL).split()


def windows(items: list[tuple], window: int = WINDOW) -> dict[bytes, tuple[int, list]]:
    """Each window's text, with the number of its words and the ids of the items that have it."""
    out: dict[bytes, tuple[int, dict]] = {}
    for item_id, text in items:
        w = words_of(text or b"")
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            out.setdefault(b" ".join(part), (len(part), {}))[1][item_id] = None
    return {text: (n, list(ids)) for text, (n, ids) in out.items()}


class Scanner:
    """The automaton, and how a text's matches map to its words and characters."""

    def __init__(self, found: dict[bytes, tuple[int, list]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, (n, ids) in found.items():
            key = f" {text.decode('latin-1')} "  # one character a byte
            self.automaton.add_word(key, (len(key), n, ids))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, words: list[bytes]) -> list[tuple[int, int, list]]:
        """(first word, number of words, item ids) of each occurrence of a window."""
        if self.empty or not words:
            return []
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        hits = list(self.automaton.iter(text))
        if not hits:
            return []
        gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(gaps, [end - size + 1 for end, (size, _, _) in hits])
        return [(int(i), n, ids) for i, (_, (_, n, ids)) in zip(first, hits, strict=True)]


def covered(matches: list[tuple[int, int, list]], n_words: int) -> np.ndarray:
    """Which words are inside any match."""
    edge = np.zeros(n_words + 1, np.int64)
    for i, n, _ in matches:
        edge[i] += 1
        edge[i + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def spans(scanner: Scanner, text: str) -> Iterator[tuple[int, int, list]]:
    """(start, end, item ids): the characters of the original text that each match covers."""
    data = text.encode()
    found = scanner.matches(words_of(data))
    if found:
        places = [(m.start(), m.end()) for m in _WORD.finditer(data.lower())]
        for i, n, ids in found:
            start = len(data[: places[i][0]].decode())
            yield start, start + len(data[places[i][0] : places[i + n - 1][1]].decode()), ids


def parts_of(benchmark: DataFrame, size: int = PART_BYTES) -> Iterator[list[tuple]]:
    """The items, in parts of at most ``size`` bytes (an item that is larger is a part); one part at least."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", utf8("text").alias("text")).distinct()
    part, room = [], size
    for item_id, text in items.toLocalIterator():
        text = bytes(text)
        if len(text) > room and part:
            yield part
            part, room = [], size
        part.append((item_id, text))
        room -= len(text)
    yield part


def _split(benchmark: DataFrame, size: int) -> tuple[list[tuple], Iterator[list[tuple]]]:
    """The first part, and the others one at a time."""
    parts = parts_of(benchmark, size)
    return next(parts), parts


def _scanner(docs: DataFrame, part: list[tuple], window: int) -> Callable[[], Scanner]:
    """Makes a part's automaton in a task."""
    sent = docs.sparkSession.sparkContext.broadcast(windows(part, window))
    return lambda: Scanner(sent.value)


def _hits(docs: DataFrame, part: list[tuple], window: int, key: str) -> DataFrame:
    """(key, n_words, n_hit, starts, sizes, item_ids): one pass with one automaton."""
    make_scanner, kind = _scanner(docs, part, window), docs.schema[key].dataType.simpleString()

    def make():
        scanner = make_scanner()

        def run(ids: list, texts: list) -> list[list]:
            n_words, n_hit, starts, sizes, items = [], [], [], [], []
            for text in texts:
                words = words_of(text or b"")
                found = scanner.matches(words)
                n_words.append(len(words))
                n_hit.append(int(covered(found, len(words)).sum()) if found else 0)
                starts.append([i for i, _, _ in found])
                sizes.append([n for _, n, _ in found])
                items.append(sorted({str(i) for _, _, own in found for i in own}))
            return [ids, n_words, n_hit, starts, sizes, items]

        return run

    return map_columns(docs.select(key, utf8("text")), make, f"`{key}` {kind}, n_words long, n_hit long, starts array<long>, sizes array<long>, item_ids array<string>")


def hit_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): what each document shares with the benchmark."""
    first, rest = _split(benchmark, part_bytes)
    second = next(rest, None)
    if second is None:
        return _hits(docs, first, window, "doc_id").drop("starts", "sizes")
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "benchmark-rows")  # written, so a row keeps its number
    known = saved(_hits(rows, first, window, "row"), "benchmark-hits")
    found = known.where("n_hit > 0")
    for part in chain([second], rest):
        found = found.unionByName(saved(_hits(rows, part, window, "row").where("n_hit > 0"), "benchmark-hits"))
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "sizes", "item_ids")]  # of one text: bounded by it and the number of parts
    whole = found.groupBy("row", "n_words").agg(*flat)

    def make():
        def run(keys: list, sizes: list, starts: list, lengths: list, items: list) -> list[list]:
            counts = [int(covered([(i, n, []) for i, n in zip(a, b, strict=True)], w).sum()) for w, a, b in zip(sizes, starts, lengths, strict=True)]
            return [keys, counts, [sorted(set(own)) for own in items]]

        return run

    united = map_columns(whole, make, "row long, n_hit long, item_ids array<string>")
    return rows.select("row", "doc_id").join(known.select("row", "n_words"), "row").join(united, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, start, end, item_ids): a row for each match, in characters of the original text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(part: list[tuple]) -> DataFrame:
        make_scanner = _scanner(docs, part, window)

        def make():
            scanner = make_scanner()

            def run(ids: list, texts: list) -> list[list]:
                rows = [(i, a, b, [str(x) for x in own]) for i, t in zip(ids, texts, strict=True) for a, b, own in spans(scanner, t or "")]
                return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

            return run

        return map_columns(docs.select("doc_id", "text"), make, f"doc_id {kind}, start long, end long, item_ids array<string>")

    first, rest = _split(benchmark, part_bytes)
    out = scan(first)
    for part in rest:
        out = saved(out.unionByName(scan(part)), "benchmark-spans")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The report: words, hit words and items of each document, the items as a digest."""
    rows = hit_words(docs, benchmark, part_bytes=part_bytes)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents in which no window occurs, with all their columns; a filter without a shuffle for each part."""

    def kept(rows: DataFrame, part: list[tuple]) -> DataFrame:
        make_scanner = _scanner(rows, part, window)

        def make():
            scanner = make_scanner()
            return lambda texts: [not scanner.matches(words_of(t or b"")) for t in texts]

        return filtered(rows, utf8("text"), make)

    first, rest = _split(benchmark, part_bytes)
    out = kept(docs, first)
    for part in rest:
        out = kept(saved(out, "benchmark-clean"), part)
    return out


def digest(items: list) -> str:
    """The digest of item ids, as in the report."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
