"""Operator 6: SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model is a BPE model, whose result isn't the best-scored segmentation but the one that its merges
lead to. It can still be found as a path: a sequence of pieces is the model's result exactly when each
two neighbours, put together, are encoded as these two pieces. Such a neighbourship weighs 0 and any
other minus infinity, so the result is the only path that weighs 0, and the max-plus scan finds it.

A giant document is cut into chunks. The state at a boundary is the piece that lies across it (or
ends there). Each chunk yields the matrix of its weights from each state at its left boundary to each
at its right one, without knowing its neighbours; the matrices of a document are combined
associatively, ``BLOCK`` neighbours in one task and then the products of the blocks, which fixes the states
at the blocks' ends and then those within each block; then each chunk is traced back by itself. Within a chunk a
space after a word is a place that every path breaks at, so only its ends need the search.

Other documents are cut at the same places, and each distinct word is encoded once by the library.

Edge cases: null and empty texts have no pieces and decode to the empty text; the model writes spaces
as U+2581, so a text that holds that character itself decodes to spaces and ``round_trip`` is false;
repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import map_columns, saved
from corpusflow.llm.pretokens import Table

#: A document with more characters is cut into chunks of this size.
CHUNK = 16_384
#: Chunks whose matrices are combined in one group; a text of 2 GB has 512 such blocks.
BLOCK = 256
MARK = "▁"
#: Fixed value, in the model file's format: the normaliser adds no space in front.
_NO_PREFIX = b"\x1a\x02\x18\x00"


class Model:
    """The library's processor, the same without a space in front, and what the search looks up."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=proto + _NO_PREFIX)
        sp = self.raw
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.pieces = {sp.id_to_piece(i) for i in own}
        self.halo = max(map(len, self.pieces))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece of this model holds a space after another character")
        self.words = Table(lambda word: self.packed(self.raw.encode(MARK + word)))
        self.ids = lru_cache(1 << 14)(self.raw.encode)
        self.joins = lru_cache(1 << 16)(self._joins)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _joins(self, a: str, b: str) -> bool:
        """The two pieces are neighbours in the model's result."""
        return self.raw.encode(a + b) == self.ids(a) + self.ids(b)

    def encode(self, text: str) -> bytes:
        """The ids of a text that is not giant, packed."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or MARK in text:
            return self.packed(self.whole.encode(text))
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def body(self, text: str) -> list[int]:
        """The ids of a stretch that begins with a space and ends before one, word by word."""
        if MARK + MARK in text:
            return self.raw.encode(text)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split(MARK)[1:])), "<u4").tolist()

    def is_piece(self, text: str) -> bool:
        return len(text) == 1 or text in self.pieces


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def states(model: Model, text: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of each piece that holds the character before ``at``: the states at that boundary."""
    out = []
    for start in range(max(0, at - model.halo), at):
        for end in range(at, min(len(text), start + model.halo) + 1):
            if model.is_piece(text[start:end]):
                out.append((start, end))
    return out


class Chunk:
    """A chunk with as much text on both sides as a piece can be long.

    ``text`` is the document's, with spaces as marks; ``left`` and ``right`` are the boundaries in it.
    """

    def __init__(self, model: Model, text: str, left: int, right: int, first: bool):
        self.model, self.text, self.left, self.right, self.first = model, text, left, right, first
        self.ins = [(-1, left)] if first else states(model, text, left)  # nothing is before the first
        self.outs = states(model, text, right)
        self.breaks = self._breaks()

    def _breaks(self) -> tuple[int, int] | None:
        """The first and the last space in the chunk that follows another character."""
        text, begin = self.text, max(self.left, 1)
        low = text.find(MARK, begin, self.right)
        while low >= 0 and text[low - 1] == MARK:
            low = text.find(MARK, low + 1, self.right)
        if low < 0:
            return None
        high = text.rfind(MARK, begin, self.right)
        while text[high - 1] == MARK:
            high -= 1
        return low, high

    def _walk(self, begin: list[tuple[int, int]], stop: int) -> tuple[list[dict[int, int]], int]:
        """For each place up to the halo behind ``stop``, the last pieces' starts and which beginnings lead there, as bits."""
        text, model = self.text, self.model
        base = min(e for _, e in begin)
        seen: list[dict[int, int]] = [{} for _ in range(len(text) + 1 - base)]
        for bit, (s, e) in enumerate(begin):
            seen[e - base][s] = seen[e - base].get(s, 0) | 1 << bit
        for at in range(base, stop):
            here = seen[at - base]
            if not here:
                continue
            for end in range(at + 1, min(len(text), at + model.halo) + 1):
                piece = text[at:end]
                if not model.is_piece(piece):
                    continue
                bits = 0
                for s, own in here.items():
                    if s < 0 or model.joins(text[s:at], piece):
                        bits |= own
                if bits:
                    seen[end - base][at] = seen[end - base].get(at, 0) | bits
        return seen, base

    def matrix(self) -> np.ndarray:
        """Weights from the states at the left to those at the right: 0 or minus infinity."""
        out = np.full((len(self.ins), len(self.outs)), -np.inf, np.float32)
        if self.breaks is None:
            seen, base = self._walk(self.ins, self.right)
            for j, (s, e) in enumerate(self.outs):
                for i, (s0, e0) in enumerate(self.ins):
                    if (s >= e0 and seen[e - base].get(s, 0) >> i & 1) or (s0, e0) == (s, e):
                        out[i, j] = 0
            return out
        low, high = self.breaks
        fit = [i for i, (_, e) in enumerate(self.ins) if e <= low]
        if fit:
            seen, base = self._walk([self.ins[i] for i in fit], low)
            bits = 0
            for own in seen[low - base].values():
                bits |= own
            tail, base = self._walk([(-1, high)], self.right)
            for k, i in enumerate(fit):
                if bits >> k & 1:
                    for j, (s, e) in enumerate(self.outs):
                        if s >= high and tail[e - base].get(s, 0):
                            out[i, j] = 0
        return out

    def _path(self, begin: tuple[int, int], goal: tuple[int, int] | int) -> list[str]:
        """The pieces after ``begin`` up to the goal: a state, which is included, or a place."""
        stop = goal if isinstance(goal, int) else goal[1]
        if begin[1] >= stop:
            return []
        seen, base = self._walk([begin], stop)
        end = stop
        start = next(iter(seen[end - base])) if isinstance(goal, int) else goal[0]
        out = []
        while (start, end) != begin:
            piece = self.text[start:end]
            out.append(piece)
            before = seen[start - base]
            end, start = start, next(s for s in before if s < 0 or self.model.joins(self.text[s:start], piece))
        return out[::-1]

    def trace(self, i: int, j: int) -> tuple[list[int], str]:
        """The ids between the two states (the right one's piece included), and the text that they stand for."""
        begin, goal = self.ins[i], self.outs[j]
        if begin == goal:
            return [], ""
        model = self.model
        if self.breaks is None:
            ids = [x for p in self._path(begin, goal) for x in model.ids(p)]
        else:
            low, high = self.breaks
            ids = [x for p in self._path(begin, low) for x in model.ids(p)]
            ids += model.body(self.text[low:high]) if low < high else []
            ids += [x for p in self._path((-1, high), goal) for x in model.ids(p)]
        return ids, self.text[begin[1] : goal[1]]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: the best weight over all states in between."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """All matrices combined, neighbours pair by pair."""
    while len(matrices) > 1:
        matrices = [compose(matrices[k], matrices[k + 1]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def choose(matrices: list[np.ndarray], ends: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The states (left, right) of each chunk on the best path through all of them, between the given ends or the best ones.

    Neighbours are combined pair by pair up to one matrix; the choice is then carried down again.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([compose(now[k], now[k + 1]) if k + 1 < len(now) else now[k] for k in range(0, len(now), 2)])
    top = levels[-1][0]
    picked = [ends or tuple(int(x) for x in np.unravel_index(int(top.argmax()), top.shape))]
    if not np.isfinite(top[picked[0]]):
        raise ValueError("no segmentation: the pieces of this model aren't closed under merging")
    for now in reversed(levels[:-1]):
        below = []
        for k, (i, j) in enumerate(picked):
            a = now[2 * k]
            if 2 * k + 1 < len(now):
                mid = int((a[i] + now[2 * k + 1][:, j]).argmax())
                below += [(i, mid), (mid, j)]
            else:
                below.append((i, j))
        picked = below
    return picked


def chunks(docs: DataFrame, model_path: str, size: int = CHUNK, id_col: str = "doc_id") -> DataFrame:
    """(key, doc_id, n, text, left, right) of each chunk of each document; key is the row's, n the chunk's number."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("text", pa.string()), ("left", pa.int32()), ("right", pa.int32()), ("marks", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo, rows, room = model_of(model_path).halo, [], 1 << 22
        for part in parts:
            for key, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                whole = MARK + text.replace(" ", MARK)
                for n, at in enumerate(range(0, len(whole), size)):
                    low, high = max(0, at - halo), min(len(whole), at + size + halo)
                    rows.append((key, doc_id, n, whole[low:high], at - low, min(len(whole), at + size) - low, MARK in text))
                    room -= high - low
                    if room < 0:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, room = [], 1 << 22
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    named = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, "key long, doc_id long, n int, text string, left int, right int, marks boolean")


def transfers(parts: DataFrame, model_path: str) -> DataFrame:
    """(key, n, rows, weights): each chunk's matrix, a byte for each weight (1: 0, 0: minus infinity)."""

    def make():
        model = model_of(model_path)

        def run(keys: list, numbers: list, texts: list, lefts: list, rights: list) -> list[list]:
            found = [Chunk(model, t, a, b, n == 0).matrix() for n, t, a, b in zip(numbers, texts, lefts, rights, strict=True)]
            return [keys, numbers, [m.shape[0] for m in found], [np.isfinite(m).astype(np.uint8).tobytes() for m in found]]

        return run

    return map_columns(parts.select("key", "n", "text", "left", "right"), make, "key long, n int, rows int, weights binary", rows_at_once=64)


def _weights(rows: int, data: bytes) -> np.ndarray:
    return np.where(np.frombuffer(data, np.uint8).reshape(rows, -1) > 0, np.float32(0), np.float32(-np.inf))


def _grouped(df: DataFrame, keys: list[str], order: str, run: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``run`` over the rows of each group, in order; as many tasks as the session's shuffles have, and one group at a time held."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow, width = to_arrow_schema(_parse_datatype_string(schema)), len(keys)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        out = []
        for _, own in groupby(rows, lambda row: row[:width]):
            out += run(list(own))
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    first = [*keys, order]
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*first, *(c for c in df.columns if c not in first)).repartition(count, *keys)
    return dealt.sortWithinPartitions(*first).mapInArrow(work, schema)


def chosen(matrices: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, n, i, j): the states of each chunk.

    Up: the product of each block of a document's matrices. At the top: the states at the ends of the
    blocks. Down: the states within each block, between its ends.
    """

    def up(rows: list[tuple]) -> Iterator[tuple]:
        whole = product([_weights(r, w) for _, _, _, r, w in rows])
        yield rows[0][0], rows[0][1], whole.shape[0], np.isfinite(whole).astype(np.uint8).tobytes()

    def top(rows: list[tuple]) -> Iterator[tuple]:
        for (key, at, *_), (i, j) in zip(rows, choose([_weights(r, w) for _, _, r, w in rows]), strict=True):
            yield key, at, i, j

    def down(rows: list[tuple]) -> Iterator[tuple]:
        for (key, _, n, *_), (i, j) in zip(rows, choose([_weights(r, w) for _, _, _, r, w, _, _ in rows], rows[0][5:7]), strict=True):
            yield key, n, i, j

    held = matrices.select("key", F.floor(F.col("n") / block).cast("int").alias("block"), "n", "rows", "weights")
    blocks = _grouped(held, ["key", "block"], "n", up, "key long, block int, rows int, weights binary")
    ends = _grouped(blocks, ["key"], "block", top, "key long, block int, i int, j int")
    return _grouped(held.join(ends, ["key", "block"]).select("key", "block", "n", "rows", "weights", "i", "j"), ["key", "block"], "n", down, "key long, n int, i int, j int")


def traced(parts: DataFrame, picks: DataFrame, model_path: str) -> DataFrame:
    """(key, doc_id, n, ids, text, marks) of each chunk: its own ids, packed, and the text decoded from them."""

    def make():
        model = model_of(model_path)

        def run(keys, ids_, numbers, texts, lefts, rights, marks, i_, j_) -> list[list]:
            packed, good, chars = [], [], []
            for n, t, a, b, i, j in zip(numbers, texts, lefts, rights, i_, j_, strict=True):
                ids, text = Chunk(model, t, a, b, n == 0).trace(i, j)
                decoded = model.raw.decode(ids)
                packed.append(model.packed(ids))
                chars.append(len(decoded) - (n == 0))
                good.append(decoded == text.replace(MARK, " "))
            return [keys, ids_, numbers, packed, chars, [g and not m for g, m in zip(good, marks, strict=True)]]

        return run

    rows = parts.join(picks, ["key", "n"]).select("key", "doc_id", "n", "text", "left", "right", "marks", "i", "j")
    return map_columns(rows, make, "key long, doc_id long, n int, ids binary, decoded_chars long, round_trip boolean", rows_at_once=64)


def _short(docs: DataFrame, model_path: str) -> DataFrame:
    def make():
        model = model_of(model_path)

        def run(ids: list, texts: list) -> list[list]:
            packed = [model.encode(t or "") for t in texts]
            back = [model.whole.decode(np.frombuffer(p, "<u4").tolist()) if p else "" for p in packed]
            return [ids, packed, [len(b) for b in back], [b == (t or "") for b, t in zip(back, texts, strict=True)], [1] * len(ids)]

        return run

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids binary, decoded_chars long, round_trip boolean, n_chunks int", rows_at_once=512)


def _long(docs: DataFrame, model_path: str, size: int) -> DataFrame:
    parts = saved(chunks(docs, model_path, size), "chunks")
    picks = chosen(saved(transfers(parts, model_path), "transfers"))
    rows = traced(parts, picks, model_path)
    return rows.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.expr("listagg(ids, X'') within group (order by n)").alias("ids"),
        F.sum("decoded_chars").alias("decoded_chars"), F.bool_and("round_trip").alias("round_trip"), F.count("*").cast("int").alias("n_chunks"),
    ).drop("key")


def encoded(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded_chars, round_trip, n_chunks); ids are packed, 4 bytes each, little-endian."""
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return _short(docs.where(~giant), model_path).unionByName(_long(docs.where(giant), model_path, chunk))


def report(docs: DataFrame, model_path: str, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """A row for each document: how many pieces, the CRC of its ids, whether decoding gives the text again, and the ids if they are wanted."""
    rows = encoded(docs, model_path, chunk)
    found = ["doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "decoded_chars", "round_trip", "n_chunks"]
    return rows.select(*found, *["ids"] * with_ids)


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text): the texts of packed ids, as ``encoded`` returns them."""

    def make():
        model: Any = model_of(model_path)

        def run(ids: list, packed: list) -> list[list]:
            return [ids, [model.whole.decode(np.frombuffer(p, "<u4").tolist()) if p else "" for p in packed]]

        return run

    return map_columns(rows.select("doc_id", "ids"), make, "doc_id long, text string")
