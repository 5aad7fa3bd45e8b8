"""Operator 7: token ids in files of patched frame-of-reference blocks.

Documents are dealt out by ranges of their id and encoded in order; each range becomes one file. A
file holds blocks of ``BLOCK`` ids. A block stores its minimum, a bit width chosen at a percentile of
the differences to it, the low bits of all differences packed at that width, and a list of
exceptions: places and high bits of the outliers. The footer has the byte at which each block starts
and, for each document, its id, its first place and its number of ids.

Edge cases: a null text is empty and has the end id alone; a null id comes first, and rows with equal
ids follow in the order of their texts' hashes; an empty table gives no file and no row; other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import saved, shared_path
from corpusflow.llm.pretokens import encoder_of
from corpusflow.llm.warc import filesystem

BLOCK = 8192
#: The width holds at least this share of a block's differences; the rest are exceptions.
PERCENTILE = 98
MAGIC = b"CFPFOR1\n"
#: Appended to each document.
END_ID = 0
_HEAD = struct.Struct("<IIBI")


def pack_block(ids: np.ndarray) -> bytes:
    """A block's bytes: count, minimum, width, number of exceptions; packed low bits; places and high bits."""
    least = int(ids.min())
    gap = ids - np.uint32(least)
    rank = len(gap) * PERCENTILE // 100
    width = int(np.partition(gap, min(rank, len(gap) - 1))[min(rank, len(gap) - 1)]).bit_length()
    width = width + (-width) % 8 if width % 8 in (6, 7) else width  # whole bytes where they are near
    over = np.flatnonzero(gap >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = _HEAD.pack(len(gap), least, width, len(over))
    return head + _pack(gap, width) + over.astype("<u2").tobytes() + (gap[over] >> np.uint32(width)).astype("<u4").tobytes()


def _pack(gap: np.ndarray, width: int) -> bytes:
    if width == 0:
        return b""
    if width % 8 == 0:
        return gap.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = np.unpackbits(gap.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack_block(data: bytes | memoryview, at: int) -> np.ndarray:
    """The ids of the block that starts at byte ``at``."""
    count, least, width, over = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (count * width + 7) // 8
    wide = np.zeros((count, 4), np.uint8)
    if width and width % 8 == 0:
        wide[:, : width // 8] = np.frombuffer(data, np.uint8, size, at).reshape(count, -1)
    elif width:
        bits = np.zeros((count, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little").reshape(count, width)
        wide = np.packbits(bits, axis=1, bitorder="little")
    gap = wide.reshape(-1).view("<u4").copy()
    at += size
    if over:
        places = np.frombuffer(data, "<u2", over, at)
        gap[places] |= np.frombuffer(data, "<u4", over, at + 2 * over) << np.uint32(width)
    return gap + np.uint32(least)


class Writer:
    """One file being written: documents are added in order, full blocks leave at once."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.ids"
        system, path = filesystem(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.starts, self.held, self.n_held, self.n = len(MAGIC), [], [], 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, self.n, n))
        self.n += n
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK
        for i in range(0, whole, BLOCK):
            data = pack_block(ids[i : min(i + BLOCK, whole)])
            self.starts.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> dict:
        self._flush(True)
        absent = [i for i, d in enumerate(self.docs) if d[0] is None]
        table = np.array([(d[0] or 0, d[1], d[2]) for d in self.docs], "<i8").reshape(-1, 3)
        footer = np.array(self.starts, "<i8").tobytes() + table.tobytes()
        meta = json.dumps({"blocks": len(self.starts), "docs": len(self.docs), "ids": self.n, "null_ids": absent}).encode()
        self.out.write(footer + meta + struct.pack("<QI", self.at, len(meta)) + MAGIC)
        self.out.close()
        return {"path": self.path, "ids": self.n, "docs": len(self.docs)}


class Reader:
    """Random access to one file: a document touches only the blocks it lies in."""

    def __init__(self, path: str):
        system, inner = filesystem(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = 12 + len(MAGIC)
        self.file.seek(size - tail)
        end = self.file.read(tail)
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} has no footer")
        at, length = struct.unpack("<QI", end[:12])
        self.file.seek(at)
        foot = self.file.read(size - tail - at)
        meta = json.loads(foot[len(foot) - length :])
        self.starts = np.frombuffer(foot, "<i8", meta["blocks"])
        self.docs = np.frombuffer(foot, "<i8", 3 * meta["docs"], 8 * meta["blocks"]).reshape(-1, 3)
        self.null_ids, self.end, self.ids = set(meta["null_ids"]), at, meta["ids"]
        self.loaded, self.block = -1, np.empty(0, np.uint32)

    def _load(self, k: int) -> np.ndarray:
        if k != self.loaded:
            stop = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.end
            self.file.seek(int(self.starts[k]))
            self.block, self.loaded = unpack_block(self.file.read(stop - int(self.starts[k])), 0), k
        return self.block

    def slice(self, start: int, n: int) -> np.ndarray:
        """The ids from place ``start`` of the file on."""
        parts = []
        while n > 0:
            block = self._load(start // BLOCK)
            part = block[start % BLOCK : start % BLOCK + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for i, (doc_id, start, n) in enumerate(self.docs.tolist()):
            yield None if i in self.null_ids else doc_id, start, self.slice(start, n)


def write_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; (path, part, ids, docs, start) of each file, in the order of the ids.

    Only the files of tasks that ended well are listed. ``start`` counts the ids of all earlier files.
    """
    folder = shared_path(docs.sparkSession, "ids")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, end = encoder_of(tokenizer), None, struct.pack("<I", END_ID)
        for part in parts:
            if part.num_rows and writer is None:
                writer = Writer(folder)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                writer.add(doc_id, encoder.ids(text) + end)
        done = [] if writer is None else [writer.close() | {"part": TaskContext.get().partitionId()}]
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("ids", pa.int64()), ("docs", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = saved(dealt.mapInArrow(write, "path string, part int, ids long, docs long"), "id-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each file
    return files.withColumn("start", F.sum("ids").over(before) - F.col("ids"))


def read_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, and its ids if they are wanted."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in Reader(path).documents():
                    row = (doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    rows.append((*row, ids.tolist()) if with_ids else row)
                    if len(rows) >= (1000 if with_ids else 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    listed = saved(files.select("path", "start"), "id-starts")
    count = max(1, listed.count())
    return listed.repartition(count).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
