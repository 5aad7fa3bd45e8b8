"""Operator 2: WARC archives in Zstandard (``.warc.zst``).

A file starts with a skippable frame that holds the dictionary; every record is one frame of its
own, compressed with that dictionary. The reader loads the dictionary, decodes frame after frame and
validates the version line, the headers, the lengths and the digests of each record.

Of the records with equal payloads of at least ``MIN_PAYLOAD`` bytes the one with the smallest page
id is stored as a response, and the others as revisits without a payload that refer to it.

Edge cases: a null html is an empty payload; a null url is left out; a null page id is written as
``null`` and never is the one that others refer to, unless a group has no other id (then all its
records are responses); rows with the same page id and payload are all responses; an empty table
gives no archive and no row. A file whose first frame is no dictionary is read without one.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import saved, shared_path, utf8

MIN_PAYLOAD = 100
#: Fixed values of the format: the magic number of the dictionary's frame, and of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: A file's dictionary is trained on the first records of its own task; bounds of that sample.
SAMPLE_RECORDS = 256
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 16 << 10
#: A file is closed beyond this size.
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 20


class BadRecord(ValueError):
    """A record or file that breaks the format."""


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which records refer to which.

    One row for each digest is summed before the shuffle; the join back is an ordinary equi-join, in
    which adaptive execution can split a digest that many pages share.
    """
    rows = pages.select("page_id", "url", F.coalesce(utf8("html"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= MIN_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: the block is an HTTP response, which a revisit has without its body."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary for these records; where they are too few to train one, the records themselves are it."""
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Archive:
    """One file being written."""

    def __init__(self, folder: str, samples: list[bytes]):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = filesystem(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size, self.records = system.open_output_stream(path, compression=None), 0, 0
        content = dictionary_of(samples)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        if content:
            packed = zstandard.ZstdCompressor(level=19).compress(content)
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.size}


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records and return the list of files: (path, records, bytes).

    Every task writes files with names of its own. Only those of tasks that ended well are in the
    list, so what a lost or repeated task left behind is never read.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive, held = [], None, []

        def start() -> Archive:
            samples, room = [], SAMPLE_BYTES
            for x in held[:SAMPLE_RECORDS]:
                samples.append(x[: 64 << 10])
                room -= len(samples[-1])
                if room < 0:
                    break
            return Archive(folder, samples)

        for part in parts:
            held = [record(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            for x in held:
                if archive is None:
                    archive = start()
                archive.add(x)
                if archive.size >= FILE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def frames(stream: io.IOBase) -> Iterator[bytes]:
    """The content of each frame, read in pieces."""
    data = stream.read(READ_BYTES)
    content = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        length = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + length:
            more = stream.read(READ_BYTES)
            if not more:
                raise BadRecord("the dictionary is cut off")
            data += more
        content, data = bytes(data[8 : 8 + length]), data[8 + length :]
        if content.startswith(FRAME_MAGIC):
            content = zstandard.ZstdDecompressor().decompress(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    while data or (data := stream.read(READ_BYTES)):
        frame, out = reader.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise BadRecord("the last frame is cut off")
        yield b"".join(out)


def _page(urn: str) -> int | None:
    if not urn.startswith("<urn:page:"):
        raise BadRecord(f"no page: {urn}")
    return None if urn[10:-1] == "null" else int(urn[10:-1])


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the block's payload of a record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise BadRecord(f"bad header: {line}")
        headers[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - headers.keys()
    if missing or headers["warc-type"] not in ("response", "revisit"):
        raise BadRecord(f"missing or bad: {sorted(missing) or headers['warc-type']}")
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadRecord("the block's length is not the one announced")
    if headers.get("warc-block-digest", f"sha256:{hashlib.sha256(block).hexdigest()}") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadRecord("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    if not gap or size is None or (payload if revisit else len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise BadRecord("the payload is not the one announced")
    if revisit and "warc-refers-to" not in headers:
        raise BadRecord("a revisit that refers to nothing")
    return _page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers["warc-refers-to"]) if revisit else None, payload


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the files in column ``path``, without their payloads if those aren't wanted.

    Each file is streamed by one task, frame by frame.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                system, inner = filesystem(path)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(parse(data)[: len(names)])
                        size += len(data)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    count = max(1, files.count())
    return files.select("path").repartition(count).mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives below the shared folder; the list of files."""
    return saved(write_archives(with_revisits(pages), shared_path(spark, "warc")), "warc-files")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and give a row for each record that was read."""
    return read_archives(archive_pages(spark, pages), payload=False)
