"""PDF files: the text of each page from its content streams, then the page cleaning as columns.

The reader follows the page tree, opens object streams and knows plain and Flate streams and literal
and hexadecimal strings in simple encodings; where a full PDF library is installed it is used instead.
"""

from __future__ import annotations

import io
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.clean import cleaned
from corpusflow.functions.structure import structure
from corpusflow.functions.text import file_hash, lines, strip
from corpusflow.sources.reading import with_read

READ = "pages array<string>, info map<string,string>, warnings array<string>"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[jJdDm*]|['\"]|\bET\b", re.S)
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
INFO = {"author": b"Author", "title": b"Title", "subject": b"Subject", "creator": b"Creator", "producer": b"Producer", "creation_date": b"CreationDate"}


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0")) if len(raw) > 2 else b""
        return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")
    inner = raw[1:-1]
    if inner.startswith(b"\xfe\xff"):
        return inner[2:].decode("utf-16-be", "replace")
    return re.sub(rb"\\(\d{1,3}|.)", lambda m: (chr(int(m[1], 8) & 255) if m[1].isdigit() else _ESCAPES.get(m[1], m[1].decode("latin-1"))).encode("latin-1", "replace"), inner, flags=re.S).decode("latin-1")


def _shown(stream: bytes) -> str:
    """The strings that a content stream shows; a move to another line ends a line."""
    out: list[str] = []
    for m in _SHOW.finditer(stream):
        token = m[0]
        if token[:1] in (b"(", b"<"):
            out.append(_string(token))
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"ET") and out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).strip()


def _stream(body: bytes) -> bytes:
    """The bytes of an object's stream; a checksum that is cut off doesn't matter."""
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]


def _objects(data: bytes) -> dict[int, bytes]:
    """All objects by number, those in object streams too."""
    objects = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(objects.values()):
        if not re.search(rb"/Type\s*/ObjStm\b", body):
            continue
        count, first = (re.search(rb"/" + key + rb"\s+(\d+)", body) for key in (b"N", b"First"))
        if count and first:
            inner, start = _stream(body), int(first[1])
            head = [int(x) for x in inner[:start].split()[: 2 * int(count[1])]]
            ends = [*head[3::2], len(inner) - start]
            for number, at, end in zip(head[::2], head[1::2], ends, strict=True):
                objects.setdefault(number, inner[start + at : start + end])
    return objects


def _pages(data: bytes, objects: dict[int, bytes]) -> list[bytes]:
    """The pages in the order of the page tree; in that of their numbers where there is no tree."""
    is_page = lambda body: re.search(rb"/Type\s*/Page\b(?!s)", body)
    roots = re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", data)
    tree = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", objects.get(int(roots[-1]), b"")) if roots else None
    todo, seen, found = [int(tree[1])] if tree else [], set(), []
    while todo:
        number = todo.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        if is_page(body):
            found.append(body)
        elif kids := re.search(rb"/Kids\s*\[([^\]]*)\]", body):
            todo += [int(n) for n in reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids[1]))]
    return found or [body for _, body in sorted(objects.items()) if is_page(body)]


def read(data: bytes, max_pages: int | None = None) -> tuple:
    warnings: list[str] = []
    try:
        objects = _objects(data)
        if not data.startswith(b"%PDF") or not objects:
            raise ValueError("this is no PDF file")
        pages = []
        kids = _pages(data, objects)
        if max_pages is not None and len(kids) > max_pages:
            warnings.append(f"Only the first {max_pages} of {len(kids)} pages were read")
            kids = kids[:max_pages]
        for number, page in enumerate(kids, 1):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
            text = []
            for ref in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs else []:
                if shown := _stream(objects.get(int(ref), b"")):
                    text.append(_shown(shown))
            pages.append("\n".join(text))
            if not pages[-1].strip():
                warnings.append(f"Page {number} has no text")
        info = {name: _string(m[1]) for name, key in INFO.items() if (m := re.search(rb"/" + key + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", data))}
        return pages, info, warnings
    except Exception as error:  # a file that can't be read must not end the job
        return [], {}, [*warnings, f"Could not read the file: {str(error)[:200]}"]


def _with_library(data: bytes, max_pages: int | None) -> tuple:
    try:
        import pypdf
    except ImportError:
        return read(data, max_pages)
    try:
        reader = pypdf.PdfReader(io.BytesIO(data))
        pages = [p.extract_text() or "" for p in reader.pages[:max_pages]]
        warnings = [f"Page {i} has no text" for i, p in enumerate(pages, 1) if not p.strip()]
        info = {k: str(getattr(reader.metadata, k)) for k in INFO if reader.metadata and getattr(reader.metadata, k, None)}
        return pages, info, warnings
    except Exception:
        return read(data, max_pages)


def extracted(files: DataFrame, max_pages: int | None = None, clean: bool = True) -> DataFrame:
    """Text of all pages, cleaned; section headers, content type and quality are columns."""
    hashed = files.select("path", "content", file_hash("content").alias("file_hash"))
    rows = with_read(hashed, "_d", lambda x: _with_library(x or b"", max_pages), READ, "content").select("path", "file_hash", "_d.*")
    rows = rows.withColumn("_raw", F.array_join("pages", "\n\n")).withColumn("text", cleaned("_raw") if clean else F.col("_raw")).withColumn("_s", structure("text"))
    n, blank = F.size("pages"), F.size(F.filter("pages", lambda p: strip(p) == ""))
    chars = F.length("text")
    ratio = F.when(F.length("_raw") > 0, 1 - chars / F.length("_raw")).otherwise(F.lit(0.0))
    per_page, empty = F.when(n > 0, chars / n).otherwise(F.lit(0.0)), F.when(n > 0, blank / n).otherwise(F.lit(0.0))
    headers = F.filter(F.transform("_s.header_positions", lambda i: strip(F.element_at(lines("text"), i + 1))), lambda x: F.length(x) > 3)
    kind = F.when(F.col("_s.has_tables"), "TABLE").when(F.col("_s.has_lists"), "LIST").when(F.col("_s.has_headers"), "HEADING").otherwise("TEXT")
    notes = F.array_compact(F.array(F.when(ratio > 0.3, "Cleaning removed over 0.3 of the text"), F.when((n > 0) & (per_page < 100), "Fewer than 100 characters a page"), F.when(empty > 0.2, "Over 0.2 of the pages are empty")))
    return rows.select(
        "path", "text", kind.alias("content_type"), F.when(n > 0, "EXTRACTED").otherwise("FAILED").alias("status"), F.concat("warnings", notes).alias("warnings"), "file_hash", "info",
        F.transform("pages", lambda p, i: F.struct((i + 1).alias("page_number"), p.alias("text"), F.length(p).alias("char_count"))).alias("pages"), headers.alias("section_headers"),
        F.struct(n.alias("total_pages"), blank.alias("empty_pages"), empty.alias("empty_ratio"), (1 - empty).alias("success_rate"), per_page.alias("avg_chars"), ratio.alias("reduction_ratio")).alias("quality"),
    )
