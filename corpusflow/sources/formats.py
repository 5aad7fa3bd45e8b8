"""Which format a file has: by its first bytes, else by its name. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import col
from corpusflow.settings import DEFAULTS

#: File extensions by format.
EXTENSIONS = {
    "pdf": [".pdf"],
    "html": [".html", ".htm", ".xhtml"],
    "markdown": [".md", ".markdown", ".mdown", ".mkd"],
    "docx": [".docx"],
    "text": [".txt", ".text"],
    "image": [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".gif", ".webp", ".svg"],
    "json": [".json", ".jsonl", ".ndjson"],
    "csv": [".csv", ".tsv"],
}
#: MIME types by format.
MIME_TYPES = {
    "pdf": ["application/pdf"],
    "html": ["text/html", "application/xhtml+xml"],
    "markdown": ["text/markdown", "text/x-markdown"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword"],
    "text": ["text/plain"],
    "image": ["image/png", "image/jpeg", "image/jpg", "image/tiff", "image/bmp", "image/gif", "image/webp", "image/svg+xml"],
    "json": ["application/json", "application/ld+json", "text/json"],
    "csv": ["text/csv", "application/csv"],
}
#: What uploads may be, by the text after the last dot.
UPLOADS = {"pdf": ["pdf"], "html": ["html", "htm"], "markdown": ["md", "markdown"], "docx": ["docx"], "text": ["txt"], "image": ["jpg", "jpeg", "png", "tiff", "tif"]}
#: The formats that are offered, with their extensions, types and descriptions.
OFFERED = [
    ("pdf", [".pdf"], ["application/pdf"], "Adobe PDF documents"),
    ("html", [".html", ".htm"], ["text/html"], "HTML web pages"),
    ("markdown", [".md", ".markdown"], ["text/markdown"], "Markdown documentation"),
    ("docx", [".docx"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], "Microsoft Word documents"),
    ("text", [".txt"], ["text/plain"], "Plain text files"),
    ("image", [".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp"], ["image/jpeg", "image/png", "image/tiff", "image/bmp", "image/webp"], "Images (read by a vision model)"),
]
#: First bytes, as hexadecimal, and the type that they tell.
SIGNATURES = [
    ("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
    ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp"), ("D0CF11E0A1B11AE1", "application/msword"),
]
HEAD = 2048


def _lookup(value: Column, table: dict[str, list[str]]) -> Column:
    pairs = [x for name, keys in table.items() for k in keys for x in (F.lit(k), F.lit(name))]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit("unknown"))


def by_extension(name: str | Column) -> Column:
    """By the last suffix; a name that is only a suffix has none."""
    base = F.regexp_extract(col(name), r"([^/]*)$", 1)
    return _lookup(F.lower(F.regexp_extract(base, r"(?s).(\.[^.]+)$", 1)), EXTENSIONS)


def mime_type(content: str | Column) -> Column:
    """The type that the first 2,048 bytes tell; null for empty and for unknown ones."""
    head = F.substring(col(content), 1, HEAD)
    text = head.cast("string")
    low = F.lower(F.ltrim(text))
    starts = lambda sign: F.startswith(head, F.unhex(F.lit(sign)))
    out = F.when(F.length(head) == 0, F.lit(None).cast("string"))
    for sign, kind in SIGNATURES:
        out = out.when(starts(sign), kind)
    out = out.when(starts("52494646") & (F.substring(head, 9, 4) == F.unhex(F.lit("57454250"))), "image/webp")
    out = out.when(starts("504B0304") & F.contains(head, F.lit("word/").cast("binary")), MIME_TYPES["docx"][0])
    out = out.when(starts("504B0304"), "application/zip").when(F.contains(head, F.lit(b"\x00")), "application/octet-stream")
    out = out.when(low.startswith("<!doctype html") | low.startswith("<html"), "text/html")
    out = out.when(low.startswith("<svg") | (low.startswith("<?xml") & F.contains(low, F.lit("<svg"))), "image/svg+xml")
    out = out.when((low.startswith("{") | low.startswith("[")) & (F.length(col(content)) <= HEAD) & F.try_parse_json(text).isNotNull(), "application/json")
    return out.when(F.is_valid_utf8(F.regexp_replace(text, "�+$", "")), "text/plain").otherwise(F.lit(None))


def by_content(content: str | Column) -> Column:
    return _lookup(F.coalesce(mime_type(content), F.lit("")), MIME_TYPES)


def detected(content: str | Column, name: str | Column) -> Column:
    """By content, else by name, else unknown."""
    return F.coalesce(F.nullif(by_content(content), F.lit("unknown")), by_extension(name))


def upload_format(name: str | Column) -> Column:
    """By the text after the last dot (the whole name if there is none); unknown formats are refused."""
    return _lookup(F.element_at(F.split(F.lower(col(name)), r"\."), -1), UPLOADS)


def size_status(length: str | Column, most: int = DEFAULTS.max_file_bytes) -> Column:
    return F.when(col(length) > most, "TOO_LARGE").when(col(length) == 0, "EMPTY").otherwise("OK")


def offered(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OFFERED, "format string, extensions array<string>, mime_types array<string>, description string")
