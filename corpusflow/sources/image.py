"""Images: sizes from the header, text from a pluggable vision model, confidence as a column."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import col, file_hash

PAGE_BREAK = "\n\n---PAGE_BREAK---\n\n"
MAX_PAGES = 10
#: Our own prompts.
PROMPTS = {
    "classify": "Reply TEXT_DOCUMENT if this image is mainly written text, or VISUAL_CONTENT if it is mainly a picture.",
    "text": "Write down all text in this image, keeping its order.",
    "description": "Describe what this image shows, with any text in it.",
}


def size_of(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of pages, from the header; zeros where it isn't known."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return (*struct.unpack(">II", data[16:24]), 1)
    if data[:4] == b"GIF8" and len(data) >= 10:
        return (*struct.unpack("<HH", data[6:10]), 1)
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, 1
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if data[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if data[:1] == b"I" else ">"
        at, pages, w, h = struct.unpack(e + "I", data[4:8])[0], 0, 0, 0
        while at and at + 2 <= len(data) and pages < 1000:
            n = struct.unpack(e + "H", data[at : at + 2])[0]
            for k in range(n if not pages else 0):
                tag, kind = struct.unpack(e + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
                value = struct.unpack(e + ("H" if kind == 3 else "I"), data[at + 10 + 12 * k : at + 10 + 12 * k + (2 if kind == 3 else 4)])[0]
                w, h = (value, h) if tag == 256 else (w, value) if tag == 257 else (w, h)
            pages += 1
            at = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0] if at + 6 + 12 * n <= len(data) else 0
        return w, h, pages
    return 0, 0, 1


def data_url(data: bytes, kind: str = "image/png") -> str:
    return f"data:{kind};base64,{base64.b64encode(data).decode()}"


def confidence(chars: Column, n_words: Column, width: Column, height: Column, mode: Column) -> Column:
    """How much text there is for the image's area; halved for very short texts, else less for few words."""
    area = width * height * F.when(mode == "text", 0.01).otherwise(0.005)
    base = F.when(area > 0, F.least(F.lit(1.0), chars / area)).otherwise(F.lit(0.5))
    return F.when(chars < 20, base * 0.5).when(n_words < 5, base * 0.7).otherwise(base)


def resolved_mode(reply: str | Column) -> tuple[Column, Column]:
    """The mode that a classifier's reply tells, and a warning where it is unclear."""
    text, picture = F.contains(col(reply), F.lit("TEXT_DOCUMENT")), F.contains(col(reply), F.lit("VISUAL_CONTENT"))
    known = F.coalesce(text | picture, F.lit(False))
    return F.when(text, "text").otherwise("description"), F.when(~known, "The kind of image is unclear; it is described")


def extracted(files: DataFrame, vision: Callable[[bytes, str, int], str] | None = None, mode: str = "auto") -> DataFrame:
    """(path, text, content_type, width, height, pages, confidence, warnings); ``vision(data, prompt, page)`` is the model.

    Without a model the text is empty and a warning says so. Pages are joined by a page break.
    """

    @F.pandas_udf("width int, height int, pages int, reply string, text string, failed array<string>")
    def run(content):
        import pandas as pd

        rows = []
        for x in content:
            data = bytes(x or b"")
            w, h, pages = size_of(data)
            reply, texts, failed = None, [], []
            if vision is not None:
                try:
                    reply = vision(data, PROMPTS["classify"], 0) if mode == "auto" else ""
                except Exception:
                    reply = None
                own = mode if mode != "auto" else "text" if "TEXT_DOCUMENT" in (reply or "") else "description"
                for p in range(max(1, min(pages, MAX_PAGES))):
                    try:
                        texts.append(vision(data, PROMPTS[own], p))
                    except Exception as error:  # one page that the model can't read must not end the job
                        failed.append(f"Page {p + 1} could not be read: {str(error)[:200]}")
            rows.append((w, h, pages, reply, PAGE_BREAK.join(texts), failed))
        return pd.DataFrame(rows, columns=["width", "height", "pages", "reply", "text", "failed"])

    rows = files.withColumn("_d", run("content")).select("path", file_hash("content").alias("file_hash"), "_d.*")
    kind, unclear = resolved_mode("reply") if mode == "auto" else (F.lit(mode), F.lit(None).cast("string"))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    sure = confidence(F.length("text"), words, F.col("width"), F.col("height"), kind)
    notes = F.array_compact(
        F.array(F.lit(None if vision else "No vision model is set"), unclear, F.when(F.length("text") < 20, "Little text was found"), F.when(sure < 0.5, "Low confidence"), F.when(F.col("pages") > MAX_PAGES, f"Only the first {MAX_PAGES} pages were read"))
    )
    return rows.select(
        "path", "text", F.when(kind == "text", "IMAGE_TEXT").otherwise("IMAGE_DESCRIPTION").alias("content_type"), F.lit("EXTRACTED").alias("status"),
        F.concat(notes, "failed").alias("warnings"), "file_hash", "width", "height", "pages", sure.alias("confidence"),
    )
