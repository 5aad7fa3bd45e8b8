"""Plain text files: bytes are decoded in Arrow batches; all else are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import count_of, file_hash, search
from corpusflow.settings import DEFAULTS

#: Numbered lines, bullets, headers and indentation.
NUMBERED = r"^\s*(?:\d+\.|\d+\.\d+|[٠-٩]+\.|[٠-٩]+\.[٠-٩]+)\s+"
BULLETS = r"^\s*[•\-*●○◦]\s+"
HEADERS = r"^(?:[A-Z\s]{10,}|#{1,6}\s+.+)$"
INDENTED = r"^[ \t]{2,}"
#: Fixed value: the encodings that are tried when the first one fails, in this order.
FALLBACKS = ("windows-1256", "iso-8859-6", "utf-8")


def guess(data: bytes) -> tuple[str, float]:
    """An encoding and how sure it is: marks, ASCII, valid UTF-8, Arabic code page, else Latin."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name, 1.0
    if not data:
        return "utf-8", 0.0
    if data.isascii():
        return "ascii", 1.0
    try:
        data.decode("utf-8")
        return "utf-8", 0.99
    except UnicodeDecodeError:
        high = sum(b >= 0xC0 for b in data)
        return ("windows-1256", 0.75) if high > 0.3 * len(data) else ("iso-8859-1", 0.6)


def decode(data: bytes, hint: str | None = None) -> tuple[str, str, float, list[str]]:
    """Text, encoding, confidence and warnings."""
    name, sure = (hint, 1.0) if hint else guess(data)
    warnings = [] if sure >= 0.7 or not data else [f"Low confidence in encoding {name}"]
    try:
        return data.decode(name), name, sure, warnings
    except (UnicodeDecodeError, LookupError):
        warnings.append(f"Could not decode as {name}")
    for other in FALLBACKS:
        try:
            text = data.decode(other)
        except UnicodeDecodeError:
            continue
        if sum("؀" <= c <= "ۿ" for c in text) > 0.1 * max(1, len(text)):
            return text, other, sure, [*warnings, f"Encoding fallback to {other}"]
    return data.decode("utf-8", "replace"), "utf-8 (with replacement)", sure, [*warnings, "Undecodable bytes: replacement characters were put in"]


def decoded(hint: str | None = None):
    @F.pandas_udf("text string, encoding string, confidence double, warnings array<string>")
    def run(content):
        import pandas as pd

        return pd.DataFrame([decode(bytes(x or b""), hint) for x in content], columns=["text", "encoding", "confidence", "warnings"])

    return run


def line_endings(c: Column) -> Column:
    """none, windows, unix, mac or mixed: one kind must have over 0.8 of all."""
    crlf = F.regexp_count(c, F.lit("\r\n"))
    lf, cr = F.regexp_count(c, F.lit("\n")) - crlf, F.regexp_count(c, F.lit("\r")) - crlf
    total = crlf + lf + cr
    kinds = F.when(crlf > 0, 1).otherwise(0) + F.when(lf > 0, 1).otherwise(0) + F.when(cr > 0, 1).otherwise(0)
    most = F.when(crlf >= F.greatest(lf, cr), "windows").when(lf >= cr, "unix").otherwise("mac")
    return F.when(total == 0, "none").when(crlf / total > 0.8, "windows").when(lf / total > 0.8, "unix").when(cr / total > 0.8, "mac").when(kinds >= 2, "mixed").otherwise(most)


def text_structure(c: Column) -> Column:
    n, b, h = (count_of(c, p, "m") for p in (NUMBERED, BULLETS, HEADERS))
    return F.struct(
        ((n > 0) | (b > 0) | (h > 0)).alias("has_structure"), (n > 0).alias("has_numbered_sections"), (b > 0).alias("has_bullet_points"),
        (h > 0).alias("has_headers"), search(c, INDENTED, "m").alias("has_indentation"),
        n.alias("num_numbered_items"), b.alias("num_bullet_items"), h.alias("num_headers"),
    )


def extracted(files: DataFrame, hint: str | None = None, most: int = DEFAULTS.max_file_bytes) -> DataFrame:
    """(path, text, content_type, status, warnings, metadata columns) of text files; too large ones keep their row and no text."""
    fits = F.col("length") <= most
    rows = files.withColumn("_d", F.when(fits, decoded(hint)("content"))).select("*", "_d.*").withColumn("_s", text_structure(F.col("text")))
    text, nul = F.col("text"), F.contains("content", F.lit(b"\x00"))
    replaced = F.contains(text, F.lit("�"))
    extra = F.array_compact(
        F.array(
            F.when(nul, "File contains NUL bytes and may be binary"),
            F.when((F.length(text) > 0) & (F.length(F.regexp_replace(text, r"(?U)\s", "")) == 0), "File holds only white space"),
            F.when(F.col("length") == 0, "File is empty"),
            F.when(~fits, F.concat(F.lit("File size exceeds maximum of "), F.lit(most // 2**20), F.lit(" MB"))),
        )
    )
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), extra)
    converted = (F.col("encoding") != "utf-8") & ~F.contains("encoding", F.lit("replacement"))
    doubts = F.size(F.filter(warnings, lambda w: F.lower(w).rlike("decode|encoding|replacement")))
    quality = F.when(replaced | nul | (doubts > 2), "low").when(~F.col("encoding").isin("utf-8", "ascii"), "medium").otherwise("high")
    listed = F.col("_s.has_numbered_sections") | F.col("_s.has_bullet_points")
    return rows.select(
        "path", "text", F.when(listed, "LIST").otherwise("TEXT").alias("content_type"), F.when(fits, "EXTRACTED").otherwise("FAILED").alias("status"),
        warnings.alias("warnings"), file_hash("content").alias("file_hash"), F.col("length").alias("file_size"), "encoding", "confidence",
        converted.alias("converted"), line_endings(text).alias("line_endings"), F.regexp_count(text, F.lit("\n")).alias("line_count"),
        F.length(text).alias("char_count"), quality.alias("quality"), F.col("_s").alias("structure"),
    )
