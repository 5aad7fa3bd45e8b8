"""What a text looks like: tables, lists, headers, its content type, whether it came from a PDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col, lines, once, search, strip
from corpusflow.settings import DEFAULTS

#: Signs of tables anywhere, and of list items at the start of a line.
TABLE_SIGNS = [r"\|.*\|", r"[-─]{3,}", r"\t.*\t"]
ITEM_SIGNS = [r"^\s*[-•*]", r"^\s*\d+[.)]\s", r"^\s*[٠-٩]+[.)]\s"]
LETTER_ITEM = r"^\s*[أ-ي][.)]\s"
#: Signs of a text that was extracted from a PDF.
PDF_SIGNS = [r"Page\s+\d+", r"صفحة\s+\d+", r"\|.*\|.*\|", r"[\n\r]{3,}"]
#: Chunk sizes by content type.
CHUNK_SIZES = {"table": 250, "list": 300, "header": 150, "text": 400}
#: Fixed value: characters that end a sentence, so no header ends with them.
STOPS = ".؟!،"


def _any(c: Column, patterns: list[str]) -> Column:
    return search(c, "(?:" + "|".join(patterns) + ")")


def header_positions(c: str | Column) -> Column:
    """Lines (from 0) of 11 to 79 characters that end no sentence and stand before a blank line."""
    after = F.slice(lines(c), 2, F.greatest(F.size(lines(c)) - 1, F.lit(0)))

    def is_header(line: Column, following: Column) -> Column:
        return once(strip(line), lambda s: F.length(s).between(11, 79) & ~F.substring(s, -1, 1).isin(*STOPS)) & (strip(F.coalesce(following, F.lit("x"))) == "")

    marked = F.transform(F.zip_with(lines(c), after, is_header), lambda head, i: F.when(head, i.cast("int")))
    return F.filter(marked, lambda i: i.isNotNull())


def structure(c: str | Column) -> Column:
    """has_tables, has_lists, has_headers, section_count, header_positions."""

    def made(at: Column) -> Column:
        return F.struct(
            _any(col(c), TABLE_SIGNS).alias("has_tables"),
            F.exists(lines(c), lambda x: _any(x, [*ITEM_SIGNS, LETTER_ITEM])).alias("has_lists"),
            (F.size(at) > 0).alias("has_headers"), F.size(at).alias("section_count"), at.alias("header_positions"),
        )

    return once(header_positions(c), made)


def content_type(c: str | Column) -> Column:
    """table: at least 4 bars or 4 tabs; list: over 0.3 of the lines are items; else text."""
    ls = lines(c)
    items = F.size(F.filter(ls, lambda x: _any(x, ITEM_SIGNS)))
    of = lambda sign: F.length(col(c)) - F.length(F.replace(col(c), F.lit(sign)))
    return F.when((of("|") >= 4) | (of("\t") >= 4), "table").when(items / F.size(ls) > 0.3, "list").otherwise("text")


def chunk_size(kind: str | Column, dynamic: bool = True, fixed: int = DEFAULTS.chunk_size) -> Column:
    """The chunk size for a content type; the same for all if sizes aren't dynamic."""
    if not dynamic:
        return F.lit(fixed)
    out = F.lit(DEFAULTS.chunk_size)
    for name, n in CHUNK_SIZES.items():
        out = F.when(col(kind) == name, n).otherwise(out)
    return out


def is_pdf(text: str | Column, source: str | Column | None = None, kind: str | Column | None = None) -> Column:
    """From a PDF by its name or declared type, else by at least two of four signs in the text."""
    signs = sum((F.when(search(text, p), 1).otherwise(0) for p in PDF_SIGNS), F.lit(0))
    out = signs >= 2
    if kind is not None:
        out = (F.lower(F.coalesce(col(kind), F.lit(""))) == "pdf") | out
    if source is not None:
        out = F.lower(F.coalesce(col(source), F.lit(""))).endswith(".pdf") | out
    return out
