"""Cleaning of text that was extracted from pages: page numbers, running headers, rules, artefacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.normalize import unified_page_text
from corpusflow.functions.text import col, lines, once, replace, search, strip
from corpusflow.settings import DEFAULTS

#: Lines that are page numbers (matched from their first character on).
PAGE_NUMBERS = [r"\s*\d+\s*$", r"\s*[٠-٩]+\s*$", r"صفحة\s+\d+", r"Page\s+\d+", r"\d+\s*/\s*\d+$", r"[٠-٩]+\s*/\s*[٠-٩]+$"]
#: What is taken out of any line, in this order.
RUNNING = [r"^[\-_=]{3,}$", r"^\s*\|\s*\|\s*$", r"^©.*$", r"^\s*www\.", r"^\s*http[s]?://"]
#: What becomes a single space, in this order.
#: Runs of line feeds go with the first; signs without a width and control characters are one pass, as neither is white space that another rule looks for.
ARTEFACTS = [r"\s{3,}", "[\u200b-\u200d\ufeff\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F]"]

_PAGE_NUMBER = "^(?:" + "|".join(PAGE_NUMBERS) + ")"


def is_page_number(line: Column) -> Column:
    return search(strip(line), _PAGE_NUMBER)


def page_numbers(c: str | Column) -> Column:
    """(line, digits) of each line that is a page number; lines count from 0."""
    numbered = F.transform(lines(c), lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("text")))
    found = F.filter(numbered, lambda s: is_page_number(s["text"]))
    return F.transform(found, lambda s: F.struct(s["line"].alias("line"), F.regexp_extract(s["text"], r"(?U)\d+|[٠-٩]+", 0).alias("digits")))


def repeated_lines(ls: Column, least: int = DEFAULTS.min_line, times: int = DEFAULTS.repeated_lines) -> Column:
    """The stripped lines of at least ``least`` characters that occur ``times`` times: equal neighbours after sorting."""
    ranked = F.array_sort(F.filter(F.transform(ls, strip), lambda x: F.length(x) >= least))
    same = lambda a, b: F.when(a == b, a)
    twice = once(ranked, lambda r: F.zip_with(r, F.slice(r, times, F.greatest(F.size(r), F.lit(1))), same))
    return F.array_distinct(F.filter(twice, lambda x: x.isNotNull()))


def without_repeated(ls: Column, least: int = DEFAULTS.min_line, times: int = DEFAULTS.repeated_lines) -> Column:
    """Lines, without all that repeat."""
    return once(ls, lambda own: once(repeated_lines(own, least, times), lambda r: F.filter(own, lambda x: ~F.array_contains(r, strip(x)))))


def without_running(c: str | Column) -> Column:
    out = col(c)
    for pattern in RUNNING:
        out = replace(out, pattern, "", "m")
    return out


def without_artefacts(c: str | Column) -> Column:
    out = col(c)
    for pattern in ARTEFACTS:
        out = replace(out, pattern, " ")
    return out


def without_short_lines(c: str | Column, least: int = DEFAULTS.min_line) -> Column:
    kept = F.filter(F.transform(lines(c), strip), lambda x: F.length(x) >= least)
    return strip(F.array_join(kept, "\n"))


def cleaned(
    c: str | Column, *, page_lines: bool = True, running: bool = True, artefacts: bool = True, unify: bool = False, least: int = DEFAULTS.min_line
) -> Column:
    """The whole cleaning, in its fixed order. Runs of blank lines become a space, so paragraphs may join."""
    ls = lines(c)
    if page_lines:
        ls = F.filter(ls, lambda x: ~is_page_number(x))
    if running:
        ls = without_repeated(ls, least)
    text = F.array_join(ls, "\n")
    if running:
        text = without_running(text)
    if artefacts:
        text = without_artefacts(text)
    if unify:
        text = unified_page_text(text)
    return without_short_lines(text, least)


def cleaning_stats(before: str | Column, after: str | Column) -> Column:
    """original_length, cleaned_length, reduction_ratio (0 for an empty text), num_pages_detected (null for none)."""
    a, b = F.length(col(before)), F.length(col(after))
    pages = F.size(F.filter(lines(before), is_page_number))
    return F.struct(
        a.alias("original_length"), b.alias("cleaned_length"),
        F.when(a > 0, 1 - b / a).otherwise(F.lit(0.0)).alias("reduction_ratio"),
        once(pages, lambda n: F.when(n > 0, n)).alias("num_pages_detected"),
    )
