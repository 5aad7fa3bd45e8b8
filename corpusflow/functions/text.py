"""Helpers with the semantics of ordinary string methods: strip, search, excerpts, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: Unicode's white space, and the four separators below U+0020.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time: it is bound as a lambda's argument.

    What stands inside a lambda is computed for each element, so a costly value must be bound outside.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: str | Column) -> Column:
    """Without white space (any of Unicode's, and the four separators below U+0020) at both ends: only the ends are looked at."""
    return F.btrim(col(c), F.lit(SPACE))


def search(c: str | Column, pattern: str, flags: str = "") -> Column:
    """Whether the pattern occurs; \\d, \\s and \\w are Unicode's, and only \\n ends a line."""
    return F.rlike(col(c), F.lit(f"(?Ud{flags}){pattern}"))


def replace(c: str | Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(col(c), f"(?Ud{flags}){pattern}", by)


def count_of(c: str | Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(col(c), F.lit(f"(?Ud{flags}){pattern}")).cast("long")


def lines(c: str | Column) -> Column:
    return F.split(col(c), "\n", -1)


def excerpt(c: str | Column, n: int = 200) -> Column:
    """The first n characters, with three dots if there are more."""
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def preview(c: str | Column, n: int = 100) -> Column:
    """An excerpt on one line."""
    return excerpt(F.translate(col(c), "\n", " "), n)


def file_hash(content: str | Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(col(content).cast("binary"), 256)


def flatten_content(c: str | Column) -> Column:
    """A model's answer as text: a JSON string, a list of strings and {"text": ...} blocks, or anything else as it is."""
    value = F.try_parse_json(col(c))
    parts = F.from_json(col(c), "array<string>")
    block = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.when(~x.startswith("{"), x), F.lit(""))
    return F.when(F.ltrim(col(c)).startswith("["), F.coalesce(F.array_join(F.transform(parts, block), ""), col(c))).when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    ).otherwise(col(c))
