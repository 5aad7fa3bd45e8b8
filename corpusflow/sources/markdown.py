"""Markdown files: the text stays as it is; headers, code, lists, tables, links and images are counted."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import file_hash
from corpusflow.sources.plaintext import decode
from corpusflow.sources.reading import with_read

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ITEM = re.compile(r"^(\s*)(?:([-*+])|(\d{1,9})[.)])\s+\S")
_RULE = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")

READ = (
    "text string, levels array<int>, num_code_blocks int, languages array<string>, has_inline_code boolean, num_ordered int, num_unordered int, "
    "has_nested_lists boolean, num_tables int, num_links int, num_images int, warnings array<string>"
)


def read(data: bytes) -> tuple:
    """One pass over the lines: fences first, as nothing within them counts."""
    text, _, _, warnings = decode(data)
    levels, languages, fences, ordered, unordered, tables, nested = [], [], 0, 0, 0, 0, False
    fence, open_lists, before, prose = None, [], "", []
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
            continue
        if mark:
            fence, info = mark[1], mark[2].split()
            fences += 1
            if info and info[0].lower() not in languages:
                languages.append(info[0].lower())
            continue
        prose.append(line)
        item = _ITEM.match(line)
        if head := re.match(r"^ {0,3}(#{1,6})(\s|$)", line):
            levels.append(len(head[1]))
        elif before.strip() and not _ITEM.match(before) and not re.match(r"^ {0,3}#", before) and (under := re.match(r"^ {0,3}(=+|-+)\s*$", line)):
            levels.append(1 if under[1][0] == "=" else 2)
        elif "|" in before and "|" in line and _RULE.match(line):
            tables += 1
        if item:
            indent, kind = len(item[1].expandtabs(4)), "o" if item[3] else "u" + item[2]
            while open_lists and open_lists[-1][0] > indent:
                open_lists.pop()
            if not open_lists or indent >= open_lists[-1][0] + 2 or open_lists[-1][1] != kind:
                nested |= bool(open_lists) and indent >= open_lists[-1][0] + 2
                if open_lists and indent < open_lists[-1][0] + 2:
                    open_lists.pop()
                open_lists.append((indent, kind))
                ordered, unordered = ordered + (kind == "o"), unordered + (kind != "o")
        elif line.strip() and not line.startswith((" ", "\t")) and not before.strip():
            open_lists = []
        before = line
    rest = "\n".join(prose)
    images = len(re.findall(r"!\[[^\]]*\]\([^)]*\)", rest))
    links = len(re.findall(r"(?<!!)\[[^\]]*\]\([^)]*\)", rest)) + len(re.findall(r"<https?://[^>\s]+>", rest))
    return text, levels, fences, sorted(languages), bool(re.search(r"(?<!`)`[^`\n]+`(?!`)", rest)), ordered, unordered, nested, tables, links, images, warnings


def extracted(files: DataFrame) -> DataFrame:
    hashed = files.select("path", "content", file_hash("content").alias("file_hash"))
    rows = with_read(hashed, "_d", lambda x: read(x or b""), READ, "content").select("*", "_d.*")
    at = lambda n: F.size(F.filter("levels", lambda x: x == n))
    sections: Column = at(1) + at(2)
    lists = F.col("num_ordered") + F.col("num_unordered")
    kind = F.when(F.col("num_code_blocks") > 0, "CODE").when(sections >= 2, "HEADING").when(lists > 0, "LIST").when(F.col("num_tables") > 0, "TABLE").otherwise("TEXT")
    quality = F.when(F.size("warnings") == 0, "high").when(F.size("warnings") <= 2, "medium").otherwise("low")
    has = (F.size("levels") > 0) | (lists > 0) | (F.col("num_tables") > 0) | (F.col("num_code_blocks") > 0)
    return rows.select(
        "path", "text", kind.alias("content_type"), F.lit("EXTRACTED").alias("status"), "warnings", "file_hash",
        F.struct(*(at(n).alias(f"h{n}") for n in range(1, 7))).alias("headers"), F.array_min("levels").alias("min_level"), F.array_max("levels").alias("max_level"),
        sections.alias("num_sections"), "num_code_blocks", "languages", "has_inline_code", "num_ordered", "num_unordered", "has_nested_lists", "num_tables",
        "num_links", "num_images", (F.regexp_count("text", F.lit("\n")) + 1).alias("line_count"), quality.alias("quality"), has.alias("has_structure"),
    )
