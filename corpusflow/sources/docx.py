"""Word files: paragraphs and tables in the order of the document."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import file_hash
from corpusflow.sources.reading import with_read

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OLE = bytes.fromhex("D0CF11E0A1B11AE1")
READ = "text string, content_type string, headings array<string>, heading_levels array<int>, table_count int, paragraph_count int, has_track_changes boolean, warnings array<string>"


def _text(node: ElementTree.Element) -> str:
    """The runs' text; what was deleted under track changes isn't in runs of text. A symbol that names no font is its character, which XML may be unable to hold."""
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif x.tag == f"{_W}sym" and x.get(f"{_W}font") is None and x.get(f"{_W}char"):
            out.append(chr(int(x.get(f"{_W}char"), 16)))
    return "".join(out)


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    return {s.get(f"{_W}styleId", ""): (s.find(f"{_W}name").get(f"{_W}val", "") if s.find(f"{_W}name") is not None else "") for s in root.iter(f"{_W}style")}


def read(data: bytes, mark_tables: bool = True, keep_space: bool = False) -> tuple:
    """What ``READ`` lists. With ``keep_space`` cells aren't stripped, and only ASCII's white space makes a paragraph blank.

    A file is of kind TABLE if tables outnumber half the paragraphs (headings are paragraphs) and the headings.
    """
    if data.startswith(_OLE):
        return "", "TEXT", [], [], 0, 0, False, ["The old .doc format isn't supported; save the file as .docx"]
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        styles = _styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        parts, headings, levels, tables, paragraphs, changed = [], [], [], 0, 0, False
        for node in body if body is not None else []:
            if node.tag == f"{_W}p":
                changed |= any(True for x in node.iter() if x.tag in (f"{_W}del", f"{_W}ins"))
                text = _text(node)
                if not text.strip(" \t\n\r\f" if keep_space else None):
                    continue
                paragraphs += 1
                style = node.find(f"{_W}pPr/{_W}pStyle")
                name = style.get(f"{_W}val", "") if style is not None else ""
                named = next((x for x in (name, styles.get(name, "")) if "heading" in x.lower()), None)
                if named:
                    headings.append(text.strip())
                    ending = re.search(r"(-?\d+)$", named)
                    levels.append(int(ending[1]) if ending else 1)
                    parts.append(f"\n# {text.strip()}\n")
                else:
                    parts.append(text)
            elif node.tag == f"{_W}tbl":
                rows = [[_text(c) if keep_space else _text(c).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
                filled = ["\t".join(r) for r in rows if any(map(str.strip, r))]
                if filled:
                    tables += 1
                    inner = "\n".join(filled)
                    parts.append(f"\n[TABLE {tables}]\n{inner}\n[/TABLE]\n" if mark_tables else inner)
        kind = "TABLE" if tables > max(paragraphs / 2, len(headings)) else "HEADING" if headings else "TEXT"
        return "\n".join(parts), kind, headings, levels, tables, paragraphs, changed, []
    except Exception as error:  # a file that can't be read must not end the job
        return "", "TEXT", [], [], 0, 0, False, [f"Could not read the file: {re.sub(r'\\s+', ' ', str(error))[:200]}"]


def extracted(files: DataFrame, keep_space: bool = False) -> DataFrame:
    hashed = files.select("path", "content", file_hash("content").alias("file_hash"))
    rows = with_read(hashed, "_d", lambda x: read(x or b"", keep_space=keep_space), READ, "content")
    return rows.select("path", F.when(F.size("_d.warnings") > 0, "FAILED").otherwise("EXTRACTED").alias("status"), "file_hash", "_d.*")
