"""HTML files and pages: what is read off the tree is small; counts, types and quality are columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import count_of, file_hash
from corpusflow.sources.dom import Node, parse
from corpusflow.sources.plaintext import BULLETS, NUMBERED
from corpusflow.sources.reading import with_read

#: Elements that hold no content.
STRIPPED = ["script", "style", "noscript", "iframe", "nav", "footer", "header", "aside", "form", "button", "input", "textarea", "select", "svg", "canvas", "video", "audio", "meta", "link", "base"]
#: Fixed values of crawled pages: elements and classes that go, classes of the main content.
PAGE_STRIPPED = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe"]
PAGE_CLASSES, MAIN_CLASSES = r"nav|menu|footer|header|sidebar|ad|cookie", r"content|main|body"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_ARABIC = re.compile("[؀-ۿݐ-ݿ]")

EXTRACT = (
    "text string, encoding string, title string, meta map<string,string>, is_rtl boolean, headings array<struct<level:int,text:string,tag:string>>, "
    "links array<struct<url:string,text:string>>, num_tables int, num_lists int, num_paragraphs int, warnings array<string>"
)


def encoding_of(data: bytes, fallback: str = "utf-8") -> str:
    """A mark, else what the first bytes declare, else the fallback."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    found = re.search(rb"charset=[\"']?([\w-]+)", data[:2048].lower())
    return found[1].decode() if found else fallback


def head_of(tree: Node) -> tuple[str | None, dict[str, str]]:
    title, meta = tree.first("title"), {}
    for m in tree.all("meta"):
        name = m.attrs.get("name", "").lower()
        if name in ("description", "author", "keywords", "language") and m.attrs.get("content"):
            meta[name] = m.attrs["content"]
        elif m.attrs.get("property", "").lower() == "og:title" and m.attrs.get("content"):
            meta["og_title"] = m.attrs["content"]
    return title.text().strip() if title else None, meta


def right_to_left(tree: Node) -> bool:
    if any(n.attrs.get("dir", "").lower() == "rtl" for n in tree.all("html", "body")):
        return True
    return len(_ARABIC.findall(tree.text()[:1000])) > 50


def linearise(table: Node) -> str:
    """Rows of a table, the header cells first; empty without any filled cell."""
    rows = []
    for tr in table.all("tr"):
        cells = [f"[HEADER: {x}]" for c in tr.all("th") if (x := c.text(" ", True))] + [x for c in tr.all("td") if (x := c.text(" ", True))]
        if cells:
            rows.append(" | ".join(cells))
    return "\n[TABLE]\n" + "\n".join(rows) + "\n[/TABLE]\n" if rows else ""


def tidy(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", text))
    return "\n".join(x.strip() for x in text.split("\n")).strip()


def read(data: bytes, closed: bool = False) -> tuple:
    """What is read off one file; see ``dom.parse`` for ``closed``."""
    name, warnings = encoding_of(data), []
    try:
        html = data.decode(name)
    except (UnicodeDecodeError, LookupError):
        html = data.decode("utf-8", "replace")
        warnings.append(f"Could not decode as {name}")
    tree = parse(html.removeprefix("﻿"), closed)
    title, meta = head_of(tree)
    rtl = right_to_left(tree)
    for node in tree.all(*STRIPPED):
        node.remove()
    headings = [{"level": int(t[1]), "text": x, "tag": t} for t in HEADINGS for n in tree.all(t) if (x := n.text().strip())]
    links = [{"url": n.attrs["href"], "text": n.text().strip()} for n in tree.all("a") if n.attrs.get("href")]
    lists, paragraphs, count = len(tree.all("ul", "ol")), len(tree.all("p")), 0
    for table in tree.all("table"):
        as_text = linearise(table)
        if as_text:
            count += 1
            table.children = [as_text]
    text = tidy((tree.first("body") or tree).text(" "))
    if not text:
        warnings.append("No text was found")
    return text, name, title, meta, rtl, headings, links, count, lists, paragraphs, warnings


def content_type(tables: Column, lists: Column, headings: Column) -> Column:
    return F.when(tables > 0, "TABLE").when(lists > 0, "LIST").when(headings > 0, "HEADING").otherwise("TEXT")


def extracted(files: DataFrame, closed: bool = False) -> DataFrame:
    """(path, text, content_type, title, …) of HTML files, with structure and quality; see ``dom.parse`` for ``closed``."""
    hashed = files.select("path", "content", file_hash("content").alias("file_hash"))
    rows = with_read(hashed, "_d", lambda x: read(x or b"", closed), EXTRACT, "content").select("*", "_d.*")
    text, h = F.col("text"), F.size("headings")
    has = (h > 0) | (F.col("num_lists") > 0) | (F.col("num_tables") > 0)
    quality = F.struct(
        F.length(text).alias("text_length"), F.length(text).alias("char_count"), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("word_count"),
        h.alias("heading_count"), F.size("links").alias("link_count"), F.col("num_tables").alias("table_count"), has.alias("has_structure"),
    )
    return rows.select(
        "path", "text", content_type(F.col("num_tables"), F.col("num_lists"), h).alias("content_type"), F.lit("EXTRACTED").alias("status"), "warnings",
        "file_hash", "encoding", "title", "meta", "is_rtl", "headings", "links", "num_lists", "num_tables", "num_paragraphs",
        count_of(text, BULLETS, "m").alias("num_bullet_items"), count_of(text, NUMBERED, "m").alias("num_numbered_items"), quality.alias("quality"),
    )


def page(html: str) -> tuple[str, str]:
    """Title and main content of a crawled page."""
    tree = parse(html)
    og = next((m.attrs["content"] for m in tree.all("meta") if m.attrs.get("property") == "og:title" and m.attrs.get("content")), None)
    title, h1 = tree.first("title"), tree.first("h1")
    name = og if og is not None else title.text().strip() if title else h1.text().strip() if h1 else "Untitled"
    for node in tree.all(*PAGE_STRIPPED):
        node.remove()
    for node in [n for n in tree.walk() if n.has_class(PAGE_CLASSES)]:
        node.remove()
    main = tree.first("main") or tree.first("article") or next((n for n in tree.walk() if n.has_class(MAIN_CLASSES)), None)
    main = main or next((n for n in tree.all("div") if "container" in n.attrs.get("class", "").split()), None) or tree.first("body")
    return name, main.text("\n", True) if main else ""


def pages(table: DataFrame) -> DataFrame:
    """(page_id, url, title, content) of a table of crawled pages."""
    return with_read(table.select("page_id", "url", "html"), "_p", lambda x: page(x or ""), "title string, content string", "html").select("page_id", "url", "_p.*")
