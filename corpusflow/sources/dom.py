"""A small tree of an HTML document, from the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An element of the first kind ends when one of the second kind begins.
ENDS = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "footer", "header", "pre", "form"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.children))

    def text(self, between: str = "", strip: bool = False) -> str:
        parts = (s.strip() if strip else s for s in self.strings())
        return between.join(p for p in parts if p or not strip)

    def remove(self) -> None:
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)

    def has_class(self, pattern: str) -> bool:
        names = self.attrs.get("class", "")
        return any(re.search(pattern, x) for x in [*names.split(), names] if x)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.now.tag in ENDS and tag in ENDS[self.now.tag]:
            self.now = self.now.parent
            if self.now.tag in ENDS and tag in ENDS[self.now.tag]:  # a cell ends, and its row
                self.now = self.now.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.now
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.now = node.parent

    def handle_data(self, data):
        self.now.children.append(data)


#: An ampersand that begins no reference with its semicolon.
_OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def parse(html: str, closed: bool = False) -> Node:
    """The tree; ``closed``: references without their semicolon (``&amp``, as in text that was cut off) stay as they are written."""
    if closed:
        html = _OPEN.sub("&amp;", html)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
