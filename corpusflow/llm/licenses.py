"""Operator 9: license scans with a generalised suffix automaton.

One automaton over the words of all license templates recognises every stretch of every template.
A file's words are streamed through it: after each word it knows the longest stretch that ends there
and occurs in a template (the matching statistics). Stretches that can't be extended and have at
least ``LEAST`` words are located in their templates and chained, in the order of both the file and
the template, into covered spans; a template of which enough is covered labels the file.

Besides, four fixed phrases are searched word by word; their labels always stay.

Edge cases: null and empty texts have no words and no labels; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from corpusflow.llm.common import map_columns, utf8
from corpusflow.llm.decontam import words_of

#: The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The notices that licenses ask to be put into files, as published.
TEMPLATES = {
    "mit-notice": "released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-4.0-notice": "licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: A match has at least so many words; a label needs this share of its template's words.
LEAST = 4
COVERED = 0.6
#: Words of the file that may lie between two matches of a chain.
GAP = 50


@dataclass
class Automaton:
    """Generalised suffix automaton: states with transitions, suffix links, lengths, and ends of their stretches."""

    ids: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    lengths: list[int] = field(default_factory=list)

    def _state(self, size: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for the stretches that p can be extended to."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return new

    def add(self, words: list[bytes]) -> None:
        template, last = len(self.lengths), 0
        self.lengths.append(len(words))
        marks = []
        for i, w in enumerate(words):
            last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
            marks.append((last, i))
        for state, i in marks:
            self.ends[state].add((template, i))

    def finish(self) -> Automaton:
        """A stretch ends wherever a longer one with it as a suffix ends."""
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        return self


def automaton(templates: dict[str, str] = TEMPLATES) -> Automaton:
    out = Automaton()
    for text in templates.values():
        out.add(words_of(text.encode()))
    return out.finish()


def matches(auto: Automaton, ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(end place, length, state) of each match that can't be extended to the right.

    Only runs of template words are streamed: any other word leads back to the start.
    """
    known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
    starts, stops = known[::2], known[1::2]
    long = stops - starts >= least
    out = []
    for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
        state = length = 0
        for place, word in enumerate(ids[start:stop].tolist(), start):
            was = (place - 1, length, state)
            while state and word not in auto.next[state]:
                state = auto.link[state]
                length = auto.size[state]
            if word in auto.next[state]:
                state, length = auto.next[state][word], length + 1
            if length <= was[1] and was[1] >= least:
                out.append(was)
        if length >= least:
            out.append((stop - 1, length, state))
    return out


def chains(auto: Automaton, found: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """The best chain of each template: (covered words, first and last word in the file).

    A match follows another if it is later in the file, by at most ``GAP`` words, and later in the
    template; where they overlap only what is new counts.
    """
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for end, length, state in found:
        for template, place in auto.ends[state]:
            pieces.setdefault(template, []).append((end - length + 1, end, place))
    best = {}
    for template, own in pieces.items():
        own.sort()
        open_: list[tuple[int, int, int, int, int]] = []  # end in the file, end in the template, covered, start, best
        top = (0, 0, 0)
        for start, end, place in own:
            size = end - start + 1
            covered, first = size, start
            open_ = [c for c in open_ if start - c[0] <= GAP]
            for c_end, c_place, c_covered, c_first, _ in open_:
                if c_end < end and c_place < place:
                    new = min(size, end - c_end, place - c_place)
                    if c_covered + new > covered:
                        covered, first = c_covered + new, c_first
            open_.append((end, place, covered, first, 0))
            if (covered, -(end - first)) > (top[0], -(top[2] - top[1])):
                top = (covered, first, end)
        best[template] = top
    return best


class Scan:
    """The scan of one text."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.auto, self.names = automaton(templates), list(templates)
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

    def base(self, words: list[bytes]) -> dict[str, list[int]]:
        """The places of each label's phrase."""
        text, out = b" " + b" ".join(words) + b" ", {}
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])  # where the space before each word stands
        for phrase, label in self.phrases:
            found, at = [], text.find(phrase)
            while at >= 0:
                found.append(at)
                at = text.find(phrase, at + 1)
            if found:
                out[label] = np.searchsorted(begins, found).tolist()
        return out

    def spans(self, words: list[bytes]) -> dict[str, tuple[int, int, int]]:
        """Each template with its best chain in the text."""
        ids = np.fromiter(map(self.auto.ids.get, words, _minus()), np.int64, len(words))
        return {self.names[t]: c for t, c in chains(self.auto, matches(self.auto, ids)).items()}

    def share(self, name: str, chain: tuple[int, int, int]) -> float:
        return min(1.0, chain[0] / self.auto.lengths[self.names.index(name)])


def _minus():
    from itertools import repeat

    return repeat(-1)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document.

    ``score`` is the largest share of a template that is covered. ``spans`` lists, for each template
    with a match, its name, its first and last word in the file, and the number of its words covered.
    """
    templates = TEMPLATES if templates is None else templates

    def make():
        scan = Scan(templates)

        def one(data: bytes) -> tuple:
            words = words_of(data)
            places, found = scan.base(words), scan.spans(words)
            at = sorted(i for own in places.values() for i in own)
            shares = {name: scan.share(name, c) for name, c in found.items()}
            labels = sorted({*places, *(n for n, s in shares.items() if s >= COVERED)})
            spans = [{"template": n, "first_word": c[1], "last_word": c[2], "covered": c[0]} for n, c in sorted(found.items())]
            return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(places)), ",".join(labels), max(shares.values(), default=0.0), spans

        def run(ids: list, texts: list) -> list[list]:
            return [ids, *(list(c) for c in zip(*(one(t or b"") for t in texts), strict=True))]

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<template: string, first_word: long, last_word: long, covered: long>>"
    return map_columns(docs.select("doc_id", utf8("text")), make, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {span}")
