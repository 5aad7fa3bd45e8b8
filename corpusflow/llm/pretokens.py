"""Exact byte-level BPE at the speed of a bare merge loop.

The tokenizers library follows the given ``.json`` file at about 1 MB a second. Where a text holds only
characters on which all regular expression engines agree (``_PLAIN``), the merge loop of the tiktoken
library gives the same ids at ten times that speed. It picks, at each step, the neighbours whose
joined bytes are the token with the least id; the file lists pairs to merge, in order. Both agree on
every text if ids follow the order of the merges and each token, encoded by itself, is that token: a
pair that isn't in the file but spells a token could only come up where the file's merges leave
that token's own bytes in two parts. ``Encoder`` checks both when it is made, and otherwise leaves all to the library.

A byte-level pre-tokenizer joins a single space to the letters, digits or signs that follow it, but white
space to white space: of a run of white space all but the last character is one pre-token. So a text may be cut before
a space that stands between two characters that aren't white space (any of Unicode's), and only there; the pieces' tokens,
put together, are the text's tokens. Texts with other characters are cut so, and only the pieces that hold such
characters go to the tokenizers library.

``Units`` numbers the distinct pieces of many texts at once with Arrow.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Largest number of entries of each table of pieces that a worker keeps.
TABLE_ENTRIES = 120_000
#: Longer pieces are encoded each time; so a table's size in bytes is bounded too.
KEPT_CHARS = 64

#: The pre-tokenizer's pattern, and the characters on which engines agree about its classes.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ɏ]*")
#: Python's white space has four separators more than the pattern's engine; next to them no text is cut, which is always right.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The same class for Arrow: a space next to any white space.
_MIXED = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Characters of text that are numbered at once.
GROUP_CHARS = 1 << 23


@lru_cache(maxsize=4)
def library(path: str) -> Any:
    """The tokenizer of a ``.json`` file, read once in each worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be printed, else the next free one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def cut(text: str) -> list[str]:
    """The text in pieces whose tokens are independent of each other."""
    if not text:
        return []
    parts = text.split(" ")
    if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
        return [parts[0], *[" " + x for x in parts[1:]]]
    at = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def groups(texts: list[str | None], chars: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts in groups of about ``chars`` characters, each with the number of texts before it; null is empty."""
    first, held, size = 0, [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > chars:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


class Units:
    """The pieces of a group of texts: ``distinct`` ones, the number of each place's piece, and where each text ends.

    Most texts have single spaces between words only and are split by Arrow; the rest are cut one by one.
    """

    def __init__(self, texts: list[str]):
        column = pa.array(texts, pa.string())
        tests = (pc.match_substring_regex(column, _MIXED), pc.starts_with(column, " "), pc.ends_with(column, " "), pc.equal(column, ""))
        odd = np.logical_or.reduce([t.to_numpy(zero_copy_only=False) for t in tests])
        parts = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded = parts.flatten().dictionary_encode()
        ends = parts.offsets.to_numpy()
        # a piece that isn't its text's first begins with a space: even numbers; the first ones: odd numbers
        codes = 2 * coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes[ends[:-1]] += 1
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[codes] = True
        words = coded.dictionary.to_pylist()
        kept = np.flatnonzero(used)
        self.distinct = [words[k >> 1] if k & 1 else " " + words[k >> 1] for k in kept.tolist()]
        codes = (np.cumsum(used) - 1)[codes]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = np.diff(ends)
        if not odd.any():
            self.codes, self.ends = codes, np.concatenate([[0], np.cumsum(sizes)])
            return
        cuts = {k: cut(texts[k]) for k in np.flatnonzero(odd).tolist()}
        numbers = {u: n for n, u in enumerate(self.distinct)}
        for k, own in cuts.items():
            sizes[k] = len(own)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.empty(self.ends[-1], np.int64)
        self.codes[np.repeat(~odd, sizes)] = codes
        self.codes[np.repeat(odd, sizes)] = np.fromiter((numbers.setdefault(u, len(numbers)) for u in chain.from_iterable(cuts.values())), np.int64)
        self.distinct = list(numbers)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text, the sum over its places of the value of the place's piece."""
        total = np.concatenate([[0], np.cumsum(values[self.codes])])
        return total[self.ends[1:]] - total[self.ends[:-1]]


class Encoder:
    """Token ids and token counts of texts, as the tokenizers library has them by default, without added special tokens."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.core = self._core()
        self.rare = Table(lambda piece: np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes())

    def _core(self) -> Any:
        """The merge loop, or nothing where it might not give what the file says."""
        from tiktoken._tiktoken import CoreBPE

        file = json.loads(self.tokenizer.to_str())
        model, pre = file["model"], file["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials} if model["type"] == "BPE" else {}
        made = [vocab.get(a + b, -1) for a, b in merges]
        byte_level = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True) and not file["normalizer"]
        if not byte_level or not all(a < b for a, b in zip([-1, *made], made)) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        bytes_of = {letter: b for b, letter in _byte_letters().items()}
        if set(vocab) != {*bytes_of, *(a + b for a, b in merges)} or any([x.id for x in self.tokenizer.model.tokenize(t)] != [i] for t, i in vocab.items()):
            return None
        return CoreBPE({bytes(bytes_of[c] for c in t): i for t, i in vocab.items()}, {}, _PATTERN)

    def _merged(self, text: str) -> bytes:
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set()), np.uint32).astype("<u4").tobytes()

    def _stretch(self, text: str) -> bytes:
        """The packed ids of a text without special strings."""
        if self.core is None:
            return self.rare[text]
        if _PLAIN.fullmatch(text):
            return self._merged(text)
        runs = groupby(cut(text), lambda piece: _PLAIN.fullmatch(piece) is not None)
        return b"".join(self._merged("".join(run)) if plain else b"".join(map(self.rare.__getitem__, run)) for plain, run in runs)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; special strings count as the library's default has it."""
        stretches, found = self.stretches(text or "")
        out = [self._stretch(stretches[0])]
        for special, stretch in zip(found, stretches[1:]):
            out += [self.specials[special].to_bytes(4, "little"), self._stretch(stretch)]
        return b"".join(out)

    def count(self, piece: str) -> int:
        """The number of tokens of a piece without special strings."""
        return len(self._stretch(piece)) // 4

    def stretches(self, text: str) -> tuple[list[str], list[str]]:
        """A text's stretches between special strings, and the special strings in it."""
        if self.special is None or not self.special.search(text):
            return [text], []
        found = self.special.split(text)
        return found[0::2], found[1::2]


class Table(dict):
    """A dictionary that makes what it lacks and remembers about ``TABLE_ENTRIES`` entries.

    When half of that is new, what hasn't been asked for since goes. Long keys are made each time.
    """

    def __init__(self, make: Callable[[str], Any]):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEPT_CHARS:
                return value
        if 2 * len(self) >= TABLE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """The encoder of a file, made once in each worker."""
    return Encoder(path)
