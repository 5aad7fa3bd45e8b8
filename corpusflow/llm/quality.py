"""Operator 3: quality rules judged by an isolation forest.

Every document gets the statistics of the usual rules: word counts, symbols, repeated lines and
phrases, capitals and so on. A document that breaks a base rule is rejected. The rest is judged by an
isolation forest: trees of random splits, in which a document whose statistics are odd ends on a
short path. The trees are grown on labelled documents of good quality, each on a small subsample, and
the score from which a document is rejected is calibrated on labelled rows.

The forest is fitted on at most ``FIT_ROWS`` labelled documents (those with the smallest hashes of
their ids); everything else covers all documents and whole texts in a single pass without a shuffle.

Edge cases: a null text has no words, so it breaks the base rule; repeated rows get equal results;
without labelled rows of both kinds there is no threshold and only the base rules reject; an empty
table gives an empty result; other columns are kept by ``kept_documents`` and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import filtered, map_columns, utf8

#: At most so many labelled documents are used to fit the forest and its threshold.
FIT_ROWS = 20_000
TREES = 100
SUBSAMPLE = 256
#: At calibration at most this share of the good labelled documents may be rejected.
GOOD_LOST = 0.002
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words

#: White space between words, and the symbols that are counted.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_per_word", "marks_per_word", "capitals", "repeated_words", "repeated_lines", "word_length", "pipes_per_word", "digits")
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    if n == len(words):
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three ids no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : shift + len(windows)] |= twice
    return int(hit.sum())


def statistics(data: bytes) -> tuple[list[int], list[float]]:
    """The rule statistics of a text (UTF-8), and the forest's features."""
    words = data.split()
    bare = data.translate(None, SPACE)
    n, chars = len(words), len(bare.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    doubled, repeats = len(lines) - len(set(lines)), repeated_words(words)
    upper, lower, digits = (len(data) - len(data.translate(None, x)) for x in (_UPPER, _LOWER, _DIGITS))
    each = max(1, n)
    marks = data.count(b"!") + data.count(b"?")
    features = [symbols / each, marks / each, upper / max(1, upper + lower), repeats / each, doubled / max(1, len(lines)), min(chars / each, 50.0), data.count(b"|") / each, digits / each]
    return [n, chars, symbols, doubled, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


@dataclass
class Forest:
    """Trees as arrays: the split's feature (-1: a leaf), its value, the children, and the path's length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path the higher."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, left, right, length in zip(self.feature, self.value, self.left, self.right, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f[node], 0)] < v[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += length[node]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.norm)


def mean_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: int = 0, trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """Random splits: a feature that still varies, and a value drawn evenly from a little beyond its range.

    Drawing beyond the range of the rows lets a tree cut off values that no row of the sample has,
    which is where anomalous documents lie when the sample holds good ones only.
    """
    random = np.random.default_rng(seed)
    size = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    spread = np.maximum(x.std(axis=0), 1e-3)
    nodes = 2 ** (depth + 2)
    out = [np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes))]
    for t in range(trees):
        stack, used = [(0, x[random.choice(len(x), size, replace=False)], 0)], 1
        while stack:
            node, rows, level = stack.pop()
            if level == depth or len(rows) < 1 or (level and len(rows) == 1 and random.random() < 0.5):
                out[4][t, node] = level + mean_path(len(rows))
                continue
            f = int(random.integers(x.shape[1]))
            low, high = (rows[:, f].min(), rows[:, f].max())
            v = random.uniform(low - 2 * spread[f], high + 2 * spread[f])
            out[0][t, node], out[1][t, node], out[2][t, node], out[3][t, node] = f, v, used, used + 1
            go = rows[:, f] < v
            stack += [(used, rows[go], level + 1), (used + 1, rows[~go], level + 1)]
            used += 2
    return Forest(*out, norm=max(1e-9, mean_path(size)))


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray) -> Forest:
    """Set the threshold: most bad labelled rows above it, at most ``GOOD_LOST`` of the good ones."""
    if good.all() or not good.any():
        return forest
    score = forest.score(x)
    ranked = np.sort(score[good])
    floor = ranked[len(ranked) - 1 - int(GOOD_LOST * len(ranked))]
    above = np.sort(score[~good])
    above = above[above > floor]
    forest.threshold = float(floor + 0.75 * (above[0] - floor)) if len(above) else float(floor)
    return forest


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule statistics, features) of every document."""

    def make():
        def run(ids: list, texts: list) -> list[list]:
            both = [statistics(t or b"") for t in texts]
            return [ids, *([x[0][i] for x in both] for i in range(len(STATISTICS))), [x[1] for x in both]]

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{x} long" for x in STATISTICS)
    return map_columns(docs.select(id_col, utf8(text_col)), make, f"`{id_col}` {kind}, {fields}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 0) -> Forest | None:
    """A forest from at most ``rows`` labelled documents; None where no labelled document is good.

    The ids are a bounded list, so they may be broadcast; the features of that many rows reach the driver.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    near = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    quality = {r.doc_id: r.quality for r in chosen.collect()}
    found = measured(near).where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEATED} * n_words")
    found = found.groupBy("doc_id").agg(F.min("features").alias("features")).toPandas() if quality else None
    if found is None or not len(found):
        return None
    found = found.sort_values("doc_id")
    x = np.array(found["features"].tolist(), float)
    good = np.array([quality[i] == 1 for i in found["doc_id"]])
    if not good.any():
        return None
    return calibrate(grow(x[good], seed), x, good)


def judged(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, rule statistics, base_failed, kept, score) of every document."""

    def make():
        def run(ids: list, texts: list) -> list[list]:
            both = [statistics(t or b"") for t in texts]
            score = forest.score(np.array([x[1] for x in both])) if forest else np.zeros(len(both))
            failed = [base_failed(x[0][0], x[0][4]) for x in both]
            limit = forest.threshold if forest else np.inf
            kept = [not f and s <= limit for f, s in zip(failed, score.tolist(), strict=True)]
            return [ids, *([x[0][i] for x in both] for i in range(len(STATISTICS))), failed, kept, score.tolist()]

        return run

    fields, kind = ", ".join(f"{x} long" for x in STATISTICS), docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs.select("doc_id", utf8("text")), make, f"doc_id {kind}, {fields}, base_failed boolean, kept boolean, score double")


def kept_documents(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, with all their columns; a filter, so no row is shuffled."""

    def make():
        def keeps(texts: list) -> list[bool]:
            both = [statistics(t or b"") for t in texts]
            score = forest.score(np.array([x[1] for x in both])).tolist() if forest else [0.0] * len(both)
            limit = forest.threshold if forest else np.inf
            return [not base_failed(x[0][0], x[0][4]) and s <= limit for x, s in zip(both, score, strict=True)]

        return keeps

    return filtered(docs, utf8("text"), make)
