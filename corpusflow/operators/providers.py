"""Pluggable models: embeddings, rerankers and generators, each with a default that needs no network.

The defaults are lexical baselines, not neural models. A provider is a function of columns, so a
pandas UDF around any model fits; it is registered under a name and chosen by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.chunk import row_chunks, sentence_chunks
from corpusflow.functions.text import excerpt
from corpusflow.functions.vector import hashed_embedding, overlap_score

EMBEDDINGS: dict[str, Callable[[Column], Column]] = {"hash": hashed_embedding}
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_score}
GENERATORS: dict[str, Callable[[Column, Column], Column]] = {"extract": lambda query, context: excerpt(context, 500)}
#: Text to an array of texts.
CHUNKERS: dict[str, Callable[[Column], Column]] = {"sentence": sentence_chunks, "row": row_chunks}
#: By format; ``sources.files`` puts its own in.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def _get(table: dict, name: str, what: str):
    if name not in table:
        raise ValueError(f"unknown {what}: {name}; known: {sorted(table)}")
    return table[name]


def embedding(name: str = "hash") -> Callable[[Column], Column]:
    return _get(EMBEDDINGS, name, "embedding provider")


def scorer(name: str = "overlap") -> Callable[[Column, Column], Column]:
    return _get(SCORERS, name, "reranker")


def generator(name: str = "extract") -> Callable[[Column, Column], Column]:
    return _get(GENERATORS, name, "generator")


def chunker(name: str) -> Callable[[Column], Column]:
    return _get(CHUNKERS, name, "chunker")


def register(kind: str, name: str, function: Callable) -> None:
    """Add a provider; ``kind`` is embedding, reranker, generator, chunker or extractor."""
    tables = {"embedding": EMBEDDINGS, "reranker": SCORERS, "generator": GENERATORS, "chunker": CHUNKERS, "extractor": EXTRACTORS}
    _get(tables, kind, "kind of provider")[name] = function


def embedded(texts: Column, name: str = "hash") -> Column:
    """Embeddings of a column, row by row: a text that can't be embedded is null in its own row and moves no other."""
    return embedding(name)(texts)
