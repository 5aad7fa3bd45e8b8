"""Vectors as arrays: dot products, norms, similarities, and the default embedding of a text."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col, once
from corpusflow.settings import DEFAULTS


def dot(a: str | Column, b: str | Column) -> Column:
    """Summed in double precision."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: str | Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    scaled = lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
    return once(col(a), scaled)


def cosine(a: str | Column, b: str | Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def mapped_similarity(s: str | Column) -> Column:
    """A cosine or score as a similarity: negative ones are halved towards 0, others are at most 1."""
    return F.when(col(s) < 0, (col(s) + 1) / 2).otherwise(F.least(col(s), F.lit(1.0)))


def words(c: str | Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(col(c)), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


#: Words that a task remembers with their places.
_KNOWN = 120_000


def _embed(dim: int):
    apart = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))

    def run(texts: pa.Array) -> pa.Array:
        known: dict[bytes, int | None] = {}

        def place(part: bytes) -> int | None:
            """The place of what stands between two ASCII signs; None if other signs make it no word or several."""
            if part not in known:
                if len(known) >= _KNOWN:
                    known.clear()
                found = re.findall(r"[^\W_]+", part.decode())
                known[part] = zlib.crc32(part) % dim if found == [part.decode()] else None
            return known[part]

        places, sizes = [], []
        for text in texts.to_pylist():
            low = (text or "").lower()
            own = [*map(place, low.encode().translate(apart).split())]
            if None in own:
                own = [zlib.crc32(w.encode()) % dim for w in re.findall(r"[^\W_]+", low)]
            places += own
            sizes.append(len(own))
        n = len(sizes)
        v = np.bincount(np.repeat(np.arange(n) * dim, sizes) + np.asarray(places, np.int64), minlength=n * dim).reshape(n, dim).astype(np.float64)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        v /= np.where(length > 0, length, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(v.ravel()))

    return run


def hashed_embedding(c: str | Column, dim: int = DEFAULTS.embedding_dim) -> Column:
    """The default embedding: word counts hashed into ``dim`` places, at length 1. No model, no network.

    Like a real model it is a vectorized UDF: it runs over Arrow batches.
    """
    return F.arrow_udf(_embed(dim), "array<double>")(col(c))


def overlap_score(query: str | Column, text: str | Column) -> Column:
    """The default reranking score: the share of the query's distinct words that the text has."""
    q = F.array_distinct(words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(F.lit(0.0))
