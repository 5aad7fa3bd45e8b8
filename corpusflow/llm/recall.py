"""Recall and precision of the near-duplicate search of ``corpusflow.llm.neardup`` before its exact verification.

Pairs of random shingle sets at a given Jaccard similarity; printed is the share of pairs that meet in
the index and within ``DISTANCE``: what the exact verification then gets to see.

    python -m corpusflow.llm.recall
"""

from __future__ import annotations

import numpy as np

from corpusflow.llm import neardup


def found(size: int, similarity: float, trials: int, seed: int = 0) -> float:
    """The share of pairs of sets of ``size`` shingles that reach the verification."""
    r = np.random.default_rng(seed)
    shared = int(np.ceil(2 * size * similarity / (1 + similarity)))
    hits = 0
    for _ in range(trials):
        common = r.integers(0, 2**64, shared, np.uint64)
        both = [np.concatenate([common, r.integers(0, 2**64, size - shared, np.uint64)]) for _ in range(2)]
        majorities = np.stack([neardup.bit_majorities(s) for s in both])
        differ = (majorities[0] > 0) != (majorities[1] > 0)
        a, b = neardup.ball(*neardup.segments(majorities))
        hits += bool(np.isin(a, b).any() and differ.sum() <= neardup.DISTANCE)
    return hits / trials


if __name__ == "__main__":
    print("similarity | sets of 20, 100, 400 shingles: share of pairs found")
    for similarity in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95):
        print(similarity, *(round(found(size, similarity, 2000), 4) for size in (20, 100, 400)))
