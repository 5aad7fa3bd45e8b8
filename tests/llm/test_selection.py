"""Hard negatives and the filter audit, each against a plain version on tables with the awkward cases."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from corpusflow.llm import filters, negatives


def plain_negatives(rows):
    own = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(256 * x) for x in v])
        own[i] = min(own.get(i, one), one)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1]))
    for a in own:
        if a % 50:
            continue
        ranked = sorted((-score(a, b), b) for b in own if b != a)
        for p, positive in [(p, b) for p, b in ranked if own[b][0] == own[a][0]][:5]:
            fit = [(n, b) for n, b in ranked if own[b][0] != own[a][0] and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, positive, r, b, -p, -n) for r, (n, b) in enumerate(fit, 1)]
    return sorted(out)


def embedded(spark, rows):
    return spark.createDataFrame([(i, l, v, 1, 2.0, "x") for i, l, v in rows], "vec_id long, label int, embedding array<double>, id int, score double, cell string").repartition(3)


@pytest.fixture
def small_index(monkeypatch):
    """Many cells, blocks and leaves over few rows."""
    for name, value in {"SAMPLE": 64, "CELL": 40, "BLOCK": 30, "LEAF": 4, "GROUP": 7}.items():
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, small_index, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 5))
    rows = [(int(i), int(r.integers(4)), (centres[r.integers(4)] + r.normal(scale=0.4, size=5)).tolist()) for i in range(0, 1200, 1 + seed)]
    same = centres[0].tolist()
    rows += [(2000 + i, int(i % 3), same) for i in range(150)]  # one vector many times
    rows += rows[:20] + [(50, 3, same)]  # repeated rows, and an id with two vectors
    rows += [(3000, None, same), (3050, 1, None), (3100, 1, [1.0, None]), (3150, 1, [math.nan] * 5), (3200, 1, [math.inf] * 5), (None, 1, same), (3250, 1, []), (3300, 2, [1.0, 2.0]), (3350, 2, [0.0] * 5), (3400, 77, same)]
    out = negatives.hard_negatives(embedded(spark, rows))
    got = sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == plain_negatives(rows) and len(got) > 150
    assert dict(out.dtypes)["rank"] == "int"


def test_hard_negatives_beyond_double_precision(spark, small_index):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in r.integers(1 << 20, 1 << 21, 4)]) for i in range(300)]
    got = sorted(map(tuple, negatives.hard_negatives(embedded(spark, rows)).collect()))
    assert got == plain_negatives(rows) and got


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(embedded(spark, [])).count() == 0
    assert negatives.hard_negatives(embedded(spark, [(0, 1, [1.0]), (1, 1, [1.0])])).count() == 0


def test_a_block_is_searched_completely_and_stops_early():
    r = np.random.default_rng(3)
    v = np.concatenate([r.integers(-20, 20, (300, 3)), r.integers(180, 220, (300, 3))])
    space = negatives.Space(3, float((v * v).sum(axis=1).max()))
    block = negatives.Block.made(np.arange(600), r.integers(0, 2, 600), v, space)
    q = negatives.Queries(np.array([999]), np.array([0]), np.array([[10, 10, 10]]), np.array([[-(10**9)]]), np.array([[10**9]]))
    seen = []
    fits = negatives.Queries.fitting
    negatives.Queries.fitting = lambda self, ids, labels, same: seen.append(len(ids)) or fits(self, ids, labels, same)
    try:
        found = negatives.search_block(block, q, space, 3, same=False)
    finally:
        negatives.Queries.fitting = fits
    other = block.labels != 0
    want = sorted(zip(-(block.vectors[other] @ [10, 10, 10]), block.ids[other]))[:3]
    assert [(-s, i) for s, i in found[:, 2:]] == [tuple(map(int, x)) for x in want]
    assert sum(seen) < 600  # leaves whose scores can't reach the three found aren't visited


def plain_audit(docs, labels):
    first, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    masks = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        masks.append((source or "", {f for f in fails if fails[f]}, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [m for m in mine if f in m[1] and not m[1] & before]
                total[f] += len(gone)
                out[part, order, step] = [sum(not m[1] & (before | {f}) for m in mine), len(gone), sum(f in m[1] and bool(m[1] & before) for m in mine), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(4)
    word = lambda: r.choice(["Stone", "river", "LIGHT", "house", "#x", "cloud", "100%", "größe", "中文", *(f"w{k}" for k in range(300))])
    text = lambda n: "".join(word() + r.choice([" ", "\n", "\x0b", "\xa0", "  "]) for _ in range(n))
    docs = [(i, text(r.choice([5, 49, 50, 80, 200])), r.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[i % 7][1], "a") for i in range(40)]  # copies
    docs += [docs[3], docs[3], (None, docs[1][1], "b"), (None, None, None), (300, None, "b"), (301, "", "b"), (302, text(20000), "long")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    given = spark.createDataFrame([(*d, 1, "m", b"x") for d in docs], "doc_id long, text string, source string, mask int, part string, digest binary").repartition(3)
    known = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    out = filters.audit(given, known)
    got = {(x.part, x.filter_order, x.step): tuple(x[n] for n in names) for x in out.collect()}
    assert got == plain_audit(docs, labels)
    assert {t for n, t in out.dtypes if n in names} == {"bigint"}
    assert filters.audit(given.limit(0), known).count() == 0
    assert {r.good_lost for r in filters.audit(given, known.limit(0)).collect()} == {0}
