"""The Jaccard join against all pairs, with each of its two searches, and its parts against plain versions."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from corpusflow.llm import jaccard
from tests.llm.test_operators import prose


def plain_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def plain_components(rows):
    """{(id, text): (size, component)} by all pairs; rows that share an id hang together, rows without one are nodes of their own."""
    keys = sorted({(t or "", i) for i, t in rows}, key=repr)
    sets = [plain_set(t) for t, _ in keys]
    root = list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = keys[a][1] is not None and keys[a][1] == keys[b][1] and sets[a] and sets[b]
            if same_id or (both and 100 * both >= 90 * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    least = {}
    for k, (_, i) in enumerate(keys):
        if i is not None and sets[k]:
            least[find(k)] = min(i, least.get(find(k), i))
    return {key: (len(sets[k]), least.get(find(k)) if sets[k] else key[1]) for k, key in enumerate(keys)}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [f"w{k}" for k in range(900)]
    changed = lambda w, n: [r.choice(words) if j in at else x for at in [set(r.sample(range(len(w)), n))] for j, x in enumerate(w)]
    passage = [r.choice(words) for _ in range(60)]  # occurs in many documents that are otherwise different
    out = [(i, " ".join([r.choice(words) for _ in range(r.randint(40, 160))] + passage)) for i in range(40)]
    base = [r.choice(words) for _ in range(200)]
    out += [(100 + i, " ".join(changed(base, r.randint(0, 9)))) for i in range(80)]  # a family that straddles the threshold
    chain = [r.choice(words) for _ in range(150)]
    for i in range(12):
        out.append((300 - i, " ".join(chain)))
        chain = changed(chain, 2)
    for i, n in enumerate((9, 10, 11, 19, 20, 21)):  # subsets at the threshold
        w = [f"x{i}_{k}" for k in range(n + 2)]
        out += [(400 + 3 * i, " ".join(w)), (401 + 3 * i, " ".join(w[:-1])), (402 + 3 * i, " ".join(w[1:-1]))]
    out += [(500 + i, out[45][1].upper()) for i in range(30)] + [out[50], out[50], (None, out[51][1]), (None, prose(9, 80)), (None, prose(9, 80) + " "), (None, None)]
    out += [(600, None), (601, ""), (602, " \n"), (603, "one"), (604, "One"), (605, "one two"), (606, "größe Größe"), (607, prose(7, 6000)), (608, prose(7, 5999))]
    return [*out, (700, out[0][1]), (700, out[45][1]), (701, out[45][1]), (701, "other words here now"), (702, "other words here now")]


def given(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", b"s", [1]) for i, t in rows], "doc_id long, text string, n int, node string, same binary, tokens array<int>").repartition(4)


@pytest.mark.parametrize("search", ["stars and blocks", "blocks only", "small blocks"])
def test_near_sets(spark, rows, monkeypatch, search):
    if search == "blocks only":  # every link has to come from the second search
        stars = jaccard.stars
        monkeypatch.setattr(jaccard, "stars", lambda index: stars(index).limit(0))
    if search == "small blocks":
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "TOGETHER", 2)
        monkeypatch.setattr(jaccard, "FEW", 0)
    want = plain_components(rows)
    got = jaccard.near_sets(given(spark, rows).withColumnRenamed("text", "t").selectExpr("doc_id", "t AS text", "n", "node", "same", "tokens")).collect()
    assert len(got) == len(rows)
    sizes = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got)
    assert sizes == sorted((i is None, i or 0, want[t or "", i][0], -1 if want[t or "", i][1] is None else want[t or "", i][1]) for i, t in rows)
    assert len({r.component_id for r in got}) < 130


def test_near_sets_of_nothing(spark, rows):
    assert jaccard.near_sets(given(spark, rows).limit(0)).count() == 0
    lone = jaccard.near_sets(given(spark, [(1, None), (2, ""), (3, "a b c d")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in lone) == [(1, 0, 1), (2, 0, 2), (3, 2, 3)]


def test_overlaps_follow_from_the_leaders():
    r = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(r.integers(0, 60, r.integers(0, 50))) for _ in range(2))
        u, v = (np.unique(np.concatenate([s[r.random(len(s)) > 0.2], r.integers(0, 60, 4)])) for s in (x, y))
        about = lambda own, lead: (lead, np.setdiff1d(own, lead), np.setdiff1d(lead, own))
        assert jaccard.derived(len(np.intersect1d(x, y)), about(u, x), about(v, y)) == len(np.intersect1d(u, v))


def test_blocks_skip_what_cannot_link(spark):
    """Entries of one list at sizes and positions of all kinds: exactly the pairs with room are met."""
    r = random.Random(2)
    entries = [(1, k, r.choice([20, 21, 24, 100, 108, 112]), r.randint(0, 11), 40, k % 7) for k in range(40)]
    index = spark.createDataFrame(entries, "token long, node long, n int, pos int, size long, part long")
    got = {(min(x.u, x.v), max(x.u, x.v)) for x in jaccard.across(index).collect()}
    room = lambda a, b: 19 * a[3] <= 10 * a[2] - 9 * b[2]
    assert got == {(a[1], b[1]) for a in entries for b in entries if a[1] < b[1] and a[5] != b[5] and 10 * a[2] >= 9 * b[2] and 10 * b[2] >= 9 * a[2] and room(a, b) and room(b, a)}
    held = jaccard.blocks(index).selectExpr("sum(size(nodes)) AS n", "count(*) AS blocks").first()
    assert held.n == 40 and held.blocks < 40


def test_parities_never_show_too_many_differences():
    r = np.random.default_rng(2)
    for n, m in [(1, 1), (5, 300), (120, 140), (500, 520), (520, 500), (3000, 4200), (0, 7)]:
        x, more = (np.unique(r.integers(0, 1 << 63, k, np.uint64)) for k in (n, m))
        for y in (more, np.unique(np.concatenate([x[: n // 2], more])), x):
            a, b = jaccard.parities(x), jaccard.parities(y)
            assert jaccard.differing(a, b) == jaccard.differing(b, a) <= len(np.setxor1d(x, y))
            width = 8 * min(len(a), len(b))
            assert jaccard.differing(a, b) == (np.bincount((np.setxor1d(x, y) % np.uint64(width)).astype(int), minlength=width) & 1).sum()
    assert jaccard.differing(jaccard.parities(x), jaccard.parities(more)) >= 0


def test_sketch_counts_all_shingles(spark, rows):
    total = jaccard.sketch(given(spark, rows))
    assert total.sum() == sum(len(plain_set(t)) for _, t in rows) and len(total) == 1 << jaccard.SKETCH_BITS
