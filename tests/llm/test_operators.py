"""Each operator against a plain version of itself, on small tables with the awkward cases."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from corpusflow.llm import components, decontam, licenses, lm, neardup, pretokens, quality, sharding, simhash, spm, tokencount, tokenfile, warc
from corpusflow.llm.queries import PIECES, TOKENIZER, tokenizer_path

WORDS = "the a of to stone river light house winter cloud paper green under seven morning letter glass field carries över größe niño".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ". ", ",\n", "\n"]) for _ in range(n))


LONG = prose(7, 6000)
TEXTS = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(3, 300)), (4, None), (5, ""), (6, " "), (7, LONG), (7, LONG), (None, prose(9, 80)),
    (8, "a  b \n c\t\tit's 12345 I'll <|endoftext|> x<|endoftext|> y ١٢ 中文字 \x1c z ½ ﬁ ▁ end "), (9, "x" * 5000), (10, "!!! ### " * 40),
    (11, prose(1, 119)), (12, None), (13, "one two"),
]
SCHEMA = "doc_id long, text string, shard string, n int, key string, score string, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, 1, "k", "s", "x") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def size(text):
    return len((text or "").encode()) + 16


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for shard in {r.shard for r in rows}:
        places = sorted(r.slot for r in rows if r.shard == shard)
        assert places == list(range(len(places)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert sharding.shard_documents(none, 4).count() == 0


def test_rebalancing_moves_only_what_it_must(spark, tmp_path):
    loads = spark.range(64).selectExpr("cast(id as int) virtual_slot", "cast(case when id < 16 then 100 else 10 end as long) bytes")
    path = str(tmp_path / "map")
    sharding.save_map(sharding.first_map(spark, 4, 64), path, 1)
    sharding.save_map(sharding.rebalanced(sharding.load_map(spark, path, 1).select("virtual_slot", "shard"), loads, 4), path, 2)
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.virtual_slot: r for r in sharding.load_map(spark, path, 2).collect()}
    total = Counter()
    for r in new.values():
        total[r.shard] += r.bytes
    assert max(total.values()) - min(total.values()) <= 100 and len(new) == 64
    assert all(new[s].shard == old[s] for s in range(16, 64))  # only the overloaded shard gives slots away
    with pytest.raises(Exception, match="exists"):
        sharding.save_map(sharding.first_map(spark, 4, 64), path, 2)


def test_warc(spark):
    page = "<html>" + "y" * 200
    rows = [(5, "http://a/x y\r\nz", page), (3, None, page), (9, "u", page), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (None, "u", page), (3, "u", page), (6, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", LONG)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    out = warc.round_trip(spark, pages).collect()
    first = {page: 3, "é" * 60: 6, LONG: 8}
    expect = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if html in first and i != first[html] else None
        expect[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers)] += 1
    assert Counter(tuple(r) for r in out) == expect
    files = warc.archive_pages(spark, pages)
    assert sum(r.records for r in files.collect()) == len(rows)
    read = {r.page_id: r.payload for r in warc.read_archives(files).collect() if r.record_type == "response"}
    assert bytes(read[8]).decode() == LONG
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_dictionary_frame_and_validation(tmp_path):
    samples = [warc.record(i, f"http://x/{i}", f"<html><body>{prose(i, 60)}</body></html>".encode(), "", None) for i in range(200)]
    records = []
    for i in range(200):
        data = f"<html><body>{prose(i, 60)}</body></html>".encode()
        records.append(warc.record(i, f"http://x/{i}", data, hashlib.sha256(data).hexdigest(), None))
    archive = warc.Archive(str(tmp_path), samples)
    for r in records:
        archive.add(r)
    path = archive.close()["path"]
    with open(path, "rb") as f:
        assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_MAGIC
    with open(path, "rb") as f:
        assert list(warc.frames(f)) == records
    good = records[0]
    assert warc.parse(good)[0] == 0
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"<body>", b"<bodx>"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    with open(path, "rb") as f:
        cut = f.read()[:-5]
    (tmp_path / "cut").write_bytes(cut)
    with open(tmp_path / "cut", "rb") as f, pytest.raises(warc.BadRecord):
        list(warc.frames(f))


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, none):
    corpus = [(i, prose(i, 100 + i % 50)) for i in range(300)] + [(1000 + i, re.sub(r"(\w) ", r"\1%%%&&& ", prose(i, 120))) for i in range(40)]
    labels = spark.createDataFrame([(i, 1 if i < 1000 else 0, 0) for i, _ in corpus] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(corpus, "doc_id long, text string")
    forest = quality.fit(table, labels)
    rows = quality.judged(table, forest).collect()
    assert sum(r.kept for r in rows if r.doc_id < 1000) >= 298 and not any(r.kept for r in rows if r.doc_id >= 1000)
    assert quality.kept_documents(table, forest).count() == sum(r.kept for r in rows)
    for r in quality.judged(docs, forest).collect():
        options = [plain_statistics(t or "") for i, t in TEXTS if i == r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in options
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judged(none, forest).count() == 0 and quality.kept_documents(docs, forest).columns == docs.columns
    assert quality.fit(table, labels.limit(0)) is None
    assert {r.kept == (not r.base_failed) for r in quality.judged(docs, None).collect()} == {True}


def test_forest_isolates_outliers():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(2000, 8))
    forest = quality.grow(x)
    score = forest.score(np.vstack([x[:100], x[:20] + 9]))
    assert score[:100].max() < score[100:].min()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_token_counts(docs, none, library):
    rows = tokencount.token_counts(docs, tokenizer_path(TOKENIZER)).collect()
    expect = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == expect
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    joined = tokencount.token_counts(docs, tokenizer_path(TOKENIZER), head=9).collect()  # nearly all pieces go through the join
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in joined) == expect
    assert tokencount.token_counts(none, tokenizer_path(TOKENIZER)).count() == 0
    words = tokencount.vocabulary(docs.where("doc_id = 1"), tokenizer_path(TOKENIZER)).collect()
    assert sum(r.occurrences * r.n_tokens for r in words) == len(library.encode(TEXTS[0][1], add_special_tokens=False).ids)


def test_pieces_are_the_librarys(library):
    """Random strings of troublesome characters: every cut must leave the ids unchanged."""
    from corpusflow.llm.pretokens import Units, encoder_of

    r, encoder = random.Random(5), encoder_of(tokenizer_path(TOKENIZER))
    assert encoder.core is not None
    signs = ["a", "B", "é", "ß", "1", "²", "ª", "_", "'", "'s", "'ll", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "中", "ـ", "!", "-", "<|endoftext|>", "the", " The", "́", "😀"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    for text in texts:
        ids = list(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
        data = encoder.ids(text)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == ids, repr(text)
        stretches, special = encoder.stretches(text)
        assert len(special) + sum(encoder.count(piece) for s in stretches for piece in Units([s]).distinct for _ in range(Units([s]).codes.tolist().count(Units([s]).distinct.index(piece)))) == len(ids)
    units = Units(texts)
    assert [[units.distinct[c] for c in units.codes[a:b]] for a, b in zip(units.ends, units.ends[1:])] == [pretokens.cut(t) for t in texts]
    assert len(set(units.distinct)) == len(units.distinct)


def test_white_space_of_all_kinds(library):
    """All strings up to six characters of white space and a letter, and longer random ones: ids and counts are the library's."""
    from corpusflow.llm.pretokens import Units, encoder_of

    r, encoder = random.Random(8), encoder_of(tokenizer_path(TOKENIZER))
    texts = ["".join(t) for n in range(7) for t in itertools.product([" ", "\xa0", "\u3000", "\n", "a"], repeat=n)]
    spaces = [" ", " ", " ", "\xa0", "\u3000", "\u2009", "\u2028", "\x85", "\x0b", "\x0c", "\x1c", "\x1f", "\t", "\r\n", "\u180e", "\u200b", "\ufeff", "x", "the", ".", "'s", "1", "中"]
    texts += ["".join(r.choice(spaces) for _ in range(r.randint(1, 24))) for _ in range(20_000)] + ["Hello. \xa0 \xa0", "x \xa0 \xa0 \xa0 \xa0 y", "price: \xa0 \xa0\nnext"]
    units = Units(texts)
    counts = units.sums(np.array([encoder.count(piece) for piece in units.distinct]))
    for text, count, got in zip(texts, counts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        data = encoder.ids(text)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == got.ids and count == len(got.ids), repr(text)


def test_merge_loop_is_the_librarys(library):
    """Every token of the vocabulary next to every kind of neighbour, and random bytes of letters."""
    from corpusflow.llm.pretokens import encoder_of

    r, encoder = random.Random(6), encoder_of(tokenizer_path(TOKENIZER))
    tokens = [library.decode([i]) for i in range(0, 50_000, 7)]
    for _ in range(300):
        text = "".join(r.choice(tokens) for _ in range(60))
        data = encoder.ids(text)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == library.encode(text, add_special_tokens=False).ids
    for alphabet in ("etaoin", "ab ", "0123456789-", "éèüß e"):
        text = "".join(r.choice(alphabet) for _ in range(50_000))
        data = encoder.ids(text)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_left_to_the_library(tmp_path, library):
    """A file whose ids don't follow its merges has no merge loop, and the same results."""
    import json

    from corpusflow.llm.pretokens import Encoder

    file = json.loads(library.to_str())
    file["model"]["merges"] = file["model"]["merges"][:300][::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    own, encoder = tokenizers.Tokenizer.from_file(str(path)), Encoder(str(path))
    assert encoder.core is None
    data = encoder.ids(TEXTS[0][1])
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == own.encode(TEXTS[0][1], add_special_tokens=False).ids


def test_full_table_forgets_and_still_answers(monkeypatch):
    monkeypatch.setattr(pretokens, "TABLE_ENTRIES", 10)
    table = pretokens.Table(len)
    r = random.Random(3)
    for _ in range(2000):
        key = "x" * r.randint(0, 90)
        assert table[key] == len(key)
        assert len(table) + len(table.older) <= 10 and max(map(len, table), default=0) <= pretokens.KEPT_CHARS


def plain_fingerprint(text, words):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    ids = sorted((i for i, _ in prints if i is not None))
    near = {f: f for _, f in prints}

    def root(f):
        while near[f] != f:
            f = near[f]
        return f

    keys = list(near)
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 4:
                near[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), ids[-1]))
    return {(i, f): least.get(root(f)) for i, f in prints}


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs, words=4).collect()
    prints = [(i, plain_fingerprint(t or "", 4)) for i, t in TEXTS]
    part = plain_components(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == Counter((i, f"{f:016x}", part[i, f]) for i, f in prints)
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_random_fingerprints(spark):
    r = random.Random(3)
    fps = {0, 1, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 30)):
            fps.add(f)
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f, n) for n, f in enumerate(signed)], "fp long, node long")
    got = {}
    for row in simhash.roots(table).collect():
        got.setdefault(row.root, set()).add(row.fp % (1 << 64))
    want = {}
    for (i, f), c in plain_components(list(enumerate(sorted(fps)))).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_halves_meet_once(spark):
    """Every pair within the distance meets under exactly one key, equal ones too where they are near enough in the first half."""
    r = random.Random(6)
    base = [r.getrandbits(63) for _ in range(12)]
    fps = [(n, f ^ sum(1 << b for b in r.sample(range(62), k))) for n, (f, k) in enumerate((f, k) for f in base for k in (0, 1, 2, 3, 4, 4, 5, 8))]
    table = spark.createDataFrame(fps, "node long, fp long")
    for distance in (1, 2, 3, 4, 5):
        probe, held = simhash.balls(table, distance).alias("a"), simhash.balls(table, distance, search=False).alias("b")
        met = probe.join(held, F.expr("a.key = b.key AND a.node < b.node AND (b.bit < 0 OR b.bit < a.bit)")).selectExpr("a.node AS u", "b.node AS v", "shiftright(a.key, 58) AS half").collect()
        assert len(met) == len({(x.u, x.v, x.half) for x in met})
        got = {(x.u, x.v) for x in met}
        assert {(u, v) for u, f in fps for v, g in fps if u < v and (f ^ g).bit_count() <= distance} <= got
        first = simhash.radii(distance)[0]
        assert all(((f ^ g) & 0xFFFFFFFF).bit_count() <= sum(first) or (u, v) not in {(x.u, x.v) for x in met if x.half == 0} for u, f in fps for v, g in fps)


def test_no_side_of_the_joins_is_broadcast(spark):
    """Tables that grow with the input don't go through the driver, however small Spark thinks they are."""
    fps = spark.createDataFrame([(n * n, n, n % 7) for n in range(50)], "fp long, node long, part long")
    edges = spark.createDataFrame([(n, n + 1) for n in range(50)], "u long, v long")
    made = [simhash.stars(fps), simhash.links(fps), simhash.roots(fps.select("fp", "node")), components._star(edges, small=True), components._star(edges, small=False)]
    for df in made:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_representatives(docs, none):
    kept = simhash.representatives(docs).collect()
    assert kept and set(kept[0].asDict()) == set(docs.columns)
    prints = [(i, plain_fingerprint(t or "", 5)) for i, t in TEXTS]
    part = plain_components(prints)
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == sorted(-1 if c is None else c for c in {part[i, f] if part[i, f] is not None else None for i, f in prints})
    assert simhash.representatives(none).count() == 0


def word_sets(rows):
    """The five-word shingles of each (id, text), or the whole sequence where it is shorter."""
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_groups(rows):
    """The smallest id that each (id, text) reaches over links of a Jaccard similarity of 0.8, by comparing all pairs."""
    sets = word_sets(rows)
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return least


def test_near_duplicates_are_those_of_brute_force(spark, docs, none):
    """Planted pairs just above and just below 0.8, chains, copies, short and empty texts."""
    rows = [(90_000, ""), (90_001, None), (90_002, "one two"), (90_003, "One two"), (90_004, "two one")]
    for k in range(40):
        r = random.Random(1000 + k)
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for j in range(1 + k % 5):  # each word changed within the text costs five shingles of 196
            base_j = base[:]
            for p in r.sample(range(5, 195, 10), j + 1):
                base_j[p] = f"new{r.randrange(10**6)}"
            rows.append((100 * k + j + 1, " ".join(base_j)))
        rows += [(100 * k, " ".join(base)), (100 * k + 50, "  ".join(base).upper())]
    sets = word_sets(rows)
    near = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 100 == b // 100 and sets[a]]
    assert sum(0.8 <= x < 0.86 for x in near) > 10 and sum(0.7 <= x < 0.8 for x in near) > 10
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)
    kept = neardup.representatives(docs).collect()
    assert len(kept) == len(set(plain_groups([(i, t) for i, t in TEXTS if i is not None]).values())) + 1
    assert set(kept[0].asDict()) == set(docs.columns) and neardup.representatives(none).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Hundreds of near copies of one text, each with other words changed: one group; a text at 0.7 of it stays out."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]

    def copy(n):
        out = base[:]
        for p in r.sample(range(300), n):
            out[p] = f"new{r.randrange(10**6)}"
        return " ".join(out)

    other = base[:150] + [f"w{r.randrange(10**6)}" for _ in range(12)] + base[150:]  # another large group, within reach of the first by some
    rows = [(i, copy(2)) for i in range(400)] + [(1000, copy(14))] + [(3000 + i, " ".join(w if r.random() > 0.004 else "x" for w in other)) for i in range(80)] + [(2000 + i, prose(i, 60)) for i in range(20)]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == plain_groups(rows) and got[399] == 0 and got[1000] == 1000


@pytest.mark.parametrize("crowd", [-1, 8, 10**9])
def test_families_below_the_threshold(spark, monkeypatch, crowd):
    """200 texts at 0.5 to 0.7 of each other, some with near copies: the same groups whether all, some or no nodes are crowded."""
    monkeypatch.setattr(neardup, "CROWD", crowd)
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(240)]

    def changed(words, n):
        out = words[:]
        for p in r.sample(range(len(out)), n):
            out[p] = f"new{r.randrange(10**6)}"
        return out

    family = [changed(base, 8) for _ in range(200)]
    rows = [(i, " ".join(w)) for i, w in enumerate(family)] + [(1000 + i, " ".join(changed(family[i], 1 + i % 6))) for i in range(0, 200, 5)]
    rows += [(2000 + i, prose(i, 60)) for i in range(20)] + [(3000, ""), (3001, "one word"), (3002, None)]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = plain_groups(rows)
    assert got == want and 200 < len(set(want.values())) < len(rows) - 10


def test_parities_never_exclude_a_link(spark):
    import numpy as np

    r = random.Random(3)
    sets = {k: [r.getrandbits(63) for _ in range(60)] for k in range(4)}
    sets |= {k + 10: v[:54] + [r.getrandbits(63) for _ in range(6)] for k, v in sets.items()}  # 54 of 66
    rows = neardup.rare(spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"), spark.createDataFrame([(k, k, 0, 0) for k in sets], "node long, part long, fp long, fp2 long")).collect()
    odd = {x.node: np.array([x[f"odd{k}"] for k in range(neardup.PARITIES // 64)], np.int64) for x in rows}
    for k in range(4):
        assert sum((int(z) & (2**64 - 1)).bit_count() for z in odd[k] ^ odd[k + 10]) <= 12
        assert {x.shingle for x in rows if x.node == k} & {x.shingle for x in rows if x.node == k + 10}


def test_chance_meetings_stay_in_the_index(spark):
    """Nodes that share a segment and are near in its word, and far apart in the other word, don't leave the join."""
    r = random.Random(4)
    nodes = {k: (r.getrandbits(63), 5 | sum(1 << b for b in r.sample(range(21, 63), 7))) for k in range(60)}
    nodes |= {k + 100: (a ^ 7 << 40, b) for k, (a, b) in nodes.items() if k < 20}
    many = {k for k in nodes if k % 3 == 0}
    unsure = bytes([*range(neardup.UNSURE)] * neardup.SEGMENTS)
    rows = [(k, k, a, b, unsure, True if k in many else None) for k, (a, b) in nodes.items()]
    got = {tuple(x) for x in neardup.index_meetings(spark.createDataFrame(rows, "node long, part long, fp long, fp2 long, unsure binary, many boolean")).collect()}
    apart = {(u, v): [(x ^ y).bit_count() for x, y in zip(nodes[u], nodes[v])] for u in nodes for v in nodes if u < v and not {u, v} <= many}
    assert got == {k for k, d in apart.items() if sum(d) <= neardup.DISTANCE} and sum(d[1] <= 20 for d in apart.values()) > 10 * len(got) > 100


def test_rare_shingles_are_met_once_a_run(spark):
    """Sets at 0.8 to 0.95 of each other meet at their first common one and after differences, not at each of a fifth."""
    r = random.Random(6)
    base = sorted(r.getrandbits(63) for _ in range(100))
    sets = {k: [r.getrandbits(63) if r.random() < 0.05 else x for x in base] for k in range(40)}
    nodes = spark.createDataFrame([(k, k, 0, 0) for k in sets], "node long, part long, fp long, fp2 long")
    got = [tuple(x) for x in neardup.rare_meetings(neardup.rare(spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"), nodes)).collect()]
    link = {(a, b) for a in sets for b in sets if a < b and 9 * len({*sets[a]} & {*sets[b]}) >= 4 * 200}
    assert len(link) > 300 and link <= set(got) and len(got) < 2 * len(set(got))


def test_shared_and_missing_ids(spark):
    """An id that different texts share names the groups of both; a row without an id takes the group's name."""
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(7, a), (7, b), (9, a), (None, b), (None, c), (8, c + " tail")]
    got = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(7, 7): 2, (9, 7): 1, (None, 7): 1, (None, 8): 1, (8, 8): 1})


def test_balls_hold_what_they_should():
    import numpy as np

    values, unsure = neardup.segments(np.random.default_rng(2).integers(-9, 10, (5, neardup.SEGMENTS * neardup.BITS)))
    keys = neardup.ball(values, unsure).reshape(5, neardup.SEGMENTS, -1)
    for t in range(5):
        for s in range(neardup.SEGMENTS):
            own, low = int(values[t, s]) | s << neardup.BITS, [int(b) for b in unsure[t, s]]
            want = {own} | {own ^ 1 << i for i in low} | {own ^ (1 << i | 1 << j) for i in low for j in low if i != j}
            assert set(keys[t, s].tolist()) == want and len(want) == keys.shape[2]
    assert neardup.ball(values, unsure, radius=0).shape == (5, neardup.SEGMENTS)


@pytest.mark.parametrize("size", [40, 150, 16_384])
def test_sentencepiece(docs, none, size):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    rows = spm.report(docs, tokenizer_path(PIECES), chunk=size).collect()
    expect = Counter()
    for i, t in TEXTS:
        ids = sp.encode(t or "")
        expect[(i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), len(t or ""), "▁" not in (t or ""))] += 1
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_chars, r.round_trip) for r in rows) == expect
    assert spm.report(none, tokenizer_path(PIECES)).count() == 0


def test_a_text_of_thousands_of_chunks(spark):
    """Chunks in several blocks, with stretches without spaces across the blocks' ends; and small blocks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    texts = [prose(11, 9000) + "lightriver" * 3000 + prose(12, 6000), prose(13, 300) + "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spm.encoded(docs, tokenizer_path(PIECES), chunk=40).collect():
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == sp.encode(texts[r.doc_id]) and r.round_trip
        assert r.n_chunks > (2000 if r.doc_id == 0 else 40)
    parts = spm.chunks(docs.where("doc_id = 1"), tokenizer_path(PIECES), 40)
    weights = spm.transfers(parts, tokenizer_path(PIECES)).cache()
    assert sorted(spm.chosen(weights, block=3).collect()) == sorted(spm.chosen(weights).collect())


def test_sentencepiece_scan_without_spaces():
    """Chunk boundaries anywhere in strings that offer no place to break at."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    model, r = spm.model_of(tokenizer_path(PIECES)), random.Random(2)
    for k in range(60):
        text = "".join(r.choice("aabcdeinorstué☃中 " if k % 2 else "abcdeinorst") for _ in range(r.randint(30, 120)))
        whole = spm.MARK + text.replace(" ", spm.MARK)
        step, parts = r.choice([17, 23, 40]), []
        for at in range(0, len(whole), step):
            low, high = max(0, at - model.halo), min(len(whole), at + step + model.halo)
            parts.append(spm.Chunk(model, whole[low:high], at - low, min(len(whole), at + step) - low, at == 0))
        picked = spm.choose([c.matrix() for c in parts])
        ids = [x for c, (i, j) in zip(parts, picked, strict=True) for x in c.trace(i, j)[0]]
        assert ids == sp.encode(text), repr(text)


def test_token_files(docs, none, library):
    files = tokenfile.write_files(docs, tokenizer_path(TOKENIZER))
    rows = sorted(tokenfile.read_files(files, with_ids=True).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(-1 if i is None else i for i, _ in TEXTS)
    at = 0
    for r in rows:
        options = [library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in TEXTS if i == r.doc_id]
        assert r.ids in options and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))
        at += r.n_tokens
    assert tokenfile.read_files(tokenfile.write_files(none, tokenizer_path(TOKENIZER))).count() == 0


def test_blocks_round_trip():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 100, tokenfile.BLOCK):
        for top in (1, 2, 200, 50_000, 1 << 31):
            ids = (r.integers(0, top, n) + r.integers(0, 1000)).astype(np.uint32)
            ids[:: max(1, n // 3)] = np.uint32(0xFFFFFFFF)
            assert (tokenfile.unpack_block(tokenfile.pack_block(ids), 0) == ids).all()


def test_language_model(spark, docs, none):
    import numpy as np

    chain = {"the": ["river", "stone"], "river": ["carries"], "stone": ["carries"], "carries": ["a"], "a": ["letter", "paper"], "letter": ["the"], "paper": ["the"]}
    r, texts = random.Random(1), []
    for _ in range(200):
        w = ["the"]
        while len(w) < 60:
            w.append(r.choice(chain[w[-1]]))
        texts.append(w)
    train = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts[:150])], "doc_id long, text string")
    held = []
    for i, w in enumerate(texts[150:]):
        held += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(r.sample(w, len(w))))]
    scorer, rows = lm.fit(train)
    assert sum(r.n for r in scorer.words.collect()) == scorer.sizes.sum() == 150 * 60
    got = {x.doc_id: x.mean_log_prob for x in lm.scores(spark.createDataFrame(held, "doc_id long, text string"), scorer).collect()}
    assert sum(got[k] > got[k + 1] for k in range(0, 100, 2)) == 50  # held-out order against shuffled words
    rows = lm.scores(docs, scorer).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in rows) == Counter((i, len((t or "").encode().split())) for i, t in TEXTS)
    assert all((x.mean_log_prob is None) == (x.n_tokens == 0) for x in rows)
    empty, nothing = lm.fit(none)
    assert lm.score(nothing, empty).count() == 0 and lm.scores(docs, empty).count() == len(TEXTS)


def plain_log_prob(text, counts, net, frequent):
    """The sums over the words of a text, each from its definition: (of all, of the classes)."""
    import numpy as np

    kind = lambda w: frequent.index(w) + 1 if w in frequent else lm.shape(w)
    sizes = Counter()
    for w, n in counts.items():
        sizes[kind(w)] += n
    words = (text or "").encode().lower().split()
    classes = [0, 0, *map(kind, words), 0, 0]
    total = by_class = 0.0
    for i, w in enumerate(words):
        around = [classes[i], classes[i + 1], classes[i + 3], classes[i + 4]]
        z = np.tanh(sum(net.near[k][c] for k, c in enumerate(around)) + net.bias).astype(np.float64) @ net.out + net.out_bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        by_class += np.log(p[kind(w)])
        total += np.log(p[kind(w)]) + np.log(max(1, counts.get(w, 1)) / (sizes[kind(w)] + 1))
    return total, by_class


def test_log_probabilities_are_those_of_the_definition(spark, docs, monkeypatch):
    """Every document against a plain sum over its words; with words in the head, and with nearly all words joined."""
    import numpy as np

    counts = Counter(w for _, t in TEXTS for w in (t or "").encode().lower().split())
    for head in (3, lm.HEAD):
        monkeypatch.setattr(lm, "HEAD", head)
        scorer, rows = lm.fit(docs)
        assert {bytes(r.word): r.n for r in scorer.words.collect()} == counts and len(scorer.head) <= head
        got = sorted((x.n_tokens, round(x.log_prob, 2), round(x.class_log_prob, 2)) for x in lm.score(rows, scorer).collect())
        want = sorted((len((t or "").encode().split()), *plain_log_prob(t, counts, scorer.net, scorer.frequent)) for _, t in TEXTS)
        assert all(a[0] == b[0] and np.allclose(a[1:], b[1:], rtol=1e-3, atol=0.05) for a, b in zip(got, want, strict=True))
    context = np.random.default_rng(0).integers(0, lm.CLASSES, (50, 4))
    assert np.allclose(sum(np.exp(scorer.net.log_prob(context, np.full(50, c))) for c in range(lm.CLASSES)), 1, atol=1e-4)


def test_documents_that_occur_twice_score_higher(spark):
    """A model of the whole corpus knows the words of a document that it has seen twice better."""
    r = random.Random(8)
    new = lambda k: " ".join(f"{r.choice(WORDS)} {''.join(r.choice('abcdefghij') for _ in range(9))}" for _ in range(60))
    once, twice = [new(k) for k in range(60)], [new(k) for k in range(10)]
    rows = [(i, t) for i, t in enumerate(once)] + [(100 + i, t) for i, t in enumerate(twice)] + [(200 + i, t) for i, t in enumerate(twice)]
    scorer, table = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.mean_word_log_prob for x in lm.score(table, scorer).collect()}
    assert min(got[i] for i in got if i >= 100) > max(got[i] for i in got if i < 100)


def test_language_model_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    net = lm.Network.start(r.integers(1, 100, lm.CLASSES))
    net.out += r.standard_normal(net.out.shape).astype(np.float32)
    context, middle = r.integers(0, lm.CLASSES, (400, 2 * lm.SIDE)), r.integers(0, lm.CLASSES, 400)
    _, grads = net.gradients(context, middle)
    mean_loss = lambda: -float(net.log_prob(context, middle).mean())
    for w, g in zip(net.weights(), grads, strict=True):
        step = r.standard_normal(w.shape).astype(np.float32)
        w += 1e-2 * step
        up = mean_loss()
        w -= 2e-2 * step
        down = mean_loss()
        w += 1e-2 * step
        assert abs((up - down) / 2e-2 - float((g * step).sum())) < 5e-3


@pytest.mark.parametrize("n", [0, 1, 32, 400, 1024])
def test_language_model_products(monkeypatch, n):
    """Two calls at most of the library for all blocks, with the bits of a call for each."""
    import numpy as np

    r = np.random.default_rng(n)
    a, b, c = (r.standard_normal(s).astype(np.float32) for s in ((n, lm.HIDDEN), (lm.HIDDEN, lm.CLASSES), (n, lm.CLASSES)))
    parts = [slice(k, k + lm._ROWS) for k in range(0, n, lm._ROWS)]
    product = np.concatenate([np.zeros((0, lm.CLASSES), np.float32), *(a[p] @ b for p in parts)])
    inner = sum((a[p].T @ c[p] for p in parts), np.zeros((lm.HIDDEN, lm.CLASSES), np.float32))
    calls, own = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *x, **y: calls.append(1) or own(*x, **y))
    got = lm._product(a, b), lm._inner(a, c)
    assert (got[0] == product).all() and (got[1] == inner).all() and len(calls) <= 4


def test_license_phrases_of_long_texts():
    """The places of all phrases, in time that grows with the text."""
    scan, r = licenses.Scan(), np.random.default_rng(7)
    vocabulary = [w.encode() for w in "gnu general public license cc by mit apache x".split()]
    for _ in range(300):
        words = [vocabulary[i] for i in r.integers(0, len(vocabulary), int(r.integers(0, 30)))]
        want = {}
        for phrase, label in licenses.PHRASES.items():
            own = phrase.encode().split()
            if at := [k for k in range(len(words)) if words[k : k + len(own)] == own]:
                want[label] = at
        assert scan.base(words) == want
    assert scan.base([b"mit", b"license"] * 400_000)["mit"] == list(range(0, 800_000, 2))


def test_license_scan(spark, docs, none):
    gpl = licenses.TEMPLATES["gpl-3.0-header"]
    texts = [
        (1, prose(1, 60) + " " + gpl), (2, "Apache License apache license MIT License mit license"), (3, "x under the CC-BY license; GNU general public\nlicense"),
        (4, " ".join(gpl.split()[:40]) + " altered here " + " ".join(gpl.split()[42:])), (5, prose(2, 400)), (6, None), (7, ""),
    ]
    rows = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (rows[i].n_words, rows[i].n_base) == (len(w), len(at))
        assert (rows[i].first_word, rows[i].last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert rows[i].base_labels == ",".join(sorted({label for _, label in at})) and set(rows[i].base_labels.split(",")) <= {*rows[i].labels.split(","), ""}
    assert rows[1].score == 1 and "gpl-3.0-header" in rows[1].labels and "gpl-3.0-header" in rows[4].labels and 0.9 < rows[4].score < 1
    assert rows[5].labels == "" and licenses.license_scan(docs).count() == len(TEXTS) and licenses.license_scan(none).count() == 0


def test_matching_statistics():
    """Every stretch that the automaton reports is the longest one, by comparison with plain search."""
    import numpy as np

    r = random.Random(4)
    templates = {str(k): " ".join(r.choice("abc") for _ in range(30)) for k in range(3)}
    auto = licenses.automaton(templates)
    text = [r.choice("abc") for _ in range(300)]
    ids = np.array([auto.ids[w.encode()] for w in text])
    whole = [t.split() for t in templates.values()]

    def inside(part):
        return [(k, i + len(part) - 1) for k, t in enumerate(whole) for i in range(len(t) - len(part) + 1) if t[i : i + len(part)] == part]

    longest = []
    for end in range(len(text)):
        n = 0
        while n <= end and inside(text[end - n : end + 1]):
            n += 1
        longest.append(n)
    want = {(e, n) for e, n in enumerate(longest) if n >= 4 and (e + 1 == len(text) or longest[e + 1] <= n)}
    found = licenses.matches(auto, ids)
    assert {(e, n) for e, n, _ in found} == want
    for e, n, state in found:
        assert set(inside(text[e - n + 1 : e + 1])) == auto.ends[state]


def test_decontamination(spark, docs, none):
    items = [(1, prose(50, 40)), (2, "short Item"), (3, ""), (4, None), (10, prose(50, 40)), (None, "river")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    inner = " ".join(re.split(r"\W+", items[0][1])[3:14])
    inner = re.sub("[a-z]", lambda m: m[0].upper(), inner)
    texts = [(1, f"{prose(60, 30)} {inner} {prose(61, 30)}"), (2, "a short, ITEM here short\nitem"), (3, prose(62, 200)), (4, None), (5, ""), (None, "short item")]
    table = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, n_words int")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    rows = {r.doc_id: r for r in decontam.contamination(table, bench).collect()}
    for i, t in texts:
        w, hit, ids = split(t), set(), set()
        for item, own in items:
            v = split(own)
            for k in range(max(1, len(v) - 9) if v and item is not None else 0):
                part = v[k : k + 10]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        ids.add(str(item))
        want = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
        assert tuple(rows[i])[1:] == want
    assert rows[1].n_hit >= 10 and rows[1].n_items == 2
    kept = decontam.clean_documents(table, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == table.columns
    spans = decontam.find_spans(table, bench).collect()
    assert {texts[1][1][r.start : r.end].lower() for r in spans if r.doc_id == 2} == {"short, item", "short\nitem"}
    assert decontam.contamination(none, bench).count() == 0 and decontam.contamination(table, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_parts(spark):
    """A benchmark of many parts gives what one part gives, for documents hit by none, one or several."""
    bench = spark.createDataFrame([(k, prose(k, 20)) for k in range(9)], "item_id long, text string")
    table = spark.createDataFrame([(k, prose(k % 12, 20) + prose(100 + k, 30)) for k in range(24)], "doc_id long, text string")
    whole = sorted(map(tuple, decontam.contamination(table, bench).collect()))
    assert len(list(decontam.parts_of(bench, 300))) > 3
    assert sorted(map(tuple, decontam.contamination(table, bench, part_bytes=300).collect())) == whole
    spans = lambda size: sorted((r.doc_id, r.start, r.end, *sorted(r.item_ids)) for r in decontam.find_spans(table, bench, part_bytes=size).collect())
    assert spans(300) == spans(1 << 20)
    assert sorted(decontam.clean_documents(table, bench, part_bytes=300).collect()) == sorted(decontam.clean_documents(table, bench).collect())
