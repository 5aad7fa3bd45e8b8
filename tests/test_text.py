"""Scalar text functions on literal cases."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import chunk, clean, normalize, route, structure, text, vector


@pytest.fixture
def one(spark):
    def run(value, f):
        return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first().o

    return run


@pytest.mark.parametrize(
    ("given", "options", "expected"),
    [
        ("أإآا", {}, "اا"), ("أ", {"elongation": False}, "ا"), ("إ", {"elongation": False}, "ا"), ("ى", {}, "ي"), ("مُحَمَّد", {}, "محمد"),
        ("مــــرحبا", {}, "مرحبا"), ("شكرااااااا", {}, "شكراا"), ("گچپ", {}, "كجب"), ("مُحَمَّدأگ", {}, "محمداك"), ("أُ", {"diacritics": False, "yaa": False}, "اُ"),
        ("  مرحبا  ", {}, "مرحبا"), ("10000 www. ---", {}, "100 ww. --"), ("", {}, ""), (None, {}, None), (" ", {}, ""),
    ],
)
def test_normalized(one, given, options, expected):
    assert one(given, lambda c: normalize.normalized(c, **options)) == expected


def test_page_text_unification(one):
    assert one("ٱىةؤئ", normalize.unified_page_text) == "ايهءء"


@pytest.mark.parametrize(
    ("given", "size", "overlap", "least", "expected"),
    [
        ("aaaa bbbb. cccc dddd! eeee ffff. gggg", 20, 5, 5, ["aaaa bbbb", "bbbb cccc dddd", "dddd eeee ffff", "ffff gggg"]),
        ("x" * 30 + ". yy", 20, 5, 5, ["x" * 30, "xxxx yy"]),
        ("a. b", 100, 0, 10, []),
        ("one two? three, four. five", 100, 0, 1, ["one two? three, four five"]),
        ("", 100, 20, 10, []),
        ("this is one sentence.", 100, 20, 10, ["this is one sentence"]),
    ],
)
def test_sentence_chunks(one, given, size, overlap, least, expected):
    assert one(given, lambda c: chunk.sentence_chunks(c, size, overlap, least)) == expected


def plain_chunks(body, size, overlap, least):
    import re

    out, now = [], ""
    for s in (x.strip() for x in re.split("[.؟!،]", body)):
        if not s:
            continue
        if len(now) + len(s) + 1 < size:
            now += s + " "
        else:
            if len(now) >= least:
                out.append(now.strip())
            now = (now[-overlap:] if overlap else "") + s + " "
    return out + [now.strip()] * (len(now) >= least)


def test_chunks_against_a_plain_fold(spark):
    import random

    r = random.Random(0)
    rows = [(i, "".join(r.choice(["word ", "a", ". ", "! ", "، ", "\n", "longer piece of text "]) for _ in range(r.randint(0, 200)))) for i in range(60)]
    got = {x.i: x.c for x in spark.createDataFrame(rows, "i int, t string").select("i", chunk.sentence_chunks("t", 60, 15, 20).alias("c")).collect()}
    assert all(got[i] == plain_chunks(t, 60, 15, 20) for i, t in rows)


@pytest.mark.parametrize(
    ("size", "overlap", "expected"),
    [(14, 1, ["r1|aaaa\nr2|bbbb", "r2|bbbb\nr3|cccc", "r3|cccc\nr4|dddd"]), (14, 0, ["r1|aaaa\nr2|bbbb", "r3|cccc\nr4|dddd"]), (21, 1, ["r1|aaaa\nr2|bbbb\nr3|cccc", "r3|cccc\nr4|dddd"])],
)
def test_row_chunks(one, size, overlap, expected):
    assert one("r1|aaaa\nr2|bbbb\nr3|cccc\nr4|dddd", lambda c: chunk.row_chunks(c, size, overlap)) == expected


def test_table_chunks(one):
    body = "Some words before. More of them.\n| a | b |\n| c | d |\nafter the table"
    got = one(body, lambda c: chunk.table_chunks(c, 0, 1))
    assert [(x.content_type, x.chunking_strategy, x.chunk_index) for x in got] == [("text", None, None), ("table", "table_preserved", 1), ("text", None, None)]
    big = "\n".join(f"| row {i} | value number {i} |" for i in range(52))
    rows = one(big, lambda c: chunk.table_chunks(c))
    assert len(rows) > 1 and all(len(x.text) < 1000 and x.chunk_size_used == 250 for x in rows)
    assert "\n".join(x.text for x in rows).count("row 51") == 1


def test_section_chunks(one):
    got = one("before it\nFirst header line\n\nbody of one. end\nSecond header line\nThird header line\nbody of three", lambda c: chunk.section_chunks(c, F.array(F.lit(1), F.lit(4), F.lit(5)), 0, 1))
    assert [(x.section_index, x.section_header, x.chunk_index, x.text) for x in got] == [
        (0, None, 0, "before it"), (1, "First header line", 1, "body of one end"), (2, "Third header line", 2, "body of three"),
    ]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Page 1\n\nfirst para is here\n\nPage 2\n\nsecond para is here", "first para is here second para is here"),
        ("keep this line\nwww.example-site.com\nhttps://another-site.org/x\n© 2025 Someone\n---\nanother kept line", "keep this line\nexample-site.com\nanother-site.org/x another kept line"),
        ("Page 3 of the story goes on\nkeep this line please", "keep this line please"),
        ("head line xx\nbody one here\nhead line xx\nbody two here\nhead line xx\nbody three here", "body one here\nbody two here\nbody three here"),
        ("short\nthis line is long enough", "this line is long enough"),
        ("zero​width here\x07ok", "zero width here ok"),
        ("", ""),
    ],
)
def test_cleaned(one, given, expected):
    assert one(given, clean.cleaned) == expected


def test_cleaning_stats(spark):
    row = spark.createDataFrame([("12\nthe one line that stays",), ("",)], "t string").select(clean.cleaning_stats("t", clean.cleaned("t")).alias("s")).collect()
    assert (row[0].s.original_length, row[0].s.cleaned_length, row[0].s.num_pages_detected) == (26, 23, 1)
    assert tuple(row[1].s) == (0, 0, 0.0, None)


def test_structure(one):
    s = one("A title of a section\n\ntext here.\n- item\n| a | b |", structure.structure)
    assert (s.has_tables, s.has_lists, s.has_headers, s.header_positions) == (True, True, True, [0])
    assert one("| a | b | c |\n| d | e | f |", structure.content_type) == "table"
    assert one("- a\n- b\n- c\n- d", structure.content_type) == "list"
    assert one("plain words", structure.content_type) == "text"


@pytest.mark.parametrize(("source", "kind", "body", "expected"), [("document.pdf", None, "x", True), ("a.txt", "PDF", "x", True), ("document.txt", None, "x", False), (None, None, "Page 3\n\n\n\nx", True), (None, None, "Page 3", False)])
def test_is_pdf(spark, source, kind, body, expected):
    row = spark.createDataFrame([(source, kind, body)], "s string, k string, t string").select(structure.is_pdf("t", "s", "k").alias("o")).first()
    assert row.o is expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("مرحبا", "greeting"), ("أهلا", "greeting"), ("السلام عليكم", "greeting"), ("صباح الخير", "greeting"), ("HELLO", "greeting"), ("hi", "greeting"), ("good morning", "greeting"),
        ("كيف حالك؟", "greeting"), ("ما اسمك؟", "simple"), ("شكراً", "simple"), ("what is your name", "simple"), ("who are you", "simple"), ("thank you", "simple"),
        ("5 + 3", "calculator"), ("15×5", "calculator"), ("30÷6", "calculator"), ("احسب 5 + 3", "calculator"), ("ما هو حاصل 5 في 6", "calculator"), ("2020-01", "calculator"),
        ("ما هي عاصمة مصر؟", "rag"), ("", "rag"), ("random complex query", "rag"), ("مرحبا، ما هي عاصمة مصر؟", "rag"),
    ],
)
def test_route(one, given, expected):
    assert one(given, route.route) == expected


def test_small_helpers(one):
    assert one("x" * 200, text.excerpt) == "x" * 200 and one("x" * 201, text.excerpt) == "x" * 200 + "..."
    assert one('[{"text":"ab"},"cd"]', text.flatten_content) == "abcd" and one("plain", text.flatten_content) == "plain"
    assert one("a", text.file_hash) == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"


def test_similarity_map(spark):
    rows = spark.createDataFrame([(-3.0,), (-0.5,), (0.0,), (0.4,), (1.7,)], "s double").select(vector.mapped_similarity("s").alias("o")).collect()
    assert [r.o for r in rows] == [-1, 0.25, 0, 0.4, 1]
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(vector.unit("a").alias("u"), vector.unit("b").alias("z"), vector.cosine("a", "b").alias("c")).first()
    assert v.u == pytest.approx([0.6, 0.8]) and v.z == [0, 0] and v.c == 0


def test_long_runs_of_white_space_take_no_square_of_their_length(spark):
    """F10 F11 F18: the ends alone are looked at; a search for white space at the end went over an inner run once for each of its characters."""
    inner = "a" + " " * 300_000 + "b"
    odd = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    df = spark.createDataFrame([(inner,), (odd + "x" + odd + "y" + odd,), (odd,), (None,), ("​x",)], "t string")
    began = time.perf_counter()
    assert [r[0] for r in df.select(text.strip("t")).collect()] == [inner, "x" + odd + "y", "", None, "​x"]
    assert time.perf_counter() - began < 15


def test_embeddings_of_odd_words_equal_the_plain_count(spark):
    """F10 F11: parts between ASCII signs that hold no word or several, capitals that become two characters, empty texts."""
    rows = ["One two_two, one", "a—b «c»… – ٣٤ x²", "İstanbul ΣΑΣ ΣΑΣ.", "", None, "—", "naïve café naïve"]

    def plain(t):
        v = np.bincount([zlib.crc32(w.encode()) % 64 for w in re.split(r"[\W_]+", (t or "").lower()) if w], minlength=64).astype(float)
        return v / (np.linalg.norm(v) or 1)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", vector.hashed_embedding("t").alias("v")).collect()
    assert all(list(r.v) == list(plain(rows[r.i])) for r in got) and len(got) == len(rows)
