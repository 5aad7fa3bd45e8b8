"""Formats, extractors, JSON corpora, pages and exports on small files made here."""

import io
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import providers
from corpusflow.plans import file_queries, source_queries
from corpusflow.plans.common import ORACLES
from corpusflow.sources import docx, files, formats, html, image, jsons, markdown, pdf, plaintext, reading, sinks, web


@pytest.mark.parametrize(
    ("content", "name", "expected"),
    [
        (b"%PDF-1.4", "fake.txt", "pdf"), (b"<!DOCTYPE html><p>", "webpage.txt", "html"), (b"\x89PNG\r\n\x1a\n", "x.txt", "image"), (b"", "test.txt", "text"),
        (b"PK\x03\x04", "a.docx", "docx"), (b"\x00\x01\x00", "x.dat", "unknown"), (b"words", "README.TXT", "text"), (b"words", "a.md", "text"), (b"", ".pdf", "unknown"), (b'{"a": 1}', "x", "json"),
    ],
)
def test_detection(spark, content, name, expected):
    row = spark.createDataFrame([(bytearray(content), name)], "c binary, n string").select(formats.detected("c", "n").alias("o")).first()
    assert row.o == expected


def as_files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c), len(c)) for i, c in enumerate(contents)], "path string, content binary, length long")


def test_plain_text(spark):
    arabic = "مرحبا بكم في هذا النص العربي الطويل"
    rows = plaintext.extracted(as_files(spark, b"1. one\n2. two\n- three\n", arabic.encode("windows-1256"), b"a\r\nb\rc\n", b"x\x00y", b"", b"plain words")).orderBy("path").collect()
    assert rows[0].content_type == "LIST" and rows[0].line_endings == "unix" and rows[0].encoding == "ascii" and rows[0].converted and rows[0].line_count == 3
    assert rows[0].structure.num_numbered_items == 2 and rows[0].structure.num_bullet_items == 1
    assert rows[1].text == arabic and rows[1].encoding == "windows-1256" and rows[1].quality == "medium"
    assert rows[2].line_endings == "mixed" and rows[3].quality == "low" and any("NUL" in w for w in rows[3].warnings)
    assert rows[4].text == "" and any("empty" in w for w in rows[4].warnings) and rows[5].content_type == "TEXT"
    big = plaintext.extracted(as_files(spark, b"x" * 100), most=50).first()
    assert big.status == "FAILED" and any("exceeds maximum" in w for w in big.warnings)


def test_html(spark):
    page = """<html dir="rtl"><head><title> T &amp; U </title><meta name="author" content="me"><meta property="og:title" content="og"></head><body><nav><a href="/n">nav</a></nav>
    <h2>Second</h2><h1>First</h1><p>para<p>next &lt;b&gt; <a href="/l">link</a><!-- gone --><table><tr><th>H1</th><td>c1</td></tr><tr><td colspan=2>c2</td></tr></table><ul><li>a<li>b</ul><script>x()</script></body></html>"""
    row = html.extracted(as_files(spark, page.encode(), b"")).orderBy("path").collect()
    r = row[0]
    assert r.title == "T & U" and r.meta == {"author": "me", "og_title": "og"} and r.is_rtl and r.content_type == "TABLE"
    assert [(h.level, h.text) for h in r.headings] == [(1, "First"), (2, "Second")] and [(x.url, x.text) for x in r.links] == [("/l", "link")]
    assert "[TABLE]\n[HEADER: H1] | c1\nc2\n[/TABLE]" in r.text and "gone" not in r.text and "x()" not in r.text and "nav" not in r.text
    assert r.num_paragraphs == 2 and r.num_lists == 1 and row[1].text == "" and row[1].warnings


def test_crawled_pages(spark):
    page = "<title>T</title><body><div class='shadow'>ad text</div><main><h1>Head</h1><p>Body text</p><p>All rights reserved 2024</p></main><footer>f</footer></body>"
    table = spark.createDataFrame([(1, "http://x/ar/mobile", page), (2, "http://x/y", "<body></body>")], "page_id long, url string, html string")
    got = web.documents(html.pages(table)).collect()
    assert len(got) == 1 and got[0].text == "T\n\nHead\nBody text"
    assert got[0].metadata == {"source": "http://x/ar/mobile", "title": "T", "category": "mobile", "language": "ar"}


def test_markdown(spark):
    body = b"# Title\n\n## A\n\n```Python\n# not a header\n```\n\n- a\n  - b\n- c\n\n1. x\n2. y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n[l](u) ![i](v) `code`\n\nSetext\n======\n"
    r = markdown.extracted(as_files(spark, body)).first()
    assert r.content_type == "CODE" and r.languages == ["python"] and r.num_code_blocks == 1 and (r.headers.h1, r.headers.h2) == (2, 1) and (r.min_level, r.max_level) == (1, 2)
    assert (r.num_unordered, r.num_ordered, r.has_nested_lists) == (2, 1, True) and r.num_tables == 1 and (r.num_links, r.num_images) == (1, 1) and r.has_inline_code
    assert r.text == body.decode() and r.line_count == body.count(b"\n") + 1 and r.quality == "high"


def test_markup_queries_read_all(spark, tmp_path):
    texts = ["# Title\n\n- a\n- b\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "```python\nx\n```\n", "[l](u) text\n", "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<h1>A</h1><h2>B</h2><h6>C</h6>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: r for r in source_queries.markdown_extract(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(5)] == texts and got[0].headers.h1 == 1
    for field, pattern in {"num_unordered": r"(?m)(?:^- .*\n)+", "num_tables": r"(?m)^\|---", "num_code_blocks": r"(?m)^```\w", "num_links": r"\]\("}.items():
        assert [got[i][field] for i in range(5)] == [len(re.findall(pattern, t)) for t in texts]
    assert [(r.level, r.text) for r in source_queries.html_headings(spark, str(tmp_path)).collect()] == [(1, "A"), (2, "B"), (6, "C")]


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    doc = f"<w:document {w}><w:body>{p('Head', 'Heading1')}{p('Words')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl>{p('More', 'Heading2')}<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", doc)
    return out.getvalue()


def test_docx(spark):
    rows = docx.extracted(as_files(spark, word_file(), bytes.fromhex("D0CF11E0A1B11AE1"), b"broken")).orderBy("path").collect()
    r = rows[0]
    assert r.headings == ["Head", "More"] and r.heading_levels == [1, 2] and r.table_count == 1 and "[TABLE 1]\na\tb\n[/TABLE]" in r.text and r.has_track_changes
    assert "\n# Head\n" in r.text and "new" in r.text and "old" not in r.text and r.content_type == "HEADING"
    assert rows[1].text == "" and rows[1].warnings and rows[2].status == "FAILED"


def test_docx_files_like_sql(spark, tmp_path):
    """Texts without words, white space and characters of all kinds, negative ids and nulls, against the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["", " \t\n", "a\n\u00a0\n \nb", "a\ufffeb \uffff", "x\x0b\r\x01y\x7f\x85", "<&>]]>\n\n# x", "\U0001f600", None]
    langs = ["en", " en ", "", "a\r\nb\x01\ufffe", "\u00a0", None]
    made = [(t, lang) for t in texts for lang in langs]
    rows = [(i, *x) for i, x in enumerate(made)] + [(-i, *x) for i, x in enumerate(made, 1)] + [(None, t, "en") for t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = file_queries.docx_files(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['docx_files']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_docx_kinds_and_space(spark):
    """Tables make the kind where they outnumber headings; white space that isn't ASCII's makes a paragraph blank, unless it is kept."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p(' c ')}</w:tc></w:tr></w:tbl>"

    def read(body, **how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
        return docx.read(out.getvalue(), **how)

    assert [read(x)[1] for x in (table, table + p("a"), table + p("a") * 2, p("H", "Heading1") + table, p("H", "Heading1") + table * 2)] == ["TABLE", "TABLE", "TEXT", "HEADING", "TABLE"]
    assert read(p("\u00a0") + table)[5] == 0 and read(p("\u00a0") + table)[0] == "\n[TABLE 1]\nc\n[/TABLE]\n"
    assert read(p("\u00a0") + p(" ") + table, keep_space=True)[0] == "\u00a0\n\n[TABLE 1]\n c \n[/TABLE]\n"
    assert read('<w:p><w:r><w:t>a</w:t><w:sym w:char="FFFE"/><w:sym w:font="F" w:char="F020"/></w:r></w:p>')[0] == "a\ufffe"


def pdf_file(*pages, flate=False):
    out, n = [b"%PDF-1.4"], 1
    for body in pages:
        s = b"BT /F1 12 Tf (" + body.replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET"
        data, extra = (zlib.compress(s), b"/Filter /FlateDecode ") if flate else (s, b"")
        out.append(b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj" % (n, n + 1))
        out.append(b"%d 0 obj << %s/Length %d >> stream\n%s\nendstream endobj" % (n + 1, extra, len(data), data))
        n += 2
    out.append(b"%d 0 obj << /Title (A title) /Author (me) >> endobj\n%%%%EOF" % n)
    return b"\n".join(out)


def test_pdf(spark):
    long = b"A first page with enough words (in brackets) to count as a page of text, which goes on and on. " * 2
    rows = pdf.extracted(as_files(spark, pdf_file(long, b"second page with words", flate=True), pdf_file(b"only one"), b"nothing")).orderBy("path").collect()
    assert len(rows[0].pages) == 2 and "(in brackets)" in rows[0].text and rows[0].info == {"title": "A title", "author": "me"} and rows[0].quality.total_pages == 2
    assert rows[1].status == "EXTRACTED" and rows[2].status == "FAILED" and rows[2].warnings
    cut = pdf.extracted(as_files(spark, pdf_file(long, long)), max_pages=1).first()
    assert len(cut.pages) == 1


def test_pdf_page_tree(spark):
    """Pages in the order of the tree, whatever their numbers; an object stream; a tree that runs in a circle."""
    for number in range(12):
        data = file_queries._pdf_file(number, "first line\n\nthird ≥ line")
        pages, info, warnings = pdf.read(data)
        assert (pages, info, warnings) == (["first line\n\nthird ≥ line", f"Second page of document {number}"], {"title": f"Document {number}"}, [])
        assert pdf.read(data, 1)[0] == pages[:1]
    circle = b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [1 0 R 2 0 R] >> endobj\n2 0 obj << /Type /Page >> endobj\n3 0 obj << /Type /Catalog /Pages 1 0 R >> endobj\ntrailer << /Root 3 0 R >>"
    assert pdf.read(circle)[0] == [""]


def test_image(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 800, 600) + b"\x08\x02"
    vision = lambda data, prompt, page: "TEXT_DOCUMENT" if "Reply" in prompt else "word " * 700
    r = image.extracted(as_files(spark, png), vision).first()
    assert (r.width, r.height, r.content_type) == (800, 600, "IMAGE_TEXT") and r.confidence == pytest.approx(3500 / 4800)
    def failing(data, prompt, page):
        raise ValueError("no answer")

    bad = image.extracted(as_files(spark, png, png), failing).collect()
    assert len(bad) == 2 and all(b.text == "" and any("no answer" in w for w in b.warnings) for b in bad)
    none = image.extracted(as_files(spark, png)).first()
    assert none.text == "" and none.warnings
    row = spark.createDataFrame([(4800, 700, 800, 600, "text"), (10, 2, 800, 600, "text"), (1200, 200, 800, 600, "text"), (25, 3, 10, 10, "description")], "c int, w int, x int, y int, m string")
    got = [r.o for r in row.select(image.confidence(F.col("c"), F.col("w"), F.col("x"), F.col("y"), F.col("m")).alias("o")).collect()]
    assert got == pytest.approx([1.0, 10 / 4800 * 0.5, 0.25, 0.7])


def test_files_end_to_end(spark, tmp_path):
    for name, data in {"a.txt": b"plain words", "b.html": b"<html><body><p>hi</p></body></html>", "c.docx": word_file(), "d.pdf": pdf_file(b"page text is here"), "e.csv": b"", "f.bin": b"\x00\x01"}.items():
        (tmp_path / name).write_bytes(data)
    found, rejects = files.read(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.status) for r in files.documents(found).collect()}
    assert got == {"a.txt": ("text", "EXTRACTED"), "b.html": ("html", "EXTRACTED"), "c.docx": ("docx", "EXTRACTED"), "d.pdf": ("pdf", "EXTRACTED"), "f.bin": ("unknown", "UNSUPPORTED")}
    assert rejects.count() == 0
    _, large = files.read(spark, str(tmp_path), most=20)
    assert {r.status for r in large.collect()} == {"TOO_LARGE"} and large.count() == 3


def test_json_corpora(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"timestamp": "t", "pages": [{"url": "u", "title": "T", "text": " x ", "source": "own", "n": 3}, {"url": "v", "text": "  "}]}')
    (tmp_path / "b.json").write_text('[{"text": "y", "metadata": {"k": "v"}}, {"text": "z", "metadata": 5}, {"metadata": {}}]')
    (tmp_path / "c.json").write_text('{"pages": 3')
    loaded = jsons.load(spark, str(tmp_path))
    got = {r.text: r.metadata for r in jsons.documents(loaded).collect()}
    assert got == {"x": {"url": "u", "title": "T", "source": "own", "n": "3"}, "y": {"k": "v", "source": "json"}, "z": {"source": "json"}}
    with pytest.raises(ValueError, match="unknown"):
        jsons.documents(loaded, "other")


def test_tables_and_exports(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "chunk_id long, text string, embedding array<double>"
    assert sinks.ensure(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0])], schema)
    sinks.append_chunks(rows, path, 2)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="another length"):
        sinks.append_chunks(rows, path, 3)
    sinks.clear(spark, path, schema)
    assert spark.read.schema(schema).parquet(path).count() == 0
    points = spark.createDataFrame([(None, "", "t1", {"source": "s", "title": "T", "k": "v"}), ("x", "p", "t2", {}), (None, "", "", {})], "session_id string, page_content string, text string, metadata map<string,string>")
    out = sinks.exportable(points)
    assert [r.text for r in out.collect()] == ["t1"] and sinks.exportable(points, True).count() == 2
    import json

    one = json.loads(sinks.export_envelope(out, "now").first().json)
    assert one == {"timestamp": "now", "pages_scraped": 1, "pages": [{"url": "s", "title": "T", "text": "t1", "k": "v"}]}
    with pytest.MonkeyPatch.context() as patch, pytest.raises(ValueError, match="export_lines"):
        patch.setattr(sinks, "MAX_ENVELOPE_BYTES", 10)
        sinks.export_envelope(out, "now")
    sinks.export_lines(out, str(tmp_path / "lines"))
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first().value)["text"] == "t1"


def test_upsert(spark, tmp_path):
    """Rows replace those with their key, new keys come beside them, and buckets without new rows stay."""
    path, schema = str(tmp_path / "chunks"), "chunk_id long, text string, embedding array<double>"
    put = lambda *rows: sinks.upsert_chunks(spark.createDataFrame([(i, t, [1.0]) for i, t in rows], schema), path, 1, buckets=4)
    held = lambda: sorted((r.chunk_id, r.text) for r in spark.read.parquet(path).collect())
    put()
    assert spark.read.schema(schema).parquet(path).count() == 0
    put(*((i, "old") for i in range(20)))
    put((3, "new"), (3, "new"), (30, "more"))
    assert held() == sorted([(i, "old") for i in range(20) if i != 3] + [(3, "new"), (30, "more")])
    put()
    assert len(held()) == 21
    with pytest.raises(Exception, match="another length"):
        sinks.upsert_chunks(spark.createDataFrame([(1, "a", [1.0, 2.0])], schema), path, 1)
    assert len(held()) == 21


def test_registered_extractors_are_used(spark):
    rows = as_files(spark, b"abc").withColumn("format", F.lit("shout"))
    assert files.documents(rows).first().status == "UNSUPPORTED"
    loud = lambda x: x.select("path", F.upper(F.col("content").cast("string")).alias("text"), F.lit("TEXT").alias("content_type"), F.lit("EXTRACTED").alias("status"), F.array().cast("array<string>").alias("warnings"))
    providers.register("extractor", "shout", loud)
    try:
        got = files.documents(rows).first()
        assert (got.text, got.status, got.format) == ("ABC", "EXTRACTED", "shout")
    finally:
        del files.EXTRACT["shout"]


def test_references_without_semicolon(spark):
    page = "<body><h1>a &amp; b &amp</h1><h2>&lt;c&g &#x27; &#x2</h2><a href='/x?a=1&b=2'>&quot</a></body>".encode()
    cut, whole = (html.extracted(as_files(spark, page), closed=c).first() for c in (True, False))
    assert [h.text for h in cut.headings] == ["a & b &amp", "<c&g ' &#x2"]
    assert cut.links == [("/x?a=1&b=2", "&quot")]
    assert whole.headings[0].text == "a & b &" and whole.links == [("/x?a=1&b=2", '"')]


def test_results_of_a_batch_are_not_held_together(spark):
    """Of thousands of rows in one Arrow batch only some results lie in the worker's memory at once."""
    rows = spark.range(0, 2000, 1, 1).select(F.col("id").alias("path"), F.col("id").cast("string").alias("content"))
    alive = [0]

    def read(content):
        class Text(str):
            def __new__(cls, x):
                alive[0] += 1
                return super().__new__(cls, x)

            def __del__(self):
                alive[0] -= 1

        return Text(f"{content} {alive[0]}")

    got = [r.read.split() for r in reading.with_read(rows, "read", read, "string", "content").orderBy("path").collect()]
    assert [int(r[0]) for r in got] == list(range(2000))
    assert max(int(r[1]) for r in got) <= 2 * reading.ROWS


def test_upsert_deals_each_row_once(spark, tmp_path, monkeypatch):
    """new rows and what stays of the old ones are shuffled once each; a row without a key replaces none."""
    plans, plain = {}, sinks.saved

    def saved(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(bucket")
        plans[name, "all"] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        return plain(df, name)

    monkeypatch.setattr(sinks, "saved", saved)
    path, schema = str(tmp_path / "once"), "chunk_id long, text string"
    put = lambda *rows: sinks.upsert_chunks(spark.createDataFrame(list(rows), schema), path, buckets=4)
    put((1, "a"), (2, "b"), (None, "n"))
    put((2, "c"), (2, "c"), (None, "m"), (3, "d"))
    assert sorted((r.chunk_id or 0, r.text) for r in spark.read.parquet(path).collect()) == [(0, "m"), (0, "n"), (1, "a"), (2, "c"), (3, "d")]
    assert plans == {(n, "all") if x else n: 1 for n in ("upsert-new", "upsert-kept") for x in (0, 1)}
