"""Queries over scalar text functions: normalisation, cleaning, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import clean, normalize, structure, text
from corpusflow.plans.common import query, strip_sql, table

_SCRIPT = "translate(text, 'aeiou', 'أىآـگ')"


@query(rf"""SELECT doc_id, {strip_sql("translate(translate(translate(" + _SCRIPT + ", 'إأآ', 'ااا'), 'ى', 'ي'), 'گچپژـ', 'كجبز')")} AS text FROM documents""")
def normalize_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules but the shortening, on text in which vowels stand for letters of the script."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SCRIPT).alias("text"))
    return docs.select("doc_id", normalize.normalized("text", elongation=False).alias("text"))


@query(rf"""
    WITH c AS (SELECT doc_id, i, text[i] AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c, island ORDER BY i) AS rn FROM g)
    SELECT doc_id, {strip_sql("string_agg(c, '' ORDER BY i)")} AS text FROM r WHERE rn <= 2 OR c = chr(10) GROUP BY doc_id""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", normalize.normalized("text").alias("text"))


_PAGES = "concat('Page 7', chr(10), 'Running header of all pages', chr(10), text, chr(10), 'Running header of all pages', chr(10), '---', chr(10), 'www.example.org/a path of it', chr(10), ' 3/4 ', chr(10), '  Running header of all pages', chr(10), '12', chr(10), 'last words', chr(9), chr(9), chr(9), 'after a gap')"
_PAGE_NUMBER = r"^(?:\s*\d+\s*$|\s*[٠-٩]+\s*$|صفحة\s+\d+|Page\s+\d+|\d+\s*/\s*\d+$|[٠-٩]+\s*/\s*[٠-٩]+$)"
_CLEAN = rf"""
    WITH p AS (SELECT doc_id, {_PAGES} AS text FROM documents),
    l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches({strip_sql("x")}, '{_PAGE_NUMBER}')) AS ls FROM p),
    s AS (SELECT doc_id, text, ls, list_transform(ls, lambda x: {strip_sql("x")}) AS ss FROM l),
    e AS (SELECT doc_id, text, unnest(ls) AS line, unnest(ss) AS s, generate_subscripts(ls, 1) AS i FROM s),
    k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM e),
    j AS (SELECT doc_id, any_value(text) AS before, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE n < 3 OR length(s) < 10 GROUP BY doc_id),
    r AS (SELECT doc_id, before, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(?m)^[\-_=]{{3,}}$', '', 'g'), '(?m)^\s*\|\s*\|\s*$', '', 'g'), '(?m)^©.*$', '', 'g'), '(?m)^\s*www\.', '', 'g'), '(?m)^\s*http[s]?://', '', 'g') AS text FROM j),
    a AS (SELECT doc_id, before, regexp_replace(text, '\s{{3,}}', ' ', 'g') AS text FROM r),
    f AS (SELECT doc_id, before, {strip_sql(f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: length(x) >= 10), chr(10))")} AS text FROM a)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they come from extracted pages: with page numbers, rules, links and a running header."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAGES.replace("chr(10)", "'\\n'").replace("chr(9)", "'\\t'")).alias("text"))


@query(_CLEAN + " SELECT doc_id, text FROM f")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", clean.cleaned("text").alias("text"))


@query(
    _CLEAN + rf""" SELECT f.doc_id, length(before)::BIGINT AS original_length, length(f.text)::BIGINT AS cleaned_length,
    round(1 - length(f.text) / length(before), 6) AS reduction_ratio,
    len(list_filter(string_split(before, chr(10)), lambda x: regexp_matches({strip_sql("x")}, '{_PAGE_NUMBER}')))::BIGINT AS num_pages FROM f"""
)
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).withColumn("after", clean.cleaned("text"))
    s = rows.select("doc_id", clean.cleaning_stats("text", "after").alias("s"))
    return s.select("doc_id", F.col("s.original_length").cast("long").alias("original_length"), F.col("s.cleaned_length").cast("long").alias("cleaned_length"), F.round("s.reduction_ratio", 6).alias("reduction_ratio"), F.col("s.num_pages_detected").cast("long").alias("num_pages"))


@query(rf"""
    WITH p AS (SELECT doc_id, {_PAGES} AS text FROM documents),
    e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM p)
    SELECT doc_id, i::BIGINT AS line, regexp_extract(x, '\d+') AS digits FROM e WHERE regexp_matches({strip_sql("x")}, '{_PAGE_NUMBER}')""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pages(spark, sf_dir).select("doc_id", F.explode(clean.page_numbers("text")).alias("p"))
    return found.select("doc_id", F.col("p.line").cast("long").alias("line"), F.col("p.digits").alias("digits"))


@query(rf"""
    WITH e AS (SELECT doc_id, {strip_sql("unnest(string_split(text, chr(10)))")} AS line FROM documents)
    SELECT doc_id, line FROM e WHERE length(line) >= 10 GROUP BY doc_id, line HAVING count(*) >= 3""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(clean.repeated_lines(text.lines("text"))).alias("line"))


_SHAPED = "replace(text, '.' || chr(10), chr(10) || chr(10))"
_ITEMS = r"^(?:\s*[-•*]|\s*\d+[.)]\s|\s*[٠-٩]+[.)]\s"


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines after their paragraphs, so that some lines look like headers."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit("\n\n")).alias("text"))


@query(rf"""
    WITH p AS (SELECT doc_id, {_SHAPED} AS text FROM documents),
    l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}) AS ss, string_split(text, chr(10)) AS ls FROM p),
    h AS (SELECT doc_id, text, ls, list_filter(range(1, len(ss)), lambda i: length(ss[i]) BETWEEN 11 AND 79 AND right(ss[i], 1) NOT IN ('.', '؟', '!', '،') AND ss[i + 1] = '') AS hs FROM l)
    SELECT doc_id, regexp_matches(text, '\|.*\||[-─]{{3,}}|\t.*\t') AS has_tables,
           len(list_filter(ls, lambda x: regexp_matches(x, '{_ITEMS}|\s*[أ-ي][.)]\s)'))) > 0 AS has_lists,
           len(hs) > 0 AS has_headers, len(hs)::BIGINT AS section_count, coalesce(list_sum(hs) - len(hs), 0)::BIGINT AS position_sum
    FROM h""")
def detect_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shaped(spark, sf_dir).select("doc_id", structure.structure("text").alias("s"))
    total = F.aggregate("s.header_positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("doc_id", "s.has_tables", "s.has_lists", "s.has_headers", F.col("s.section_count").cast("long").alias("section_count"), total.alias("position_sum"))


@query(rf"""
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    k AS (SELECT doc_id, CASE WHEN length(text) - length(replace(text, '|', '')) >= 4 OR length(text) - length(replace(text, chr(9), '')) >= 4 THEN 'table'
        WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_ITEMS})'))) / len(ls) > 0.3 THEN 'list' ELSE 'text' END AS content_type FROM l)
    SELECT doc_id, content_type, CASE content_type WHEN 'table' THEN 250 WHEN 'list' THEN 300 ELSE 400 END::BIGINT AS chunk_size FROM k""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", structure.content_type("text").alias("content_type"))
    return rows.withColumn("chunk_size", structure.chunk_size("content_type").cast("long"))


@query(r"""
    SELECT doc_id, source = 'src3.pdf' OR (regexp_matches(text, 'Page\s+\d+')::INT + regexp_matches(text, 'صفحة\s+\d+')::INT + regexp_matches(text, '\|.*\|.*\|')::INT
        + regexp_matches(text, '[\n\r]{3,}')::INT) >= 2 AS is_pdf
    FROM (SELECT doc_id, source || '.pdf' AS source, CASE WHEN doc_id % 2 = 0 THEN 'Page 3' || chr(10) || text ELSE text END AS text FROM documents)""")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("source") == "src3", "A.PDF").otherwise("a.txt").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Page 3\n"), "text")).otherwise(F.col("text")).alias("text"))
    return rows.select("doc_id", structure.is_pdf("text", "source").alias("is_pdf"))


@query("""
    SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS excerpt,
           CASE WHEN length(text) > 100 THEN left(replace(text, chr(10), ' '), 100) || '...' ELSE replace(text, chr(10), ' ') END AS preview FROM documents""")
def source_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt("text").alias("excerpt"), text.preview("text").alias("preview"))


@query("""
    SELECT sha256(encode(text)) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies, max(length(text))::BIGINT AS chars FROM documents GROUP BY 1""")
def file_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.file_hash("text").alias("file_hash"), F.length("text").alias("n"))
    return rows.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").cast("long").alias("chars"))
