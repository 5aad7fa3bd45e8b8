"""Queries over chunkers and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import chunk, structure
from corpusflow.operators import chunking, evaluate, pipeline
from corpusflow.plans.common import chunks_sql, query, table
from corpusflow.plans.text_queries import _shaped


@query(f"WITH {chunks_sql('documents')} SELECT doc_id, (i - 1)::BIGINT AS chunk_index, len(chunks)::BIGINT AS total_chunks, chunks[i] AS text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM cut)")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.sentence_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "text")


@query(f"WITH {chunks_sql('documents', '100', 20, 10)} SELECT source, sum(len(chunks))::BIGINT AS chunks, sum(list_sum(list_transform(chunks, lambda x: length(x))))::BIGINT AS chars FROM cut GROUP BY source")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of another size by source: only counts leave a task."""
    rows = table(spark, sf_dir, "documents").select("source", chunk.sentence_chunks("text", 100, 20, 10).alias("c"))
    chars = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("source", F.size("c").alias("n"), chars.alias("m")).groupBy("source").agg(F.sum("n").alias("chunks"), F.sum("m").alias("chars"))


@query(f"WITH {chunks_sql('documents', '512', 50, 50)} SELECT sum(len(chunks))::BIGINT AS chunks FROM cut")
def chunk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_estimate(table(spark, sf_dir, "documents"))


@query("""
    WITH l AS (SELECT doc_id, string_split(replace(text, ' | ', chr(10)), chr(10)) AS ls FROM documents),
    f AS (SELECT doc_id, list_reduce(
        list_concat([{'now': []::VARCHAR[], 'n': 0::BIGINT, 'out': []::VARCHAR[]}], list_transform(ls, lambda x: {'now': [x], 'n': length(x)::BIGINT, 'out': []::VARCHAR[]})),
        lambda a, b: CASE WHEN a.n + b.n > 250 AND len(a.now) > 0 THEN
            {'now': CASE WHEN len(a.now) > 1 THEN list_concat(a.now[-1:], b.now) ELSE b.now END, 'n': CASE WHEN len(a.now) > 1 THEN length(a.now[-1]) ELSE 0 END + b.n,
             'out': list_append(a.out, array_to_string(a.now, chr(10)))}
            ELSE {'now': list_concat(a.now, b.now), 'n': a.n + b.n, 'out': a.out} END) AS s FROM l),
    c AS (SELECT doc_id, CASE WHEN len(s.now) > 0 THEN list_append(s.out, array_to_string(s.now, chr(10))) ELSE s.out END AS chunks FROM f)
    SELECT doc_id, (i - 1)::BIGINT AS place, chunks[i] AS text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM c)""")
def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" | "), F.lit("\n")).alias("text"))
    return docs.select("doc_id", F.posexplode(chunk.row_chunks("text", 250, 100)).alias("place", "text")).withColumn("place", F.col("place").cast("long"))


_KINDS = r"""kinds AS (SELECT doc_id, text, CASE WHEN length(text) - length(replace(text, '|', '')) >= 4 OR length(text) - length(replace(text, chr(9), '')) >= 4 THEN 'table'
    WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(?:\s*[-•*]|\s*\d+[.)]\s|\s*[٠-٩]+[.)]\s)'))) / len(string_split(text, chr(10))) > 0.3 THEN 'list' ELSE 'text' END AS kind FROM documents),
    sized AS (SELECT *, CASE kind WHEN 'table' THEN 250 WHEN 'list' THEN 300 ELSE 400 END AS lim FROM kinds)"""


@query(f"""WITH {_KINDS}, {chunks_sql("(SELECT * FROM sized WHERE lim = 250)", "250")},
    other AS (WITH {chunks_sql("(SELECT * FROM sized WHERE lim = 300)", "300")} SELECT doc_id, kind, lim, chunks FROM cut),
    plain AS (WITH {chunks_sql("(SELECT * FROM sized WHERE lim = 400)", "400")} SELECT doc_id, kind, lim, chunks FROM cut),
    whole AS (SELECT doc_id, kind, lim, chunks FROM cut UNION ALL SELECT * FROM other UNION ALL SELECT * FROM plain)
    SELECT doc_id, kind AS content_type, lim::BIGINT AS chunk_size_used, (i - 1)::BIGINT AS chunk_index, chunks[i] AS text
    FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM whole)""")
def dynamic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.exploded(table(spark, sf_dir, "documents").select("doc_id", "text"), chunk.dynamic_chunks("text"))
    return rows.select("doc_id", "content_type", F.col("chunk_size_used").cast("long").alias("chunk_size_used"), F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by section; the tests compare them with a plain version."""
    docs = _shaped(spark, sf_dir).withColumn("h", structure.header_positions("text"))
    rows = chunking.exploded(docs.where(F.size("h") > 0), chunk.section_chunks("text", "h"))
    return rows.select("doc_id", "section_index", "section_header", "chunk_index", "text")


@query()
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks around tables; the tests compare them with a plain version."""
    rows = chunking.exploded(table(spark, sf_dir, "documents").select("doc_id", "text"), chunk.table_chunks("text"))
    return rows.select("doc_id", "content_type", "chunking_strategy", "chunk_index", "chunk_size_used", "text")


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page-aware chunking, with every third document declared a PDF."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "a.pdf").otherwise("a.txt").alias("source"))
    return chunking.page_documents(docs, "source")


@query("""
    WITH b AS (SELECT doc_id, doc_id % 50 AS batch_id, text, doc_id % 97 = 5 AS declared FROM documents)
    SELECT batch_id, CASE WHEN bool_or(declared) OR arg_min(regexp_matches(text, '\\|.*\\|.*\\|') AND regexp_matches(text, '[\\n\\r]{3,}'), doc_id) THEN 'pdf' ELSE 'text' END AS document_type
    FROM b GROUP BY batch_id""")
def batch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("batch_id"), F.col("doc_id").alias("place"), "text", F.lit("a.txt").alias("source"), F.when(F.col("doc_id") % 97 == 5, "PDF").alias("document_type"))
    return pipeline.batch_types(docs)


@query()
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, normalise and embed all documents: what a vector table holds."""
    rows = pipeline.ingested(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("chunk_id", "doc_id", "place", "text", "embedding")


@query(f"""WITH {chunks_sql("documents")}
    SELECT count(*) AS total, count(*) FILTER (WHERE len(chunks) > 0) AS succeeded, count(*) FILTER (WHERE len(chunks) = 0) AS failed, sum(len(chunks))::BIGINT AS chunks, sum(length(text))::BIGINT AS chars FROM cut""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.size(chunk.sentence_chunks("text")).alias("chunks"), F.length("text").alias("chars"))
    return evaluate.ingest_summary(rows.withColumn("status", F.when(F.col("chunks") > 0, "STORED").otherwise("FAILED")))
