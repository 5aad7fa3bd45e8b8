"""Documents to chunks: a narrow step, one row in, a row for each chunk out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import chunk as C
from corpusflow.functions.clean import cleaned, cleaning_stats
from corpusflow.functions.structure import is_pdf, structure
from corpusflow.settings import DEFAULTS


def exploded(docs: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk, with the document's other columns.

    ``inline`` makes the fields columns at once; reading them off an exploded struct would let the
    optimizer compute the chunks anew for each field.
    """
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.inline(chunks))


def sentence_documents(docs: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk) -> DataFrame:
    """chunk_index and total_chunks beside each chunk and what the document has."""
    return exploded(docs, C.plain_chunks("text", size, overlap, least))


def page_documents(
    docs: DataFrame, source: str | None = None, kind: str | None = None, *, overlap: int = DEFAULTS.chunk_overlap, least: int = DEFAULTS.min_chunk,
    clean: bool = True, dynamic: bool = True, batch_is_pdf: Column | None = None,
) -> DataFrame:
    """Documents from PDFs are cleaned and cut by their structure, others by sentences.

    Whether a document is from a PDF is decided row by row; ``batch_is_pdf`` can switch this off for
    whole batches. Each row takes one branch of a CASE, so the text isn't read twice.
    """
    pdf = is_pdf("text", source, kind)
    if batch_is_pdf is not None:
        pdf = pdf & batch_is_pdf
    rows = docs.withColumn("_pdf", pdf)
    rows = rows.withColumn("_text", F.when(F.col("_pdf") & F.lit(clean), cleaned("text")).otherwise(F.col("text")))
    rows = rows.withColumn("_shape", F.when(F.col("_pdf"), structure("_text")))
    # without cleaning there is no structure, so sizes alone are dynamic
    by_shape = C.structured_chunks("_text", "_shape", overlap, least, dynamic) if clean else C.dynamic_chunks("_text", overlap, least, dynamic)
    chunks = F.when(F.col("_pdf"), by_shape).otherwise(C.plain_chunks("_text", DEFAULTS.chunk_size, overlap, least))
    stats = F.when(F.col("_pdf") & F.lit(clean), cleaning_stats("text", "_text"))
    numbered = F.transform(chunks, lambda x, i: x.withField("place", i.cast("int")))
    rows = rows.withColumn("_stats", stats)
    keep = [c for c in docs.columns if c != "text"]
    return rows.select(*keep, F.col("_pdf").alias("is_pdf"), "_stats.*", F.inline(numbered))


def chunk_estimate(docs: DataFrame) -> DataFrame:
    """How many chunks the wider default cut (512, 50, 50) would give, summed over all documents."""
    return docs.select(F.size(C.sentence_chunks("text", 512, 50, 50)).cast("long").alias("n")).agg(F.sum("n").alias("chunks"))
