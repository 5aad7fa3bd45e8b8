"""Files of any supported format to documents: read, detect, extract, and keep the rejects with their reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import providers
from corpusflow.settings import DEFAULTS
from corpusflow.sources import docx, formats, html, image, markdown, pdf, plaintext

#: The extractor of each format, built-in and registered: files in, (path, text, content_type, status, warnings, …) out.
EXTRACT = providers.EXTRACTORS
for _name, _extractor in {
    "text": plaintext.extracted, "html": html.extracted, "markdown": markdown.extracted, "docx": docx.extracted, "pdf": pdf.extracted, "image": image.extracted,
}.items():
    EXTRACT.setdefault(_name, _extractor)


def register(name: str, extractor: Callable[[DataFrame], DataFrame]) -> None:
    """Add or replace the extractor of a format."""
    providers.register("extractor", name, extractor)


def read(spark: SparkSession, path: str, most: int = DEFAULTS.max_file_bytes) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): the size is tested on the listing, before any content is read.

    Spark's reader leaves files without a single byte out by itself.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    good = listed.where((F.col("length") <= most) & (F.col("length") > 0))
    bad = listed.where((F.col("length") > most) | (F.col("length") == 0)).select("path", "length", formats.size_status("length", most).alias("status"))
    return good.withColumn("format", formats.detected("content", "path")), bad


def documents(files: DataFrame) -> DataFrame:
    """(path, format, text, content_type, status, warnings) of all files; each format takes its own branch."""
    common = ["path", "text", "content_type", "status", "warnings"]
    parts = [extract(files.where(F.col("format") == name)).select(*common).withColumn("format", F.lit(name)) for name, extract in EXTRACT.items()]
    rest = files.where(~F.col("format").isin(*EXTRACT)).select(
        "path", F.lit("").alias("text"), F.lit(None).cast("string").alias("content_type"), F.lit("UNSUPPORTED").alias("status"),
        F.array(F.concat(F.lit("No extractor for the format "), "format")).alias("warnings"), "format",
    )
    out = rest
    for p in parts:
        out = out.unionByName(p)
    return out
