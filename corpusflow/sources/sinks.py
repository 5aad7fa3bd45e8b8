"""Tables of chunks and messages, and exports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.shared import saved

#: An export as a single value may have so many bytes of text; larger ones are written line by line.
MAX_ENVELOPE_BYTES = 256 << 20


def append_chunks(chunks: DataFrame, path: str, dim: int | None = None) -> None:
    """Append chunks with vectors; the key is made from content, so it never collides after deletes.

    A vector of another length than ``dim`` fails the write before anything is committed.
    """
    _checked(chunks, dim).write.mode("append").parquet(path)


def _checked(chunks: DataFrame, dim: int | None) -> DataFrame:
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a vector of another length than {dim}: "), F.size("embedding").cast("string")))
        chunks = chunks.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong))
    return chunks


def upsert_chunks(chunks: DataFrame, path: str, dim: int | None = None, key: str = "chunk_id", buckets: int = 64) -> None:
    """Put chunks into the table at ``path``, which this function alone writes; a row replaces that with the same key.

    The table is partitioned into buckets of the key, and only buckets that get rows are read and
    written. What they will hold is written to the shared folder first, so a run that fails while it
    replaces them can be repeated. Of new rows that share a key one stays. New rows and what stays of the
    old ones are dealt by bucket once each, so the last write needs no shuffle.
    """
    spark = chunks.sparkSession
    bucketed = _checked(chunks, dim).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new = saved(bucketed.repartition("bucket").dropDuplicates(["bucket", key]), "upsert-new")
    spark.createDataFrame([], new.schema).write.mode("ignore").partitionBy("bucket").parquet(path)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)).withColumn("_new", F.lit(False))
    both = old.unionByName(new.select("bucket", key, F.lit(True).alias("_new")), allowMissingColumns=True).repartition("bucket")
    replaced = F.bool_or("_new").over(Window.partitionBy("bucket", key)) & F.col(key).isNotNull()
    kept = saved(both.withColumn("_replaced", replaced).where(~F.col("_new") & ~F.col("_replaced")).select(*new.columns), "upsert-kept")
    kept.unionByName(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def ensure(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, made empty if it isn't there."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def drop(spark: SparkSession, table: str, confirm: bool = False) -> bool:
    """Drop a catalog table, only if it is confirmed."""
    if not confirm:
        return False
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return True


def listing(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """(name, rows) of the tables in the catalog, or of those whose names fit the pattern; the list is short, the counts are jobs."""
    return spark.createDataFrame([(t.name, spark.table(t.name).count()) for t in spark.catalog.listTables(pattern=pattern)], "name string, rows long")


def exportable(points: DataFrame, include_memory: bool = False, limit: int | None = None) -> DataFrame:
    """(text, metadata): rows that are no messages, unless they are wanted, and have a text.

    The vectors aren't selected, so the scan doesn't read them. The limit counts rows that are given out.
    """
    rows = points if include_memory else points.where(F.col("session_id").isNull())
    text = F.coalesce(F.nullif(F.col("page_content"), F.lit("")), F.col("text"))
    rows = rows.select(text.alias("text"), "metadata").where(F.length("text") > 0)
    return rows if limit is None else rows.limit(limit)


def generic_json(docs: DataFrame) -> Column:
    """A document as a JSON object with its text and metadata."""
    return F.to_json(F.struct("text", "metadata"))


def page_json(docs: DataFrame) -> Column:
    """A document as a page: url (its source, or nothing), title, text, then its other keys."""
    m = F.col("metadata")
    head = F.create_map(
        F.lit("url"), F.coalesce(F.nullif(m["url"], F.lit("")), m["source"], F.lit("")),
        F.lit("title"), F.coalesce(m["title"], F.lit("")), F.lit("text"), F.col("text"),
    )
    return F.to_json(F.map_concat(head, F.map_filter(m, lambda k, v: ~k.isin("url", "title", "source", "text"))))


def export_lines(docs: DataFrame, path: str, pages: bool = False) -> None:
    """One JSON object a line, written by all tasks."""
    docs.select((page_json(docs) if pages else generic_json(docs)).alias("value")).write.mode("overwrite").text(path)


def export_envelope(docs: DataFrame, timestamp: str) -> DataFrame:
    """The crawl's single JSON object {timestamp, pages_scraped, pages}. It is one value, so a collection of more than ``MAX_ENVELOPE_BYTES`` is refused."""
    size = docs.agg(F.sum(F.octet_length(page_json(docs)).cast("long"))).first()[0] or 0
    if size > MAX_ENVELOPE_BYTES:
        raise ValueError(f"{size} bytes don't fit one value of {MAX_ENVELOPE_BYTES}; use export_lines")
    one = docs.select(page_json(docs).alias("p")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p")).alias("pages"))
    head = F.format_string('{"timestamp": "%s", "pages_scraped": %d, "pages": [', F.lit(timestamp), F.col("n"))
    return one.select(F.concat(head, F.array_join("pages", ",\n"), F.lit("]}")).alias("json"))
