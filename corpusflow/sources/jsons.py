"""JSON corpora in two shapes: crawled pages under ``pages``, and plain lists of texts with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import col, preview, strip

_MAP = "map<string,string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): each file as a whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def shape(c: str | Column) -> Column:
    """firecrawl: an object with a list of pages; generic: a list whose first entry has a text; else invalid."""
    pages = F.get_json_object(col(c), "$.pages")
    first = F.get_json_object(col(c), "$[0]")
    crawled = F.ltrim(col(c)).startswith("{") & pages.startswith("[")
    plain = F.ltrim(col(c)).startswith("[") & first.startswith("{") & F.array_contains(F.json_object_keys(first), "text")
    return F.when(F.try_parse_json(col(c)).isNull(), "invalid").when(crawled, "firecrawl").when(plain, "generic").otherwise("invalid")


def crawled_pages(files: DataFrame) -> DataFrame:
    """(text, metadata) of each page with a text: url and title, the source, then all other keys, which override it."""
    pages = files.select(F.explode(F.from_json(F.get_json_object("json", "$.pages"), f"array<{_MAP}>")).alias("p"))
    base = F.create_map(F.lit("url"), F.coalesce(F.col("p")["url"], F.lit("")), F.lit("title"), F.coalesce(F.col("p")["title"], F.lit("")), F.lit("source"), F.lit("firecrawl"))
    more = F.map_filter("p", lambda k, v: ~k.isin("url", "title", "text"))
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k))
    return pages.select(strip(F.col("p")["text"]).alias("text"), F.map_concat(rest, more).alias("metadata")).where(F.length("text") > 0)


def plain_entries(files: DataFrame) -> DataFrame:
    """(text, metadata) of each entry with a text; metadata that is no object is empty; the source defaults to json."""
    entries = files.select(F.explode(F.from_json("json", "array<struct<text:string,metadata:string>>")).alias("e"))
    given = F.coalesce(F.from_json(F.col("e.metadata"), _MAP), F.from_json(F.lit("{}"), _MAP))
    meta = F.when(F.map_contains_key(given, "source"), given).otherwise(F.map_concat(given, F.create_map(F.lit("source"), F.lit("json"))))
    return entries.select(strip("e.text").alias("text"), meta.alias("metadata")).where(F.length("text") > 0)


def documents(files: DataFrame, kind: str = "auto") -> DataFrame:
    """The documents of all files, by each file's shape; a file of another shape gives none."""
    rows = files.withColumn("shape", shape("json"))
    if kind == "firecrawl":
        return crawled_pages(rows.where("shape = 'firecrawl'"))
    if kind == "generic":
        return plain_entries(rows.where("shape = 'generic'"))
    if kind != "auto":
        raise ValueError(f"unknown shape: {kind}")
    return crawled_pages(rows.where("shape = 'firecrawl'")).unionByName(plain_entries(rows.where("shape = 'generic'")))


def previews(docs: DataFrame, n: int = 5, order: str = "place") -> DataFrame:
    """The first documents: what they are called, how long they are, how they begin."""
    name = F.coalesce(F.nullif(F.col("metadata")["title"], F.lit("")), F.nullif(F.col("metadata")["source"], F.lit("")), F.concat(F.lit("Document "), F.col(order)))
    return docs.orderBy(order).limit(n).select(order, name.alias("name"), F.length("text").alias("chars"), preview("text", 100).alias("preview"))


def uploaded(name: str | Column, content: str | Column) -> Column:
    """(text, status) of an uploaded file: JSON objects compactly, lists entry by entry, other files as they are."""
    whole = col(content).cast("string")
    entries = F.from_json(whole, "array<string>")
    is_json = F.lower(col(name)).endswith(".json")
    text = F.when(is_json & F.ltrim(whole).startswith("["), F.array_join(entries, "\n")).when(is_json, F.to_json(F.parse_json(whole))).otherwise(whole)
    return F.struct(text.alias("text"), F.when(F.length(text) < 10, "File too short").otherwise("OK").alias("status"))
