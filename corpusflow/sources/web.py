"""Crawled pages to documents: title, main content, category, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import col, replace, strip

#: What a path contains and the category that it tells, in this order.
CATEGORIES = [
    (["internet"], "internet"), (["mobile"], "mobile"), (["landline"], "landline"), (["entertainment", "tv"], "entertainment"),
    (["support", "faq"], "support"), (["business"], "business"), (["about"], "about"),
]
#: Boilerplate, taken out up to the end of its line.
NOISE = [r"جميع الحقوق محفوظة.*", r"All rights reserved.*", r"تابعنا على.*", r"Follow us.*", r"اتصل بنا.*", r"Contact us.*"]


def category(url: str | Column) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")))
    out = F.lit("general")
    for signs, name in reversed(CATEGORIES):
        out = F.when(path.rlike("|".join(signs)), name).otherwise(out)
    return out


def language(url: str | Column) -> Column:
    return F.when(F.contains(col(url), F.lit("/ar/")), "ar").otherwise("en")


def without_noise(c: str | Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(col(c), r"\n{3,}", "\n\n"), " {2,}", " ")
    for pattern in NOISE:
        out = replace(out, pattern, "", "iu")
    return strip(out)


def documents(pages: DataFrame) -> DataFrame:
    """(page_id, text, metadata) of pages with (page_id, url, title, content): title, blank line, content."""
    rows = pages.withColumn("content", without_noise("content")).where(F.length("content") > 0)
    meta = F.create_map(
        F.lit("source"), F.col("url"), F.lit("title"), F.col("title"), F.lit("category"), category("url"), F.lit("language"), language("url"),
    )
    return rows.select("page_id", F.concat("title", F.lit("\n\n"), "content").alias("text"), meta.alias("metadata"))
