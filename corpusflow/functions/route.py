"""Routing of user queries by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import col, search, strip

#: Patterns of greetings, of simple questions and of sums.
GREETINGS = [
    r"^مرحب[اً]?[ا]?\s*$", r"^أهلا[ً]?\s*$", r"^اهلا[ً]?\s*$", r"^سلام\s*$", r"^صباح\s+الخير", r"^مساء\s+الخير", r"^كيف\s+حالك", r"^السلام\s+عليكم",
    r"^ازيك", r"^إزيك", r"^hello\s*$", r"^hi\s*$", r"^hey\s*$", r"^good\s+morning", r"^good\s+evening",
]
SIMPLE = [r"^ما\s+اسمك", r"^من\s+أنت", r"^كيف\s+حالك", r"^شكر[اً]?", r"^what.{0,5}your\s+name", r"^who\s+are\s+you", r"^how\s+are\s+you", r"^thank"]
SUMS = [r"\d+\s*[\+\-\*\/×÷]\s*\d+", "احسب", "calculate", r"ما\s+(?:هو\s+)?(?:ناتج|حاصل)"]


def _matches(c: Column, patterns: list[str]) -> Column:
    return search(c, "(?:" + "|".join(patterns) + ")", "iu")


def route(c: str | Column) -> Column:
    """greeting, calculator, simple or rag: the first that fits, in this order."""
    q = strip(F.lower(col(c)))
    return F.when(_matches(q, GREETINGS), "greeting").when(_matches(q, SUMS), "calculator").when(_matches(q, SIMPLE), "simple").otherwise("rag")
