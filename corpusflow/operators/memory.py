"""Session memory as a table of messages: (id, session_id, role, content, ts, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.settings import DEFAULTS

HUMAN, AI = "human", "ai"


def exchange(turns: DataFrame) -> DataFrame:
    """Two messages for each (session_id, user_message, ai_message, ts, metadata): the human's, then the answer.

    Ids derive from the content, so a repeated task writes the same rows.
    """
    both = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit(HUMAN).alias("role"), F.col("user_message").alias("content")),
        F.struct(F.lit(1).alias("seq"), F.lit(AI).alias("role"), F.col("ai_message").alias("content")),
    )
    rows = turns.select("session_id", "ts", "metadata", F.explode(both).alias("m")).select("session_id", "ts", "metadata", "m.*")
    return rows.withColumn("id", F.sha2(F.concat_ws("|", "session_id", F.col("ts").cast("string"), "seq", "content"), 256))


def alive(messages: DataFrame, now: Column, ttl_hours: int = DEFAULTS.ttl_hours) -> DataFrame:
    """Messages that haven't expired; the bound is a literal, so it is pushed into the scan."""
    return messages.where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(ttl_hours)))


def expired(messages: DataFrame, now: Column, ttl_hours: int = DEFAULTS.ttl_hours) -> DataFrame:
    return messages.where(F.col("ts") < now - F.make_dt_interval(hours=F.lit(ttl_hours)))


def history(messages: DataFrame, now: Column, limit: int | None = None, ttl_hours: int = DEFAULTS.ttl_hours, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The latest messages of each session, with ``place`` from 1 in ascending order. 0 or None is the default limit."""
    n = limit or DEFAULTS.history
    latest = Window.partitionBy("session_id").orderBy(*(F.desc(c) for c in order))
    upward = Window.partitionBy("session_id").orderBy(*order)
    rows = alive(messages, now, ttl_hours).withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n)
    return rows.withColumn("place", F.row_number().over(upward)).drop("_r")


def clear_session(messages: DataFrame, session_id) -> DataFrame:
    """All messages but the session's; doing it again changes nothing."""
    return messages.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))


def cleanup(messages: DataFrame, now: Column, ttl_hours: int = DEFAULTS.ttl_hours) -> tuple[DataFrame, DataFrame]:
    """What stays, and a row with the number of messages that go (not capped)."""
    return alive(messages, now, ttl_hours), expired(messages, now, ttl_hours).agg(F.count("*").alias("deleted"))


def session_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"))


def turns(messages: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(session_id, user_message, ai_message): each human message that an answer follows."""
    w = Window.partitionBy("session_id").orderBy(*order)
    rows = messages.withColumn("_role", F.lead("role").over(w)).withColumn("ai_message", F.lead("content").over(w))
    return rows.where((F.col("role") == HUMAN) & (F.col("_role") == AI)).select("session_id", F.col("content").alias("user_message"), "ai_message", *order)
