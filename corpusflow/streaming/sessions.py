"""Streams: session memory as keyed state that expires, expiry by watermark, and ingestion of arriving files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.functions.normalize import normalized
from corpusflow.operators import chunking
from corpusflow.settings import DEFAULTS


def recent_history(messages: DataFrame, limit: int = DEFAULTS.history, ttl_hours: int = DEFAULTS.ttl_hours, late: str = "10 minutes") -> DataFrame:
    """(session_id, messages, last) after each batch: how many of the last ``limit`` messages are alive.

    ``messages`` is a stream of (session_id, ts, content). The state of a session is its last messages;
    it goes when the watermark, which lags by ``late``, is ``ttl_hours`` past the last one.
    """
    import pandas as pd

    ttl = ttl_hours * 3600

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "messages": [0], "last": [None]})
            return
        own = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            own += [(t.timestamp(), c) for t, c in zip(frame["ts"], frame["content"], strict=True)]
        own.sort()
        own = [x for x in own if x[0] >= own[-1][0] - ttl][-limit:]
        state.update(([t for t, _ in own], [c for _, c in own]))
        state.setTimeoutTimestamp(max(int((own[-1][0] + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "messages": [len(own)], "last": [own[-1][1]]})

    rows = messages.withWatermark("ts", late).select("session_id", "ts", "content")
    kind = messages.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").applyInPandasWithState(
        update, f"session_id {kind}, messages long, last string", "times array<double>, contents array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Messages of each session and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "session_id").agg(F.count("*").alias("messages")).select(F.col("w.start").alias("start"), "session_id", "messages")


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string", files: int = 10) -> StreamingQuery:
    """Chunk and normalise documents as their files arrive, ``files`` at a time, and append the chunks."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    chunks = chunking.sentence_documents(docs.select("doc_id", "text")).withColumn("text", normalized("text"))
    return chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
