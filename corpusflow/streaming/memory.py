"""Session memory as a stream: each session's latest messages are keyed state, which expires message by message.

A session's messages are a list state in RocksDB. Messages that arrive in order are appended; only those that arrive out
of order, or beyond the limit, make the list be written anew. A message expires ``ttl_hours`` after its time: by a
timer at that event time, when the watermark reaches it (``clock="event"``), or by the state store's own time to live after it
was stored (``clock="processing"``). Whenever a session changes, its whole history (``limit`` messages at most) is sent on, so that a sink only ever
replaces histories; an empty one is sent as a row without a place. Messages behind the watermark are left out.

``remember`` writes these histories through ``foreachBatch``: each batch replaces its own folder, so a batch that is repeated after
a failure changes nothing; ``recalled`` reads the latest history of every session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusflow.settings import DEFAULTS

_MESSAGE = "micros long, seq long, role string, content string"
_COLUMNS = ["micros", "seq", "role", "content"]


class SessionMemory(StatefulProcessor):
    """The latest messages of a session; see the module."""

    def __init__(self, limit: int, ttl_hours: float, clock: str):
        self.limit, self.ttl, self.clock = limit, int(ttl_hours * 3600 * 1000), clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", _MESSAGE, self.ttl if self.clock == "processing" else None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = sorted(tuple(r[c] for c in _COLUMNS) for r in rows)
        old = sorted(tuple(x) for x in self.messages.get())
        own = sorted(old + new)[-self.limit :]
        if self.clock == "event":
            bound = max(own[-1][0] // 1000, timerValues.getCurrentWatermarkInMs()) - self.ttl
            own = [x for x in own if x[0] // 1000 >= bound]
        if own[: len(old)] == old and own[len(old) :] == new:
            self.messages.appendList(new)
        else:
            self._replace(own)
        self._wake(old, own)
        yield from self._history(key, own)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        own = [x for x in sorted(tuple(x) for x in self.messages.get()) if x[0] // 1000 + self.ttl >= timerValues.getCurrentWatermarkInMs()]
        self._replace(own)
        self._wake([], own)  # the timer that has expired goes by itself
        yield from self._history(key, own)

    def _replace(self, own: list[tuple]) -> None:
        if own:
            self.messages.put(own)
        else:
            self.messages.clear()

    def _wake(self, old: list[tuple], own: list[tuple]) -> None:
        """A timer for the moment after which the oldest message has expired, and none else; the store is only asked where it changes."""
        if self.clock != "event":
            return
        was, now = (x[0][0] // 1000 + self.ttl + 1 if x else None for x in (old, own))
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def _history(self, key: Any, own: list[tuple]) -> Iterator[Row]:
        for x in [(*x, place) for place, x in enumerate(own, 1)] or [(None,) * 5]:
            yield Row("session_id", *_COLUMNS, "place")(key[0], *x)


def histories(messages: DataFrame, limit: int = DEFAULTS.history, ttl_hours: float = DEFAULTS.ttl_hours, late: str = "10 minutes", clock: str = "event") -> DataFrame:
    """(session_id, micros, seq, role, content, place) of each session that changed, from a stream of (session_id, ts, seq, role, content).

    ``micros`` is the time as a number; ``place`` counts from 1 in order and is null for a session that has become empty. The session of the
    stream needs the state store that ``state_session`` sets.
    """
    kind = messages.schema["session_id"].dataType.simpleString()
    rows = messages.select("session_id", "ts", F.unix_micros("ts").alias("micros"), F.col("seq").cast("long").alias("seq"), "role", "content")
    if clock == "event":
        rows = rows.withWatermark("ts", late)
    schema = f"session_id {kind}, {_MESSAGE}, place long"
    return rows.groupBy("session_id").transformWithState(SessionMemory(limit, ttl_hours, clock), schema, "Update", "EventTime" if clock == "event" else "ProcessingTime")


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the caller's settings stay as they are.

    State is dealt into ``partitions`` parts (by default as many as shuffles have), which a stream keeps for as long as its checkpoint lives.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def remember(changed: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Take in all that has arrived and write the changed histories to ``target``, a folder for each batch.

    With ``every`` ("1 minute") the stream goes on until it is stopped; one with ``clock="processing"`` needs that, as its state may change at any time.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def recalled(spark: SparkSession, target: str) -> DataFrame:
    """(session_id, ts, seq, role, content, place): the latest history of every session; sessions that have become empty have none."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("session_id").agg(F.max("batch").alias("batch"))
    now = rows.join(last, ["session_id", "batch"]).where("place IS NOT NULL")
    return now.select("session_id", F.timestamp_micros("micros").alias("ts"), "seq", "role", "content", "place")


def alive_at(recall: DataFrame, now: Any, ttl_hours: int = DEFAULTS.ttl_hours) -> DataFrame:
    """A recall without what has expired by ``now``, which may be later than the stream's watermark; places count anew."""
    order = Window.partitionBy("session_id").orderBy("ts", "seq")
    kept = recall.where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(ttl_hours)))
    return kept.withColumn("place", F.row_number().over(order).cast("long"))
