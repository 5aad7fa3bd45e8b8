"""Session memory as a stream: order, limit, expiry, late rows, restarts and repeated batches."""

import time
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusflow.streaming import memory

START = datetime(2024, 1, 1)
SCHEMA = "session_id string, ts timestamp, seq int, role string, content string"


def step(spark, tmp_path, rows, **options):
    """The messages arrive, the stream starts (again), takes them in and stops."""
    data = [(s, START + timedelta(hours=h), q, "human", f"{s}{h}") for s, h, q in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = memory.state_session(spark)
    changed = memory.histories(own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), **options)
    memory.remember(changed, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return memory.recalled(spark, str(tmp_path / "out"))


def held(recall):
    out = {}
    for r in recall.orderBy("session_id", "place").collect():
        out.setdefault(r.session_id, []).append(r.content)
    return out


def test_histories_expire_and_late_rows_are_left_out(spark, tmp_path):
    rows = [("a", 1, 0), ("a", 0, 0), ("b", 0, 0), ("b", 2, 1), ("b", 2, 0)]
    assert held(step(spark, tmp_path, rows, limit=3, late="1 hour")) == {"a": ["a0", "a1"], "b": ["b0", "b2", "b2"]}
    # out of order but not late: the limit drops the oldest; the restarted stream goes on from its state
    recall = step(spark, tmp_path, [("b", 3, 0), ("a", 1.5, 0), ("c", 20, 0)], limit=3, late="1 hour")
    assert held(recall) == {"a": ["a0", "a1", "a1.5"], "b": ["b2", "b2", "b3"], "c": ["c20"]}
    assert [r.seq for r in recall.where("session_id = 'b'").orderBy("place").collect()] == [0, 1, 0]
    # 28 h: the watermark passes 27 h, so what is from before 3 h expires without any new message of its session
    recall = step(spark, tmp_path, [("c", 28, 0)], limit=3, late="1 hour")
    assert held(recall) == {"b": ["b3"], "c": ["c20", "c28"]}
    # a message from 2 h is behind the watermark now
    recall = step(spark, tmp_path, [("a", 2, 0), ("d", 28, 0)], limit=3, late="1 hour")
    assert held(recall) == {"b": ["b3"], "c": ["c20", "c28"], "d": ["d28"]}
    now = F.lit(START + timedelta(hours=44, minutes=30))
    assert held(memory.alive_at(recall, now)) == {"c": ["c28"], "d": ["d28"]}
    assert {r.place for r in memory.alive_at(recall, now).collect()} == {1}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    first = held(step(spark, tmp_path, [("a", 0, 0), ("a", 1, 0)], late="1 hour"))
    (tmp_path / "checkpoint" / "commits" / "0").unlink()  # as if the stream had died after it wrote the batch
    crc = tmp_path / "checkpoint" / "commits" / ".0.crc"
    if crc.exists():
        crc.unlink()
    again = step(spark, tmp_path, [("b", 1, 0)], late="1 hour")
    assert first == {"a": ["a0", "a1"]} and held(again) == {"a": ["a0", "a1"], "b": ["b1"]}


def test_time_to_live_of_the_store(spark, tmp_path):
    put = lambda *rows: spark.createDataFrame([(s, START, q, "human", f"{s}{q}") for s, q in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 0))
    changed = memory.histories(memory.state_session(spark).readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), clock="processing", ttl_hours=4 / 3600)
    query = memory.remember(changed, str(tmp_path / "out"), str(tmp_path / "checkpoint"), every="1 second")

    def seen(want):
        for _ in range(60):
            time.sleep(0.5)
            if (tmp_path / "out").exists() and [*(tmp_path / "out").glob("*/_SUCCESS")] and held(memory.recalled(spark, str(tmp_path / "out"))) == want:
                return True
        return False

    try:
        assert seen({"a": ["a0"]})
        time.sleep(5)
        put(("a", 5), ("b", 0))
        assert seen({"a": ["a5"], "b": ["b0"]})
    finally:
        query.stop()


def test_a_session_asks_the_store_only_for_what_changes():
    """rows, not frames, and a timer is only moved when the oldest message is another; timers were listed and set anew for each session that got a message."""
    calls, held = [], []

    class List:
        def get(self):
            return iter(held)

        def appendList(self, new):  # noqa: N802
            held.extend(new)

        def put(self, own):
            held[:] = own

        def clear(self):
            held.clear()

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return List()

        def registerTimer(self, at):  # noqa: N802
            calls.append(("set", at))

        def deleteTimer(self, at):  # noqa: N802
            calls.append(("gone", at))

    class Clock:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    session = memory.SessionMemory(3, 1, "event")
    session.init(Handle())
    hour, given = 3_600_000, []
    for seq in range(5):
        given = [*session.handleInputRows(("s",), iter([Row(micros=seq * 1000, seq=seq, role="human", content=str(seq))]), Clock())]
    assert [(r.session_id, r.seq, r.place) for r in given] == [("s", 2, 1), ("s", 3, 2), ("s", 4, 3)]
    assert calls == [("set", hour + 1), ("gone", hour + 1), ("set", hour + 2), ("gone", hour + 2), ("set", hour + 3)]
