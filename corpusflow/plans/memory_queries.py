"""Queries over routing and session memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.route import route
from corpusflow.operators import evaluate, memory
from corpusflow.plans.common import query, table

_NOW = "TIMESTAMP '2024-01-02 12:00:00'"
_BASE = "TIMESTAMP '2024-01-01 00:00:00'"
_MESSAGES = f"m AS (SELECT conv_id AS session_id, turn AS seq, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS role, text AS content, {_BASE} + to_minutes(conv_id * 37 % 2880 + turn) AS ts FROM conversations)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; the times derive from the ids."""
    minutes = F.make_dt_interval(mins=(F.col("conv_id") * 37 % 2880 + F.col("turn")).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "human").otherwise("ai").alias("role"), F.col("text").alias("content"), (F.expr(_BASE) + minutes).alias("ts"),
    )


_ROUTE = r"""CASE WHEN regexp_matches(q, '^hello\s*$|^hi\s*$|^hey\s*$|^good\s+morning|^good\s+evening') THEN 'greeting'
    WHEN regexp_matches(q, '\d+\s*[-+*/×÷]\s*\d+|calculate') THEN 'calculator'
    WHEN regexp_matches(q, '^what.{0,5}your\s+name|^who\s+are\s+you|^how\s+are\s+you|^thank') THEN 'simple' ELSE 'rag' END"""
_ASKED = "CASE conv_id % 6 WHEN 0 THEN 'Hello ' WHEN 1 THEN 'Thank you: ' || text WHEN 2 THEN '12 x 3, ' || text || ' 4 * 5' WHEN 3 THEN 'Who are  you' ELSE text END"


@query(rf"""SELECT conv_id, turn, {_ROUTE} AS route FROM (SELECT conv_id, turn, trim(lower({_ASKED})) AS q FROM conversations WHERE role = 'user')""")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(_ASKED).alias("q"))
    return rows.select("conv_id", "turn", route("q").alias("route"))


@query(rf"""SELECT {_ROUTE} AS route, count(*) AS n FROM (SELECT trim(lower({_ASKED})) AS q FROM conversations WHERE role = 'user') GROUP BY 1""")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_queries(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


@query(f"""WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS rn FROM m WHERE ts >= {_NOW} - INTERVAL 24 HOUR)
    SELECT session_id, seq, role, content, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS place FROM r WHERE rn <= 10""")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.history(_messages(spark, sf_dir), F.expr(_NOW))
    return rows.select("session_id", "seq", "role", "content", F.col("place").cast("long").alias("place"))


@query("SELECT conv_id AS session_id, count(*) AS messages FROM conversations GROUP BY conv_id")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.session_counts(_messages(spark, sf_dir))


@query(f"WITH {_MESSAGES} SELECT session_id, seq FROM m WHERE ts < {_NOW} - INTERVAL 24 HOUR")
def expired_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.expired(_messages(spark, sf_dir), F.expr(_NOW)).select("session_id", "seq")


@query(f"WITH {_MESSAGES} SELECT (SELECT count(*) FROM m WHERE ts < {_NOW} - INTERVAL 24 HOUR) AS deleted")
def cleanup_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.cleanup(_messages(spark, sf_dir), F.expr(_NOW))[1]


@query("SELECT conv_id AS session_id, turn AS seq FROM conversations WHERE conv_id <> 3")
def clear_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.clear_session(_messages(spark, sf_dir), 3).select("session_id", "seq")


@query(f"""WITH {_MESSAGES}, n AS (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS ai_message FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq))
    SELECT session_id, seq, content AS user_message, ai_message FROM n WHERE role = 'human' AND next_role = 'ai'""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.turns(_messages(spark, sf_dir)).select("session_id", "seq", "user_message", "ai_message")


@query(f"""WITH {_MESSAGES}, t AS (SELECT session_id, max(ts) AS ts, 'q' || count(*) AS q, 'a' || count(*) AS a FROM m GROUP BY session_id)
    SELECT session_id, 0::BIGINT AS seq, 'human' AS role, q AS content FROM t UNION ALL SELECT session_id, 1, 'ai', a FROM t""")
def add_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange for each session, as two messages."""
    n = F.count("*").cast("string")
    turns = _messages(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("ts"), F.concat(F.lit("q"), n).alias("user_message"), F.concat(F.lit("a"), n).alias("ai_message"))
    rows = memory.exchange(turns.withColumn("metadata", F.lit(None).cast("map<string,string>")))
    return rows.select("session_id", F.col("seq").cast("long").alias("seq"), "role", "content")


@query("""SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the ')""")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that contain a string, whatever its case; the whole table is searched."""
    return table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("the "))).select("conv_id", "turn")


@query(r"SELECT event_id, try_cast(props AS JSON) IS NOT NULL AS valid FROM events")
def metadata_is_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"))


@query("""SELECT CASE WHEN bool_and(n > 0) THEN 'healthy' ELSE 'degraded' END AS status, count(*) AS components
    FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM embeddings UNION ALL SELECT count(*) FROM conversations)""")
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healthy when all tables have rows."""
    parts = [table(spark, sf_dir, n).agg((F.count("*") > 0).alias("ok")) for n in ("documents", "embeddings", "conversations")]
    return evaluate.health(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("SELECT date_trunc('hour', ts) AS start, user_id AS session_id, count(*) AS messages FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed stream."""
    from corpusflow.streaming.sessions import windowed_counts as counts

    return counts(table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id"))


@query(f"""WITH {_MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS rn FROM m WHERE ts >= (SELECT max(ts) FROM m) - INTERVAL 24 HOUR)
    SELECT session_id, seq, role, content, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS place FROM r WHERE rn <= 10""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as a stream of files that arrive in four steps, the stream restarted from its checkpoint for each: every session's memory at the last message's time."""
    from corpusflow.shared import shared_path
    from corpusflow.streaming import memory as stream

    arriving, target, checkpoint = (shared_path(spark, f"session-{name}") for name in ("arriving", "histories", "checkpoint"))
    messages = _messages(spark, sf_dir)
    first, last = messages.agg(F.min("ts"), F.max("ts")).first()
    own = stream.state_session(spark, min(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for step in range(4):
        low, high = (first + (last - first) * k / 4 for k in (step, step + 1))
        part = messages.where((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(step == 3)))
        part.write.mode("append").parquet(arriving)
        changed = stream.histories(own.readStream.schema(messages.schema).parquet(arriving), late="1 hour")
        stream.remember(changed, target, checkpoint).awaitTermination()
    rows = stream.alive_at(stream.recalled(spark, target), F.lit(last))
    return rows.select("session_id", "seq", "role", "content", "place")
