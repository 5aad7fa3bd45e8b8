"""Search, reranking, memory, answers, evaluation and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import chunking, evaluate, memory, pipeline, prompts, providers, rerank, retrieval
from corpusflow.plans import retrieval_queries
from corpusflow.plans.common import ORACLES
from corpusflow.streaming import sessions


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(200)] + [(500, [1.0] * 8), (501, [1.0] * 8), (502, None), (503, [0.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).cache()


def test_search_against_brute_force(spark, vectors):
    queries = vectors.where("vec_id in (3, 500, 503)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = {}
    for r in retrieval.search_all(vectors, queries, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    data = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if r.embedding}
    for q in (3, 500):
        score = {i: float(v @ data[q] / (np.linalg.norm(v) * np.linalg.norm(data[q]) or 1)) for i, v in data.items()}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert [i for _, i, _ in sorted(got[q])] == want
    one = [r.vec_id for r in retrieval.search(vectors, [1.0] * 8, 2).collect()]
    assert one == [500, 501]
    assert retrieval.search_all(vectors, queries.limit(0), 5).count() == 0


def test_search_in_blocks(vectors, monkeypatch):
    queries = vectors.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.search_all(vectors, queries, 3).collect())
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 300)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.search_all(vectors, queries, 3).collect()) == whole


def test_search_grid(spark, vectors, monkeypatch):
    """In one cell and in many, with ties, a zero vector and ids that are missing on either side: what search_all finds."""
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")).unionByName(spark.createDataFrame([(None, [1.0] * 8)], "query_id long, query_vector array<float>"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    want = rows(retrieval.search_all(vectors, queries.where("query_id is not null"), 5))
    assert len(want) == 203 * 5 and rows(retrieval.search_grid(vectors, queries, 5)) == want
    assert rows(retrieval.search_grid(vectors, queries.where("query_id > 500"), 300))[:1] and retrieval.search_grid(vectors, queries.limit(0), 5).count() == 0 == retrieval.search_grid(vectors.limit(0), queries, 5).count()
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 8 * 50)
    assert rows(retrieval.search_grid(vectors, queries, 5)) == want


def test_mrr_asks_every_vector(spark, tmp_path):
    """Against a plain count over all rows, and the SQL; ids that no hundred divides count as well."""
    r = np.random.default_rng(1)
    v, label = r.normal(size=(150, 6)).astype(np.float32).astype(float), r.integers(0, 4, 150)
    rows = [(i + 1, [float(x) for x in v[i]], int(label[i])) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    score = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    ranks = [[n for n, j in enumerate([j for j in np.argsort(-score[i], kind="stable") if j != i][:10], 1) if label[j] == label[i]] for i in range(150)]
    got = [tuple(x) for x in retrieval_queries.mrr_at_k(spark, str(tmp_path)).collect()]
    assert got == [(round(sum(1 / x[0] for x in ranks if x) / 150, 6), 150)]
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert db.execute(ORACLES["mrr_at_k"]).fetchall() == got


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(1, "red green blue", 1, "nothing"), (1, "red green blue", 2, "red green"), (1, "red green blue", 3, "green red"), (1, "red green blue", 4, "blue red green"), (2, "x", 1, "y")]
    return spark.createDataFrame(rows, "query_id long, query string, retrieval_rank int, text string")


def test_rerank(candidates):
    got = sorted((r.query_id, r.rerank_rank, r.retrieval_rank) for r in rerank.rerank(candidates, 3).collect())
    assert got == [(1, 1, 4), (1, 2, 2), (1, 3, 3), (2, 1, 1)]
    assert rerank.rerank(candidates, 0, default=1).count() == 2 and rerank.rerank(candidates.limit(0)).count() == 0
    rel = {(r.query_id, r.retrieval_rank): r.relevance for r in rerank.min_max(rerank.scored(candidates)).collect()}
    assert rel[1, 4] == 1 and rel[1, 1] == 0 and rel[2, 1] == 1


def test_diverse_selection(candidates):
    m = np.array([[1, 0.95, 0.1, 0.2], [0.95, 1, 0.1, 0.2], [0.1, 0.1, 1, 0.3], [0.2, 0.2, 0.3, 1]])
    relevance = [(x - 0.2) / 0.7 for x in (0.9, 0.88, 0.6, 0.2)]
    assert rerank.select_diverse(relevance, m, 3, 0.7) == [0, 1, 2]
    assert rerank.select_diverse(relevance, m, 3, 0.3) == [0, 2, 3]
    got = sorted((r.query_id, r.mmr_rank, r.retrieval_rank) for r in rerank.rerank_diverse(candidates, 2).collect())
    assert got[0] == (1, 1, 4) and len(got) == 3


def messages(spark, n=15, session="a"):
    base = dt.datetime(2024, 1, 1, 12)
    return spark.createDataFrame([(session, i, "human" if i % 2 == 0 else "ai", f"m{i}", base + dt.timedelta(minutes=i)) for i in range(n)], "session_id string, seq int, role string, content string, ts timestamp")


def test_memory(spark):
    now = F.lit(dt.datetime(2024, 1, 2, 12, 5))
    rows = messages(spark).unionByName(messages(spark, 4, "b"))
    last = memory.history(rows, now).where("session_id = 'a'").orderBy("place").collect()
    assert [r.content for r in last] == [f"m{i}" for i in range(5, 15)]
    assert memory.history(rows, now, 5).where("session_id = 'a'").count() == 5
    assert memory.expired(rows, now).count() == 5 + 4
    left, gone = memory.cleanup(rows, now)
    assert left.count() == 10 and gone.first().deleted == 9
    once = memory.clear_session(rows, "a")
    assert once.count() == 4 and memory.clear_session(once, "a").count() == 4
    assert {r.session_id: r.messages for r in memory.session_counts(rows).collect()} == {"a": 15, "b": 4}
    assert memory.turns(rows).count() == 7 + 2


def test_exchange(spark):
    turn = spark.createDataFrame([("s", "q", "a", dt.datetime(2024, 1, 1), {"k": "v"})], "session_id string, user_message string, ai_message string, ts timestamp, metadata map<string,string>")
    got = memory.exchange(turn).orderBy("seq").collect()
    assert [(r.role, r.content, r.metadata) for r in got] == [("human", "q", {"k": "v"}), ("ai", "a", {"k": "v"})]
    assert len({r.id for r in got}) == 2 and got == memory.exchange(turn).orderBy("seq").collect()


def test_prompts(spark):
    row = spark.createDataFrame([("what {context}?", "ctx {query}")], "q string, c string").select(prompts.answer_prompt(F.col("c"), F.col("q")).alias("p")).first()
    assert row.p[-1].content == "Passages:\nctx {query}\n\nQuestion: what {context}?" and [m.role for m in row.p] == ["system", "human"]


def test_answers_end_to_end(spark):
    docs = spark.createDataFrame([(1, "The river Nile flows through Egypt, and its source was long unknown to the world."), (2, "A cat sleeps on the warm roof of the old house near the market every day.")], "doc_id long, text string")
    chunks = pipeline.ingested(docs)
    asked = spark.createDataFrame([(1, "a", "where does the river Nile flow"), (2, "b", "hello"), (3, "a", "5 + 3")], "query_id long, session_id string, query string")
    past = messages(spark, 3)
    now = F.lit(dt.datetime(2024, 1, 1, 13))
    got = {r.query_id: r for r in pipeline.answered(asked, chunks, past, now).collect()}
    assert [got[i].query_type for i in (1, 2, 3)] == ["rag", "greeting", "calculator"]
    assert got[1].response.startswith("The river Nile") and got[1].sources[0].doc_id == 1 and len(got[1].prompt) == 2 + 3
    assert got[2].sources is None and len(got[2].prompt) == 1
    empty = pipeline.answered(asked.where("query_id = 1"), chunks.limit(0), use_router=False).first()
    assert empty.response == prompts.NO_ANSWER["long"]
    saved = pipeline.saved_exchange(pipeline.answered(asked.where("query_id = 2"), chunks), now).orderBy("seq").collect()
    assert [r.role for r in saved] == ["human", "ai"] and saved[0].content == "hello"


def test_batch_types(spark):
    rows = [(1, 0, "x", "a.txt", None), (1, 1, "x", "b.PDF", None), (2, 0, "Page 1 | a | b |", "a.txt", None), (3, 0, "x", "a.txt", None), (3, 1, "Page 1 | a | b |", "a.txt", None)]
    docs = spark.createDataFrame(rows, "batch_id int, place int, text string, source string, document_type string")
    assert {r.batch_id: r.document_type for r in pipeline.batch_types(docs).collect()} == {1: "pdf", 2: "pdf", 3: "text"}


def test_page_documents(spark):
    body = "17\nThe title of a part\nwords of the first part. more of it here\n12\n| cell a | cell b |\n| cell c | cell d |\nwords that come after the table are here"
    docs = spark.createDataFrame([(1, body, "a.pdf"), (2, body, "a.txt")], "doc_id long, text string, source string")
    rows = chunking.page_documents(docs, "source", least=1).collect()
    assert {r.doc_id: r.is_pdf for r in rows} == {1: True, 2: False}
    assert all("17" not in r.text for r in rows if r.doc_id == 1) and any("17" in r.text for r in rows if r.doc_id == 2)
    assert {r.content_type for r in rows if r.doc_id == 1} == {"text", "table"}


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "Some Text about prices", 0.9), (1, "other", 0.5), (2, "none", 0.1)], "query_id long, text string, score double")
    topics = spark.createDataFrame([(1, ["text", "PRICES", "missing"]), (2, ["x"]), (3, ["y", "z"])], "query_id long, topics array<string>")
    got = {r.query_id: r for r in evaluate.topic_coverage(hits, topics).collect()}
    assert (got[1].topics_found, got[1].total_topics, got[1].topic_coverage, got[1].top_score, got[1].docs_retrieved) == (2, 3, 0.67, 0.9, 2)
    assert got[3].topic_coverage == 0 and got[3].docs_retrieved == 0
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id long, rank int, relevant boolean")
    assert evaluate.mean_reciprocal_rank(ranked).first().mrr == 0.25


def test_providers(spark):
    with pytest.raises(ValueError, match="unknown"):
        providers.embedding("absent")
    providers.register("reranker", "length", lambda q, t: F.length(t).cast("double"))
    row = spark.createDataFrame([(1, "q", 1, "aa"), (1, "q", 2, "aaa")], "query_id long, query string, retrieval_rank int, text string")
    assert rerank.rerank(row, 1, "length").first().retrieval_rank == 2


def test_registered_chunker(spark):
    providers.register("chunker", "halves", lambda t: F.array(F.substring(t, 1, 3), F.substring(t, 4, 100)))
    try:
        got = pipeline.ingested(spark.createDataFrame([(1, "abcdef"), (2, None)], "doc_id long, text string"), cut="halves")
        assert [(r.doc_id, r.place, r.text) for r in got.where("doc_id = 1").orderBy("place").collect()] == [(1, 0, "abc"), (1, 1, "def")]
        with pytest.raises(ValueError, match="unknown"):
            pipeline.ingested(got, cut="absent")
    finally:
        del providers.CHUNKERS["halves"]


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, "One sentence is here. " * 30) for i in range(4)], "doc_id long, text string").repartition(2).write.parquet(source)
    sessions.ingest_stream(spark, source, target, str(tmp_path / "check"), files=1).awaitTermination(60)
    want = chunking.sentence_documents(spark.read.parquet(source)).count()
    assert spark.read.parquet(target).count() == want > 4


def test_session_stream(spark, tmp_path):
    source = str(tmp_path / "messages")
    rows = messages(spark, 12).unionByName(messages(spark, 3, "b")).withColumn("ts", F.col("ts"))
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    q = sessions.recent_history(stream).writeStream.format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.session_id: (r.messages, r["last"]) for r in spark.table("recent").collect() if r.messages}
    assert got == {"a": (10, "m11"), "b": (3, "m2")}
    w = sessions.windowed_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "w")).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert w.exception() is None
    whole = {(r.start, r.session_id): r.messages for r in sessions.windowed_counts(spark.read.schema(rows.schema).parquet(source)).collect()}
    closed = {(r.start, r.session_id): r.messages for r in spark.table("counts").collect()}
    assert sum(whole.values()) == 15 and closed.items() <= whole.items()


def test_word_search_is_exact_whatever_the_tasks(spark):
    """All documents against all questions by plain sets; ties, empty ones, repeated rows, several blocks of questions."""
    import random
    import re

    from corpusflow.operators import retrieval

    r = random.Random(3)
    some = ["the", "The", "river", "stone", "größe", "مرحبا", "x1", *(f"w{k}" for k in range(60))]
    text = lambda n: "".join(r.choice(some) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 5, 40, 300]))) for i in range(1500)] + [(5000, None), (None, text(20)), (1, text(30))]
    asked = [(q, text(r.choice([1, 3, 12]))) for q in range(40)] + [(90, ""), (91, None), (92, "unheard of")]
    own = lambda t: {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    want = set()
    for q, t in asked:
        scored = sorted((-len(own(t) & own(d)) / len(own(t)), i) for i, d in docs if i is not None and own(t) & own(d)) if own(t) else []
        want |= {(q, i, round(-s, 9), n) for n, (s, i) in enumerate(scored[:15], 1)}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(asked, "query_id long, query string")
    rows = lambda: {(x.query_id, x.doc_id, round(x.score, 9), x.rank) for x in retrieval.search_words(d, q).collect()}
    assert rows() == want
    block = retrieval.BLOCK_BYTES
    try:
        retrieval.BLOCK_BYTES = 2000
        assert rows() == want
    finally:
        retrieval.BLOCK_BYTES = block
    assert retrieval.search_words(d, q.where("query_id = 90")).count() == 0


def test_a_task_sends_k_rows_a_query(spark):
    """However many batches a task reads; ties go to the smaller id, in whatever batch it lies."""
    rng = np.random.default_rng(3)
    held = rng.normal(size=(700, 6)).round(2)
    rows = [(i, held[i % 700].tolist()) for i in range(2999, -1, -1)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(q, held[q].tolist()) for q in range(300)], "query_id long, query_vector array<double>")
    ids, q = next(retrieval._blocks(queries))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        assert retrieval._nearest(corpus, ids, q, 7, "vec_id", "embedding").count() == 300 * 7
        got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.search_all(corpus, queries, 7).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    for query in range(300):
        score = np.round(unit @ unit[query], 10)
        first = sorted(range(3000), key=lambda i: (-score[i % 700], i))[:7]
        assert [got[query, n] for n in range(1, 8)] == first
