"""End to end: ingestion of documents into chunks with vectors, and answers to a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.normalize import normalized
from corpusflow.functions.route import route
from corpusflow.functions.structure import is_pdf
from corpusflow.functions.text import excerpt
from corpusflow.operators import chunking, memory, prompts, rerank, retrieval
from corpusflow.operators.providers import chunker, embedded, generator
from corpusflow.settings import DEFAULTS


def batch_types(docs: DataFrame, batch: str = "batch_id", place: str = "place", source: str = "source", kind: str = "document_type") -> DataFrame:
    """(batch, document_type): pdf if any document is declared so, or if the first one's text looks so; else text."""
    declared = F.lower(F.coalesce(F.col(source), F.lit(""))).endswith(".pdf") | (F.lower(F.coalesce(F.col(kind), F.lit(""))) == "pdf")
    looks = is_pdf("text")
    found = docs.select(batch, place, declared.alias("_d"), looks.alias("_l")).groupBy(batch).agg(F.bool_or("_d").alias("_d"), F.min_by("_l", place).alias("_l"))
    return found.select(batch, F.when(F.col("_d") | F.col("_l"), "pdf").otherwise("text").alias("document_type"))


def ingested(docs: DataFrame, provider: str = "hash", batch_is_pdf: Column | None = None, source: str | None = None, kind: str | None = None, cut: str | None = None) -> DataFrame:
    """Chunk, normalise after chunking, embed: a single narrow stage. The key of a chunk is stable.

    ``cut`` names a registered chunker that takes the place of the page-aware one.
    """
    if cut is None:
        rows = chunking.page_documents(docs, source, kind, batch_is_pdf=batch_is_pdf)
    else:
        rows = chunking.exploded(docs, F.transform(chunker(cut)(F.col("text")), lambda x, i: F.struct(x.alias("text"), i.cast("int").alias("place"))))
    rows = rows.withColumn("text", normalized("text"))
    return rows.withColumn("chunk_id", F.xxhash64("doc_id", "place", "text")).withColumn("embedding", embedded(F.col("text"), provider))


def positions_joined(texts: DataFrame, metadata: DataFrame, place: str = "place") -> DataFrame:
    """Texts with the metadata at the same position; texts beyond the metadata are left out."""
    return texts.join(metadata, place)


def retrieved(queries: DataFrame, chunks: DataFrame, k: int = DEFAULTS.retrieve, provider: str = "hash") -> DataFrame:
    """(query_id, query, chunk_id, doc_id, text, score, retrieval_rank): the first, cheap step.

    ``queries`` is (query_id, query). The hits are a few rows a query and fetch their texts by key.
    """
    vectors = queries.withColumn("query_vector", embedded(F.col("query"), provider))
    hits = retrieval.search_all(chunks, vectors, k, id_col="chunk_id")
    found = chunks.select("chunk_id", "doc_id", "text").join(hits, "chunk_id").dropDuplicates(["query_id", "rank"])
    return found.join(queries, "query_id").withColumnRenamed("rank", "retrieval_rank")


def answered(
    queries: DataFrame, chunks: DataFrame, messages: DataFrame | None = None, now: Column | None = None, *, k: int = DEFAULTS.retrieve, n: int = DEFAULTS.rerank,
    use_router: bool = True, embedder: str = "hash", reranker: str = "overlap", llm: str = "extract", llm_name: str = "hosted",
) -> DataFrame:
    """(query_id, session_id, query_type, response, sources, prompt) for (query_id, session_id, query).

    Normalise, route, search, rerank, put the context together, generate. Questions that the router
    answers by itself never reach the search. Without a hit the answer is a fixed text.
    """
    asked = queries.withColumn("original", F.col("query")).withColumn("query", normalized("query"))
    asked = asked.withColumn("query_type", route("query") if use_router else F.lit("rag"))
    hits = retrieved(asked.where("query_type = 'rag'").select("query_id", "query"), chunks, k, embedder)
    best = rerank.rerank(hits, n, reranker)
    source = F.struct(F.col("rerank_rank").alias("rank"), "doc_id", excerpt("text").alias("content"), "score")
    packed = best.groupBy("query_id").agg(rerank.joined_texts("rerank_rank").alias("context"), F.sort_array(F.collect_list(source)).alias("sources"))
    rows = asked.join(packed, "query_id", "left")
    past = None
    if messages is not None and now is not None:
        turn = F.struct("place", F.col("role"), F.col("content"))
        old = memory.history(messages, now).groupBy("session_id").agg(F.sort_array(F.collect_list(turn)).alias("_h"))
        old = old.select("session_id", F.transform("_h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("_past"))
        rows, past = rows.join(old, "session_id", "left"), F.col("_past")
    query, ctx = F.col("query"), F.col("context")
    rag = prompts.answer_prompt(ctx, query, past)
    prompt = F.when(F.col("query_type") == "rag", rag).otherwise(prompts.route_prompt(F.col("query_type"), query, ctx))
    rows = rows.withColumn("prompt", prompt)
    response = F.when((F.col("query_type") == "rag") & ctx.isNull(), prompts.no_answer(F.lit(llm_name))).otherwise(generator(llm)(query, F.coalesce(ctx, query)))
    return rows.withColumn("response", response).select("query_id", "session_id", F.col("original").alias("query"), "query_type", "response", "sources", "prompt")


def saved_exchange(answers: DataFrame, ts: Column) -> DataFrame:
    """The messages to append after answering: the question as it was asked, and the answer."""
    turns = answers.select("session_id", F.col("query").alias("user_message"), F.col("response").alias("ai_message"), ts.alias("ts"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return memory.exchange(turns)
