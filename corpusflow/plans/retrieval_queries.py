"""Queries over search, reranking, evaluation and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions.vector import overlap_score
from corpusflow.operators import ann, evaluate, lexical, pipeline, prompts, rerank, retrieval
from corpusflow.plans.common import query, table
from corpusflow.shared import saved, shared_path

_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_D = "list_transform({0}, lambda x: x::DOUBLE)"


@query(f"""
    WITH q AS (SELECT {_D.format("embedding")} AS v FROM embeddings WHERE vec_id = 7), e AS (SELECT vec_id, label, {_D.format("embedding")} AS v FROM embeddings)
    SELECT vec_id, label, round({_COS.format("e.v", "q.v")}, 6) AS score FROM e, q ORDER BY {_COS.format("e.v", "q.v")} DESC, vec_id LIMIT 15""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to one: the vector is read once and becomes a constant of the plan."""
    corpus = table(spark, sf_dir, "embeddings")
    one = corpus.where("vec_id = 7").select("embedding").first()[0]
    return retrieval.search(corpus, one).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"""
    WITH e AS (SELECT vec_id, {_D.format("embedding")} AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format("e.v", "q.v")} AS score FROM e, e q WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    QUALIFY rank <= 15""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query, against all."""
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = retrieval.search_all(corpus, queries, 15)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH e AS (SELECT vec_id, vec_id // 10 AS query_id, {_D.format("embedding")} AS v FROM embeddings),
    s AS (SELECT a.query_id, a.vec_id AS i, b.vec_id AS j, {_COS.format("a.v", "b.v")} AS s FROM e a JOIN e b ON a.query_id = b.query_id AND a.vec_id < b.vec_id)
    SELECT query_id, i, j, round(CASE WHEN s < 0 THEN (s + 1) / 2 ELSE least(s, 1) END, 6) AS similarity FROM s""")
def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities inside groups of ten candidates."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("query_id"), F.col("vec_id").alias("retrieval_rank"), "embedding")
    return retrieval.pair_similarities(rows).select("query_id", "i", "j", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over all vectors, every hundredth of them as a query: whether it finds at least 95 of 100 of the 15 nearest ones.

    These vectors hardly form clusters, so most lists must be probed for that, and codes have a byte for two components: with one
    for four, the hundred candidates miss more of the nearest ones the more vectors there are.
    """
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ann.build(corpus, shared_path(spark, "ann"), 16, parts=32)
    found = ann.search(spark, index, queries, 15, probes=14).select("query_id", F.col("id").alias("vec_id"), F.lit(1).alias("hit"))
    nearest = retrieval.search_all(corpus, queries, 15).select("query_id", "vec_id")
    both = nearest.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.95 * F.count("*")).alias("enough"))


_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
_FOUND = f"""
    qw AS (SELECT item_id AS query_id, text AS query, {_WORDS.format("text")} AS own FROM benchmark),
    qe AS (SELECT query_id, len(own) AS n, unnest(own) AS word FROM qw), de AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS word FROM documents),
    sh AS (SELECT query_id, doc_id, count(*) / any_value(n) AS score FROM qe JOIN de USING (word) GROUP BY query_id, doc_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sh QUALIFY place <= 15)"""
_CANDIDATES = _FOUND + r""",
    c AS (SELECT query_id, query, place AS retrieval_rank, d.text FROM top JOIN qw USING (query_id) JOIN documents d USING (doc_id)),
    w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS q, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM c),
    s AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS score FROM w)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_FOUND} SELECT query_id, doc_id, round(score, 6) AS score, place AS rank FROM top")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share most words with each benchmark item, of all documents."""
    found = retrieval.search_words(table(spark, sf_dir, "documents"), _asked(spark, sf_dir))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BM25 = r"""
    dw AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents WHERE doc_id IS NOT NULL),
    tf AS (SELECT doc_id, word, count(*) AS tf FROM dw GROUP BY ALL), ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
    st AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*) AS mean FROM ln), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
    wt AS (SELECT word, floor(1000 * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) + 0.5)::BIGINT AS w FROM df, st),
    im AS (SELECT doc_id, word, floor(1000 * (2.2::DOUBLE * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) + 0.5)::BIGINT AS i FROM tf JOIN ln USING (doc_id), st)"""


@query(f"""WITH {_FOUND.split(", de AS")[0]}, {_BM25},
    s AS (SELECT query_id, doc_id, sum(w * i)::BIGINT AS score FROM qe JOIN im USING (word) JOIN wt USING (word) GROUP BY ALL)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 15""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over all documents, then the 15 best of them for each benchmark item."""
    index = lexical.build(table(spark, sf_dir, "documents"), shared_path(spark, "lexical"))
    found = lexical.search(spark, index, _asked(spark, sf_dir))
    return found.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item, with their texts."""
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), _asked(spark, sf_dir)
    found = retrieval.search_words(docs, asked).select("query_id", "doc_id", F.col("rank").cast("long").alias("retrieval_rank"))
    return docs.join(found, "doc_id").join(asked, "query_id").select("query_id", "query", "retrieval_rank", "text")


@query(rf"""WITH {_CANDIDATES}
    SELECT query_id, retrieval_rank, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank) AS rank FROM s QUALIFY rank <= 5""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rerank.rerank(_candidates(spark, sf_dir))
    return rows.select("query_id", "retrieval_rank", F.round("rerank_score", 6).alias("score"), F.col("rerank_rank").cast("long").alias("rank"))


@query(rf"""WITH {_CANDIDATES}, m AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM s)
    SELECT query_id, retrieval_rank, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS relevance FROM m""")
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rerank.min_max(rerank.scored(_candidates(spark, sf_dir)))
    return rows.select("query_id", "retrieval_rank", F.round("relevance", 6).alias("relevance"))


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection, which SQL can't express; the tests hold worked examples."""
    rows = _candidates(spark, sf_dir).withColumn("retrieval_rank", F.col("retrieval_rank").cast("int"))
    return rerank.rerank_diverse(rows, 3)


@query(rf"""WITH {_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_rank) AS rank FROM s QUALIFY rank <= 3)
    SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r GROUP BY query_id""")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.context(rerank.rerank(_candidates(spark, sf_dir), 3))


@query(f"""SELECT item_id, '{prompts.SYSTEM.replace("'", "''")}' AS system, replace(replace('{prompts.QUESTION.replace(chr(10), chr(92) + "n")}', '\\n', chr(10)), '{{context}}', 'some passages')
        .replace('{{query}}', text) AS human, 2::BIGINT AS messages FROM benchmark""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", prompts.answer_prompt(F.lit("some passages"), F.col("text")).alias("p"))
    return rows.select("item_id", F.col("p")[0]["content"].alias("system"), F.element_at("p", -1)["content"].alias("human"), F.size("p").cast("long").alias("messages"))


_HITS = _FOUND + r""",
    tp AS (SELECT item_id AS query_id, item_id % 3 AS tier, list_distinct(list_filter(string_split_regex(text, '[^\p{L}]+'), lambda x: length(x) >= 6)) AS topics FROM benchmark),
    hits AS (SELECT query_id, tier, topics, d.text, score FROM top JOIN tp USING (query_id) JOIN documents d USING (doc_id)),
    each AS (SELECT query_id, tier, topics, unnest(topics) AS topic, text, score FROM hits),
    found AS (SELECT query_id, tier, topics, topic, bool_or(contains(lower(text), lower(topic))) AS hit, count(*) AS n, max(score) AS s FROM each GROUP BY ALL),
    cov AS (SELECT query_id, tier, max(n)::BIGINT AS docs_retrieved, round(max(s), 6) AS top_score, count(*) FILTER (WHERE hit)::BIGINT AS topics_found, any_value(len(topics))::BIGINT AS total_topics FROM found GROUP BY query_id, tier)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All long words of each benchmark item as its topics, looked for in the best documents of the search."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = docs.join(retrieval.search_words(docs, _asked(spark, sf_dir)), "doc_id").select("query_id", "text", "score")
    topics = F.array_distinct(F.filter(F.split("query", r"[^\p{L}]+"), lambda x: F.length(x) >= 6))
    asked = _asked(spark, sf_dir).select("query_id", topics.alias("topics"))
    return evaluate.topic_coverage(hits, asked).withColumn("top_score", F.round("top_score", 6)).withColumn("tier", F.col("query_id") % 3)


@query(f"WITH {_HITS} SELECT query_id, tier, docs_retrieved, top_score, topics_found, total_topics, round(topics_found / total_topics, 2) AS topic_coverage FROM cov")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).where("total_topics > 0").select("query_id", "tier", "docs_retrieved", "top_score", "topics_found", "total_topics", "topic_coverage")


@query(f"WITH {_HITS} SELECT tier, count(*) AS questions, round(avg(round(topics_found / total_topics, 2)), 6) AS coverage, round(avg(top_score), 6) AS score FROM cov GROUP BY ROLLUP (tier)")
def coverage_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.by_tier(_coverage(spark, sf_dir).where("total_topics > 0"))
    return rows.select("tier", "questions", F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"))


@query(f"""
    WITH e AS (SELECT vec_id, label, {_D.format("embedding")} AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, q.label = e.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format("e.v", "q.v")} DESC, e.vec_id) AS rank
        FROM e, e q WHERE e.vec_id <> q.vec_id QUALIFY rank <= 10),
    f AS (SELECT query_id, min(rank) FILTER (WHERE relevant) AS r FROM s GROUP BY query_id)
    SELECT round(avg(coalesce(1 / r, 0)), 6) AS mrr, count(*) AS queries FROM f""")
def mrr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a query, against all. A hit is relevant when it has the query's label; the query itself is left out."""
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = retrieval.search_grid(corpus, queries, 11).where("vec_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 10")
    labels = corpus.select("vec_id", "label")
    both = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return evaluate.mean_reciprocal_rank(both.withColumn("relevant", F.col("label") == F.col("own"))).select(F.round("mrr", 6).alias("mrr"), "queries")


@query(r"""
    WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM documents)
    SELECT a.doc_id, round(len(list_intersect(a.t, b.t)) / len(a.t), 6) AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 WHERE len(a.t) > 0""")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(other, "doc_id").select("doc_id", F.round(overlap_score("text", "other"), 6).alias("overlap"))


@query()
def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents and answer every benchmark item: route, search, rerank, context, answer."""
    chunks = saved(pipeline.ingested(table(spark, sf_dir, "documents").select("doc_id", "text")), "chunks")  # read twice: searched, and for the hits' texts
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("s").alias("session_id"), F.col("text").alias("query"))
    return pipeline.answered(asked, chunks).select("query_id", "query", "query_type", "response", F.size("sources").alias("sources"), F.size("prompt").alias("messages"))
