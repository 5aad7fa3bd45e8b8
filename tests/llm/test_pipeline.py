"""The pipeline's stages, each against a plain version of itself on the rows that it got."""

import re
import struct

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

import corpus_pipeline
from corpusflow.llm.queries import PIECES
from tests.llm.test_operators import plain_groups, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    leak = prose(999, 30)
    docs = [(i, prose(i, 120)) for i in range(60)] + [(100 + i, prose(i, 120)) for i in range(20)] + [(200, prose(200, 100) + leak), (201, "few words"), (202, None)]
    words = prose(7, 120).split()
    for k, n in ((250, 1), (251, 3), (252, 12)):  # near copies of document 7, the last one below 0.8
        docs.append((k, " ".join("other" if j % 10 == 5 and j < 10 * n else w for j, w in enumerate(words))))
    docs += [(300 + i, re.sub(r"(\w) ", r"\1%%%&&& ", prose(i, 120))) for i in range(10)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality rules":
            assert seen[name] == {*range(60), *range(100, 120), 200, 250, 251, 252}
        elif name == "simhash near-duplicates":
            groups = plain_groups([(r.doc_id, r.text) for r in before.collect()])
            assert seen[name] == set(groups.values()) and not seen[name] & {*range(100, 120), 250, 251} and 252 in seen[name]
        elif name == "benchmark decontamination":
            assert seen[name] == {r.doc_id for r in before.collect()} - {200}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == seen["sentencepiece encoding"]
    assert docs.where("not round_trip").count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    text = {r.doc_id: r.text for r in before.collect()}
    for r in docs.collect():
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == sp.encode(text[r.doc_id]) and r.n_pieces == len(r.ids) // 4


def test_empty_and_awkward_tables(spark, folder, tmp_path):
    """No documents; then nulls in any column, repeated rows and a shared id, and a column whose name a stage uses itself."""
    kinds = spark.read.parquet(f"{folder}/documents.parquet").schema
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    empty = spark.createDataFrame([], kinds)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
    rows = [(None, prose(1, 120), None, None, None), (5, prose(2, 120), None, "s", 1), (5, prose(2, 120), None, "s", 1), (5, prose(3, 120), "en", "s", 2), (6, None, None, None, None), (7, "", "en", "", 0)]
    docs = spark.createDataFrame(rows, kinds).withColumn("node", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == [(False, 5), (True, None)]
