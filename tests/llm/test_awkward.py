"""Awkward rows: ties, repeated rows, very long texts, clashing columns, empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlens.llm import chat, content_sort, host_rules, licenses, mixture, near_dup, ngram_filter, packing, pii, pu_quality
from marketlens.llm.common import tokenizer_path

LONG = " ".join(f"word{i % 4001}." for i in range(250_000))  # over 2 MB


def chats(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumns({c: F.lit("x") for c in extra})


def test_chat_ties_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (2, 0, "user", LONG), (2, 1, "assistant", LONG), (None, 0, "user", None)]
    got = chat.format_chats(chats(spark, rows, ("turns", "segments", "formatted", "valid", "id")))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["b"]] for r in got.select("conv_id", chat.parse_chat(F.col("formatted")).alias("b")).collect()}
    assert back[1] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert back[2] == [("user", LONG), ("assistant", LONG)] and back[None] == [("user", "")]


@pytest.fixture
def clashing(awkward):
    """Names that the operators use for their own columns."""
    names = "row ids n_tokens length start base terms spans words chunk learn x known positive n share rate tokens cell regs cls n_shingles digest kept"
    return awkward.withColumns({n: F.lit("theirs") for n in names.split()})


def test_clashing_columns(spark, clashing, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    n = awkward.count()
    assert ngram_filter.score_documents(clashing, chunk_mb=0.1).count() == n
    assert pu_quality.score_quality(clashing, labels).count() == n
    assert pii.span_digests(clashing).count() == n
    assert licenses.scan_licenses(clashing).count() == n
    assert near_dup.near_duplicates(clashing).count() == n
    assert {r["doc_id"] for r in packing.pack_documents(clashing, tokenizer_path()).select("doc_id").collect()} == {r["doc_id"] for r in awkward.select("doc_id").collect()}
    for keep in (content_sort.drop_copies, near_dup.drop_near_copies, host_rules.drop_rejected, mixture.drop_unsampled):
        assert keep(clashing).columns == clashing.columns


def test_no_scores_of_nothing(no_docs):
    assert ngram_filter.score_documents(no_docs).count() == 0


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG, "s", "en"), (2, LONG + " end", "s", "en"), (3, "short text", "s", "en")], "doc_id bigint, text string, source string, lang string")
    assert licenses.scan_licenses(docs).where("doc_id = 1").first()["n_words"] == 250_000
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["group_size"] for r in content_sort.verdicts(docs.select("doc_id", "text")).collect()} == {1: 1, 2: 1, 3: 1}
    assert ngram_filter.score_documents(docs).where("doc_id = 2").first()["n_tokens"] == 250_002
    pieces = packing.pack_documents(docs, tokenizer_path()).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert pieces[0] == pieces[1]


def test_pipeline_of_awkward_rows(spark, awkward):
    """Null ids, repeated rows and extra columns go through every stage."""
    import corpus_pipeline

    at = awkward.unionByName(awkward)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, "")
        assert out.columns == awkward.columns, name
        had, has = (Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in (at, out))
        assert not has - had, name
        at = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, "")
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}
