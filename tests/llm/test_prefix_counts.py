"""Token counts of all prefixes against the tokenizer itself."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marketlens.llm import prefix_counts
from marketlens.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
ODD = [
    "",
    None,
    " ",
    "   x ",
    "a\x00b",
    "▁▁ x▁",
    "日本語のテキスト と 漢字",
    "😀😀 a😀b",
    "<s> </s><unk><0x0A>",
    "a" * 300,
    " " * 40 + "x" + " " * 17,
    "=====-----" * 6,
    "\n\n \t\r\n",
    "don't U.S. (e.g.) 'x' \"q\".​﻿",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return prefix_counts.load_pieces(PATH)


def counts(row):
    return np.cumsum(np.frombuffer(row["steps"], f"<i{row['width']}"), dtype=np.int64).tolist()


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(" ab▁\n.,é漢😀=-the") for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("narrow, kept", [(126, 1 << 20), (126, 2000), (0, 1 << 20)])
def test_every_prefix_equals_the_tokenizer(model, pieces, narrow, kept):
    some = texts()
    found = prefix_counts.PrefixTables(pieces, kept, narrow).tables(pa.array(some, pa.string())).to_pylist()
    assert narrow or {r["width"] for r in found} == {4}
    for text, row in zip(some, found):
        text = text or ""
        assert counts(row) == [len(model.encode(text[:i])) for i in range(1, len(text) + 1)], text
        assert row["n_tokens"] == len(model.encode(text))


def test_long_texts_take_linear_time(model, pieces):
    long = ["ab" * 200_000, " ".join(["x1"] * 200_000), "né " * 100_000]
    found = prefix_counts.PrefixTables(pieces).tables(pa.array(long)).to_pylist()
    assert [r["n_tokens"] for r in found] == [len(model.encode(t)) for t in long]


def test_slices_of_an_array(model, pieces):
    some = pa.array(["drop me", "one two", None, "three"])
    found = prefix_counts.PrefixTables(pieces).tables(some.slice(1, 3)).to_pylist()
    assert [r["n_tokens"] for r in found] == [len(model.encode(t)) for t in ("one two", "", "three")]


def test_questions_are_answered_from_the_table(spark, model):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:60])], "doc_id int, text string")
    tabled = prefix_counts.prefix_tables(docs, PATH)
    asked = tabled.select(
        "text",
        prefix_counts.tokens_at(F.col("prefix"), F.lit(7)).alias("at"),
        prefix_counts.longest_prefix(F.col("prefix"), 9).alias("fits"),
        prefix_counts.longest_prefix(F.col("prefix"), F.lit(0)).alias("none"),
    )
    for r in asked.collect():
        text = r["text"] or ""
        sizes = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        assert r["at"] == sizes[min(7, len(text))]
        assert r["fits"] == max(i for i, n in enumerate(sizes) if n <= 9)
        assert r["none"] == 0
    cut = prefix_counts.truncate(tabled, 9).select("text").collect()
    assert all(len(model.encode(r["text"] or "")) <= 9 for r in cut)


def test_counts_of_documents(spark, model, awkward, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(model.encode(text))
        want.append((r["doc_id"], len(text.encode()), n, n > 500))
    got = prefix_counts.count_tokens(docs, PATH, 500)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:4]) for r in got.collect())
    assert prefix_counts.count_tokens(no_docs, PATH, 500).count() == 0


def test_other_columns_stay(awkward):
    clash = awkward.withColumn("steps", F.lit(1)).withColumn("n_tokens", F.lit(2))
    out = prefix_counts.prefix_tables(clash, PATH)
    assert out.columns == [*clash.columns, "prefix"] and out.count() == awkward.count()
