"""The rank index is exact at every boundary, and outputs are cut where a plain tokenisation cuts them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import fill_middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
HARD = [
    "",
    "a",
    "\n",
    "naïve café – 𝔘𝔫𝔦 <x> a_b\r\n\tzz9",
    "word " * 5000,
    "".join("a" * (1 + 977 * (i % 7 == 0)) + " " for i in range(3000)),
    "x" * 100_000,
    "." * 100_000,
    "y" * 50_000 + " " + "." * 3000 + "z" * 70_000,
]


def brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("error", [0, 3, fill_middle.ERROR])
def test_index_is_exact_and_within_its_error(text, error):
    offsets = fill_middle.boundaries(text)
    assert offsets.tolist() == [m.start() for m in TOKEN.finditer(text)] + [len(text)]
    ranks, slopes = fill_middle.fit(offsets, error)
    left = fill_middle.residuals(offsets, ranks, slopes)
    assert abs(left).max() <= error
    assert ranks[0] == 0 and all(a < b for a, b in zip(ranks, ranks[1:]))


def test_even_text_needs_one_segment():
    assert len(fill_middle.fit(fill_middle.boundaries("word " * 5000))[0]) == 1


def test_every_rank_is_found_again(spark):
    texts = [t for t in HARD if len(t) < 30_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", fill_middle.boundary_index("text").alias("index"))
    ranks = rows.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("index.n"))))
    found = ranks.select("doc_id", "rank", fill_middle.cut_at(F.col("index"), F.col("rank")).alias("at")).toPandas()
    for i, group in found.groupby("doc_id"):
        assert np.array_equal(group.sort_values("rank")["at"], fill_middle.boundaries(texts[i]))


def test_outputs_equal_brute_force(spark, awkward):
    texts = [*HARD, "has <M> in it", "<", "a<P", "S>b <S", "<P", "P>", ">", None]
    rows = [(i * 37 + j, t) for i in range(12) for j, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(awkward.select("doc_id", "text"))
    want = sorted((brute(*r) for r in docs.collect()), key=repr)
    out = fill_middle.transform(docs)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sums = fill_middle.digests(out).collect()
    originals = sorted((r["doc_id"] is None, r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["restored_sha256"]) for r in sums) == originals


def test_rates_and_seed(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    forms = {r["form"]: r["count"] for r in fill_middle.transform(docs, cut=50, suffix_first=50).groupBy("form").count().collect()}
    assert 850 < forms["plain"] < 1150 and 400 < forms["psm"] < 600 and 400 < forms["spm"] < 600
    other = fill_middle.transform(docs, seed="2").select("doc_id", "output")
    assert other.join(fill_middle.transform(docs).select("doc_id", "output"), ["doc_id", "output"]).count() < 1000


def test_clashing_columns_and_no_rows(awkward, no_docs):
    clash = awkward.withColumns({"n": F.lit("x"), "form": F.lit(1), "index": F.lit(2), "output": F.lit(3), "a": F.lit(4), "b": F.lit(5)})
    assert fill_middle.transform(clash).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_middle.transform(clash).count() == awkward.count()
    assert fill_middle.digests(fill_middle.transform(no_docs)).count() == 0
