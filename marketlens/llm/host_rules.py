"""Quality rules judged per host with empirical-Bayes shrinkage.

Each text is measured once in Arrow batches. A document's rule failures are
counted per host, the hosts' failure rates are shrunk towards a beta prior
fitted to all hosts by moments, and each host's verdict is joined back to its
documents. A host is refused when its shrunken rate reaches ``max_rate``; a
document is kept when it passes the base rules and its host is not refused.

Defined results: a null text has no words (and so fails the base rules); a
null host is a host of its own, judged like any other; repeated rows count each;
very long texts are measured whole; an empty table gives no rows; other columns pass through ``screen`` untouched.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.staging import materialize
from .common import fresh

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_TAIL_BYTES = bytes(range(0x80, 0xC0))


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = (text or "").encode()
    words = data.split()  # splits at ASCII white space alone
    if not words:
        return 0, 0, len(data.translate(None, _NOT_SYMBOLS)), 0, 0
    chars = sum(map(len, words))
    if len(data) != len(text):
        chars -= len(data) - len(data.translate(None, _TAIL_BYTES))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        upto = 0  # words before it are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, len(data.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    rows = [measure_text(t) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], names=list(MEASURES))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def failed_rules(m: Column) -> Column:
    """Whether any rule fails; these failures are what hosts are judged by."""
    return (
        base_failed(m)
        | (10 * m["n_symbols"] > m["n_words"] * 5)
        | (m["word_chars"] < 2 * m["n_words"])
        | (m["word_chars"] > 20 * m["n_words"])
        | (m["n_dup_lines"] >= 10)
    )


def host_rates(measured: DataFrame, host: str, m: str) -> DataFrame:
    """host, n_docs, n_failed, rate: the posterior mean under a beta prior fitted to all hosts.

    The prior's mean is the corpus' failure rate and its strength comes from how
    much the hosts' rates vary beyond binomial noise; it counts as one document
    at least. Without any such variation
    (or with a single host) all hosts get the corpus' rate.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(failed_rules(F.col(m)).cast("bigint")).alias("n_failed"),
    )
    hosts = materialize(hosts, "hosts")
    n, f = F.col("n_docs"), F.col("n_failed")
    total = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")
    ).first()
    if not total["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = total["f"] / total["n"]
    # weighted moments: S = sum n (rate - mean)^2 has mean v * ((k - 1) (1 - rho) + rho * (n - nn / n))
    spread = total["ffn"] - total["n"] * mean * mean
    v, k, room = mean * (1 - mean), total["k"], total["n"] - total["nn"] / total["n"]
    rho = (spread - (k - 1) * v) / (v * (room - (k - 1))) if v > 0 and room > k - 1 else 0.0
    rho = min(max(rho, 0.0), 0.5)
    strength = (1 - rho) / rho if rho > 0 else None
    rate = F.lit(mean) if strength is None else (f + F.lit(strength * mean)) / (n + F.lit(strength))
    return hosts.withColumn("rate", rate.cast("double"))


def screen(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of measures and verdicts, and that column's name.

    Texts are measured twice, once for the hosts and once for the result, which
    is cheaper than writing them out in between. The host table has one row per
    host: Spark broadcasts it below its size threshold and splits skewed hosts
    in a sort-merge join above.
    """
    m, name, rate = fresh("m"), fresh("host"), fresh("rate")
    measured = docs.withColumns({m: measures("text"), name: F.coalesce(F.col(host).cast("string"), F.lit(""))})
    rates = host_rates(measured.select(name, m), name, m).select(F.col("host").alias(name), F.col("rate").alias(rate))
    joined = measured.join(rates, name)
    bad = base_failed(F.col(m))
    verdict = F.struct(
        F.col(f"{m}.*"),
        bad.alias("base_failed"),
        F.col(rate).alias("host_rate"),
        (F.col(rate) >= max_rate).alias("host_refused"),
        (~bad & (F.col(rate) < max_rate)).alias("kept"),
    )
    return joined.withColumn(m, verdict).select(*docs.columns, m), m


def quality_verdicts(docs: DataFrame) -> DataFrame:
    found, m = screen(docs.select("doc_id", "text", "source"))
    return found.select("doc_id", f"{m}.*")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """Documents that are kept, with the input's columns."""
    found, m = screen(docs)
    return found.where(F.col(f"{m}.kept")).select(*docs.columns)
