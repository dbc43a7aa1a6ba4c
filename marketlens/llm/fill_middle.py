"""Fill-in-the-middle transformation over a learned rank index of token boundaries.

Index. A text's tokens are ``[A-Za-z]+|[^A-Za-z]``, so n tokens have n + 1
boundaries, rank 0 at offset 0 and rank n at the end, in code points. The
offsets grow almost in a line, so the index of a text is a few line segments,
each fitted greedily to as many boundaries as one line can meet within ``ERROR``
code points, and one byte per boundary: how far the line is off. A cut at rank
k is the prediction of the segment that holds k plus the stored residual, which
is exact, and neither needs the text nor another pass over its tokens.

Transformation. Two ranks drawn from a hash of the document's id cut the text
into prefix, middle and suffix. The forms are ``psm`` (``<P>`` prefix ``<S>``
suffix ``<M>`` middle), ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle)
and ``plain`` (the text as it is). A text that holds one of the marks stays
plain, and no two marks share a beginning with another's end, so the marks of
an output are found where they were put and :func:`restored` is exact.

The draws depend on the id alone: they are the same in any partitioning and
after a lost executor. Fitting works text by text in Arrow batches; looking up,
cutting and joining are columns.

Defined results: a null text is the empty text, which has no tokens and stays
plain; a null id counts as the empty string in the hash; rows that repeat an id
are transformed each, equal texts alike; a very long text has as many segments
as its lines need and is never cut short; other columns are left out, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: How far a line may be off at any boundary; a residual fits a byte.
ERROR = 120
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: documents that are cut, and those of them that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = "1"

SEGMENT = T.StructType().add("rank", "long").add("offset", "long").add("slope", "double")
INDEX = T.StructType().add("n", "long").add("segments", T.ArrayType(SEGMENT)).add("residuals", "binary")


# index ----------------------------------------------------------------------


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, where tokens begin, and the end."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((code | 32) - 97) < 26  # unsigned: what lies under 'a' wraps around
    starts = np.ones(len(code), bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(starts), len(code))


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[float]]:
    """First ranks and slopes of segments that are off by at most ``error`` at every rank.

    A segment starts on its first boundary. Each later one leaves a cone of
    slopes that pass within the error; the segment ends where the cones no
    longer share one. It is looked at in stretches that double, so the work
    is linear however short the segments are.
    """
    ranks, slopes, at, last = [], [], 0, len(offsets) - 1
    while at <= last:
        reach, slope, end = 64, 0.0, at
        low, high = -np.inf, np.inf
        while end < last:
            stop = min(last, end + reach)
            steps = np.arange(end + 1 - at, stop + 1 - at)
            rise = offsets[end + 1 : stop + 1] - offsets[at]
            lows = np.maximum.accumulate(np.maximum((rise - error) / steps, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / steps, high))
            apart = lows > highs
            good = int(apart.argmax()) if apart.any() else len(steps)
            if good:
                low, high = lows[good - 1], highs[good - 1]
                slope, end = float(low + high) / 2, end + good
            if good < len(steps):
                break
            reach *= 2
        ranks.append(at)
        slopes.append(slope)
        at = end + 1
    return ranks, slopes


def residuals(offsets: np.ndarray, ranks: list[int], slopes: list[float]) -> np.ndarray:
    """How far each boundary lies from its segment's prediction."""
    held = np.diff(np.append(ranks, len(offsets)))
    first = np.repeat(ranks, held)
    line = np.repeat(slopes, held) * (np.arange(len(offsets)) - first)
    return offsets - offsets[first] - np.floor(line + 0.5).astype(np.int64)


@F.arrow_udf(INDEX)
def boundary_index(texts: pa.Array) -> pa.Array:
    """The index of each text: n, segments, and residuals plus 128, one byte per rank."""
    n, sizes, ranks, starts, slopes, bytes_ = [], [], [], [], [], []
    for at in range(0, len(texts), 256):
        for text in texts.slice(at, 256).to_pylist():
            offsets = boundaries(text or "")
            r, s = fit(offsets)
            n.append(len(offsets) - 1)
            sizes.append(len(r))
            ranks += r
            slopes += s
            starts += offsets[r].tolist()
            bytes_.append((residuals(offsets, r, s) + 128).astype(np.uint8).tobytes())
    lines = pa.StructArray.from_arrays(
        [pa.array(ranks, pa.int64()), pa.array(starts, pa.int64()), pa.array(slopes, pa.float64())], names=SEGMENT.names
    )
    segments = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lines)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), segments, pa.array(bytes_, pa.binary())], names=INDEX.names)


def cut_at(index: Column, rank: Column) -> Column:
    """Offset of the boundary of this rank: predicted by its segment, corrected by its residual."""
    segment = F.element_at(F.filter(index["segments"], lambda s: s["rank"] <= rank), -1)
    line = F.floor(segment["slope"] * (rank - segment["rank"]) + 0.5)
    byte = F.conv(F.hex(F.substring(index["residuals"], rank.cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return segment["offset"] + line + byte - 128


# transformation -------------------------------------------------------------


def draw(which: int, seed: str = SEED, col: str = "doc_id") -> Column:
    """The ``which``-th 32-bit number, from 1, of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row.

    ``cut`` percent of the documents are cut, ``suffix_first`` percent of those
    in the form ``spm``.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text"), boundary_index("text").alias("index"))
    ranks = [F.pmod(draw(i, seed), F.col("index.n") + 1) for i in (1, 2)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= text.contains(mark)
    form = F.when((text == "") | marked | (draw(3, seed) % 100 >= cut), "plain").when(draw(4, seed) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "index", form.alias("form"), F.least(*ranks).alias("low"), F.greatest(*ranks).alias("high"))
    index = F.col("index")
    rows = rows.select(
        "doc_id", "text", "index.n", "form", cut_at(index, F.col("low")).cast("int").alias("a"), cut_at(index, F.col("high")).cast("int").alias("b")
    )
    prefix = F.substring(text, F.lit(1), F.col("a"))
    middle = F.substring(text, F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substring(text, F.col("b") + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    is_cut = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.when(is_cut, F.col("a").cast("bigint")).alias("prefix_chars"),
        F.when(is_cut, (F.col("b") - F.col("a")).cast("bigint")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def digests(transformed: DataFrame) -> DataFrame:
    """The output and the text restored from it as SHA-256, in place of the output."""
    output, form = F.col("output"), F.col("form")
    return transformed.select(
        *[c for c in transformed.columns if c != "output"],
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, form), 256).alias("restored_sha256"),
    )
