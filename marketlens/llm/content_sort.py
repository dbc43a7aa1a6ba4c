"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters and sorted (Spark's sort spills
to disk), so equal texts lie next to each other and a window compares neighbours
in full. The splitters are the text's first bytes and its digest, so what is
sampled is of bounded size however long the texts are; equal texts have both in
common, and whole texts are compared behind them. A text that fills more than
half a partition, in rows or in bytes, would hold up one task; its rows get a
salt, so the splitters can divide them, and a pre-aggregated count says how many
there are.

Defined results: null counts as the empty text. Of equal texts the row with the
largest ``doc_id`` stays (null ids come last); of repeated rows with that id
one stays. ``keep_id`` is null only where all ids of the group are. Columns of
the input are kept; very long texts are compared whole; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, text_of

#: First bytes of a text in a splitter.
_BEGIN = 32


def _hot_texts(docs: DataFrame, parts: int, names: tuple[str, str, str]) -> DataFrame:
    """Copies of a text that hold more than 1 / (2 * parts) of all rows or bytes: fewer than 4 * parts texts, so they can be broadcast."""
    sha, last, size = names
    volume = fresh("bytes")
    length = F.octet_length(text_of()).cast("bigint")
    counts = docs.groupBy(F.sha2(text_of().cast("binary"), 256).alias(sha)).agg(
        F.max("doc_id").alias(last), F.count(F.lit(1)).alias(size), F.sum(length).alias(volume)
    )
    rows, total = docs.agg(F.count(F.lit(1))).scalar(), docs.agg(F.sum(length)).scalar()
    share = F.greatest(F.col(size) / rows, F.try_divide(F.col(volume), total))
    return counts.where((F.col(size) > 1) & (share > 1 / (2 * parts))).drop(volume)


def exact_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 added in a struct column ``dedup``."""
    parts = salts or partitions(docs.sparkSession)
    text, sha, salt, last, size, place, begin = (fresh(x) for x in ("text", "sha", "salt", "last", "size", "place", "begin"))
    hot_last, hot_size = fresh("hot_last"), fresh("hot_size")
    hot = _hot_texts(docs, parts, (sha, hot_last, hot_size))
    first_bytes = F.substring(text_of().cast("binary"), 1, _BEGIN)
    rows = docs.withColumns({text: text_of(), begin: first_bytes, sha: F.sha2(text_of().cast("binary"), 256)}).join(
        F.broadcast(hot), sha, "left"
    )
    spread = F.when(F.col(hot_size).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    by = [begin, sha, salt]
    down = F.col("doc_id").desc_nulls_last()
    group = Window.partitionBy(*by, text)
    placed = (
        rows.withColumn(salt, spread.cast("int"))
        .repartitionByRange(parts, *by)
        .sortWithinPartitions(*by, text, down)
        .withColumns(
            {
                place: F.row_number().over(group.orderBy(down)),
                last: F.first("doc_id").over(group.orderBy(down)),
                size: F.count(F.lit(1)).over(group),
            }
        )
    )
    is_hot = F.col(hot_size).isNotNull()
    keep = F.when(is_hot, F.col(hot_last)).otherwise(F.col(last))
    first = (F.col(place) == 1) & (F.col("doc_id").eqNullSafe(keep))
    # all rows with a null id of a hot text have one salt, so one of them is first there
    return placed.select(
        *[F.col(c) for c in docs.columns],
        F.struct(
            keep.alias("keep_id"),
            F.coalesce(F.col(hot_size), F.col(size)).cast("bigint").alias("group_size"),
            first.alias("kept"),
            F.col(sha).alias("text_sha256"),
        ).alias(_result(docs)),
    )


def _result(docs: DataFrame) -> str:
    """``dedup``, or a longer name where the input has that one."""
    name = "dedup"
    while name in docs.columns:
        name += "_"
    return name


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: which row stays for it."""
    found = exact_dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "dedup.*")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the input's columns."""
    return exact_dedup(docs).where(F.col(f"{_result(docs)}.kept")).select(*docs.columns)
