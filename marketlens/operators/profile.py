"""Data set summaries: shape, types, missing values, previews, value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, percentage missing (2 decimals) and the table's shape.

    One aggregate over the data gives every column's count; the rows are
    spread out afterwards.
    """
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col(f"c{i}").alias("present"),
        )
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    rows = counts.select("n", F.explode(F.array(*entries)).alias("e")).select("n", "e.*")
    missing = F.when(F.col("n") > 0, half_even((F.col("n") - F.col("present")) * 100.0 / F.col("n")))
    return rows.select(
        "position",
        "column_name",
        "data_type",
        missing.alias("null_pct"),
        F.col("n").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
    )


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def value_counts(df: DataFrame, col: str, out: str = "customer_count") -> DataFrame:
    """How often each value occurs, most frequent first; NULL is no value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    return counts.orderBy(F.desc(out), col)


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence) -> DataFrame:
    """Counts of ``rows`` x ``cols``, zero where a pair does not occur."""
    known = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    table = known.groupBy(rows).pivot(cols, list(values)).agg(F.count(F.lit(1)))
    return table.fillna(0, subset=[str(v) for v in values])


def complete_pairs(df: DataFrame, key: str, col: str, values: Sequence, count: Column, out: str = "count") -> DataFrame:
    """Like a grouped count, with a zero row for every pair not observed."""
    wide = df.where(F.col(key).isNotNull()).groupBy(key).pivot(col, list(values)).agg(count)
    names = [str(v) for v in values]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias(col), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(out)) for v, n in zip(values, names)]))
    return wide.select(key, pairs.alias("p")).select(key, f"p.{col}", f"p.{out}")
