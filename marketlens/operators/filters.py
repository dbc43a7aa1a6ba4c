"""Row filters and facet lists over the sales fact."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, CITY, PURCHASED, STATE


def complete_rows(df: DataFrame, cols: Sequence[str] = (CITY, STATE, CATEGORY)) -> DataFrame:
    """Rows that have a value in every one of ``cols``."""
    return df.dropna(subset=list(cols))


def in_window(df: DataFrame, start: date, end: date, col: str = PURCHASED) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both days included.

    Compares the stored timestamp, not a date made from it, so that the range
    reaches the scan and skips row groups.
    """
    kind = df.schema[col].dataType.simpleString()
    first = F.lit(start.isoformat()).cast(kind)
    beyond = F.lit((end + timedelta(days=1)).isoformat()).cast(kind)
    return df.where((F.col(col) >= first) & (F.col(col) < beyond))


def facet_filter(
    df: DataFrame, states: Sequence[str] = (), cities: Sequence[str] = (), categories: Sequence[str] = ()
) -> DataFrame:
    """Keep the chosen states, cities and categories; an empty list keeps all."""
    for col, chosen in ((STATE, states), (CITY, cities), (CATEGORY, categories)):
        if chosen:
            df = df.where(F.col(col).isin(list(chosen)))
    return df


def slice_by(df: DataFrame, col: str, value) -> DataFrame:
    """One value of a column, or a list of them; ``"All"`` keeps every row."""
    if isinstance(value, str) and value == "All":
        return df
    if isinstance(value, (list, tuple, set)):
        return df.where(F.col(col).isin(list(value)))
    return df.where(F.col(col) == value)


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """The distinct values to choose from, sorted."""
    return df.select(col).dropna().distinct().orderBy(col)


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    return unique.select(*[F.col(f"c{i}").alias(n) for n, i in sorted(first.items(), key=lambda kv: kv[1])])
