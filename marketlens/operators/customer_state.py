"""One mergeable table per customer and month, from which the customer questions follow.

A row holds what the fact says about a customer in a month: fact rows, orders,
rows with a payment, cents, first and last purchase. Each of them merges by a
sum, a minimum or a maximum, so the state of new months is merged in without a
look at old ones, and every operator that asks about customers gives the same
answer on a state as on the fact it was made of. An order has one purchase
time, so it counts in one month.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    CENTS,
    CUSTOMER,
    FIRST,
    LAST,
    MONTH,
    ORDERS,
    PAID_ROWS,
    PAYMENT,
    PURCHASED,
    ROWS,
    count_orders,
    count_rows,
    count_values,
    money_total,
    month_key,
)

_KEYS = (CUSTOMER, MONTH)


def customer_state(fact: DataFrame, *parts: str) -> DataFrame:
    """The state of a fact; ``parts`` are columns that split a month further."""
    known = fact.where(F.col(CUSTOMER).isNotNull())
    return known.groupBy(CUSTOMER, month_key(PURCHASED).alias(MONTH), *parts).agg(
        count_rows(fact).alias(ROWS),
        count_orders(fact).alias(ORDERS),
        count_values(fact, PAYMENT).alias(PAID_ROWS),
        money_total(fact).alias(CENTS),
        F.min(PURCHASED).alias(FIRST),
        F.max(PURCHASED).alias(LAST),
    ).drop(*parts)


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of both facts, of which no order is in both."""
    both = old.unionByName(new)
    return both.groupBy(*_KEYS).agg(
        *[F.sum(c).cast(both.schema[c].dataType).alias(c) for c in (ROWS, ORDERS, PAID_ROWS, CENTS)],
        F.min(FIRST).alias(FIRST),
        F.max(LAST).alias(LAST),
    )


def split_state(state: DataFrame, fact: DataFrame, days: int) -> DataFrame:
    """The state with no row on both sides of ``days`` before the latest purchase.

    Only that month of the fact is read again; its bounds reach the scan.
    """
    end = state.agg(F.max(LAST).alias("t")).first()["t"]
    if end is None:
        return state
    cutoff = end - timedelta(days=days)
    month = datetime(cutoff.year, cutoff.month, 1)
    after = (month + timedelta(days=32)).replace(day=1)
    kind = fact.schema[PURCHASED].dataType
    low, high, cut = (F.lit(t).cast(kind) for t in (month, after, cutoff))
    again = fact.where((F.col(PURCHASED) >= low) & (F.col(PURCHASED) < high))
    parts = customer_state(again.withColumn("_late", F.col(PURCHASED) > cut), "_late")
    kept = state.where(F.col(MONTH).isNull() | (F.col(MONTH) != month.strftime("%Y-%m")))
    return kept.unionByName(parts)
