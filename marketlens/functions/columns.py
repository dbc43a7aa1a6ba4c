"""Column expressions shared by the operators.

They carry the rules that decide whether an answer is right: elapsed days
floor, sums of nothing are zero, money adds up exactly in any task order,
bins are closed on the right and rounding goes to even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUSTOMER = "customer_unique_id"
ORDER = "order_id"
PURCHASED = "order_purchase_timestamp"
PAYMENT = "payment_value"
CATEGORY = "product_category"
STATE = "customer_state"
CITY = "customer_city"
ZIP = "customer_zip_code_prefix"

#: How many fact rows a row stands for. A collapsed fact carries it; a fact
#: with one row per item does not and counts as one each.
ROWS = "fact_rows"

#: Further columns of a customer state (``operators.customer_state``), one row per customer and month.
MONTH, ORDERS, PAID_ROWS, CENTS, FIRST, LAST = "state_month", "state_orders", "state_paid_rows", "state_cents", "state_first", "state_last"

_DAY_MICROS = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end, rounded down (-2 hours is -1 day)."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return F.floor(micros / F.lit(_DAY_MICROS)).cast("int")


def is_state(df: DataFrame) -> bool:
    """Whether ``df`` is a customer state and not a fact."""
    return CENTS in df.columns


def earliest(df: DataFrame, where: Column | None = None) -> Column:
    """Aggregate: the first purchase."""
    value = F.col(FIRST if is_state(df) else PURCHASED)
    return F.min(value if where is None else F.when(where, value))


def latest(df: DataFrame, where: Column | None = None) -> Column:
    """Aggregate: the last purchase."""
    value = F.col(LAST if is_state(df) else PURCHASED)
    return F.max(value if where is None else F.when(where, value))


def purchased(df: DataFrame) -> Column:
    """A purchase time in the month of the row; of a fact row, its own."""
    return F.col(FIRST if is_state(df) else PURCHASED)


def count_orders(df: DataFrame) -> Column:
    """Aggregate: how many orders there are."""
    return F.sum(ORDERS) if is_state(df) else F.countDistinct(ORDER)


def row_weight(df: DataFrame) -> Column:
    """Number of fact rows each row of ``df`` stands for."""
    return F.col(ROWS) if ROWS in df.columns else F.lit(1).cast("bigint")


def count_rows(df: DataFrame) -> Column:
    """Aggregate: how many fact rows there are."""
    return F.sum(F.col(ROWS)) if ROWS in df.columns else F.count(F.lit(1))


def count_values(df: DataFrame, col: str) -> Column:
    """Aggregate: how many fact rows have a value in ``col``."""
    if is_state(df):
        return F.coalesce(F.sum({PAYMENT: PAID_ROWS, ORDER: ROWS}[col]), F.lit(0).cast("bigint"))
    if ROWS in df.columns:
        return F.coalesce(F.sum(F.when(F.col(col).isNotNull(), F.col(ROWS))), F.lit(0).cast("bigint"))
    return F.count(F.col(col))


def money(c: Column | str) -> Column:
    return _col(c).cast("decimal(18,2)")


def _cents(c: str) -> Column:
    return F.rint(F.col(c) * 100).cast("bigint")


def money_total(df: DataFrame, col: str = PAYMENT, where: Column | None = None) -> Column:
    """Aggregate: exact sum over fact rows in cents; nothing sums to zero.

    Values are turned into whole cents and multiplied and added up as decimals,
    which do not overflow and do not depend on the order.
    """
    if is_state(df):
        value = F.col(CENTS)
    elif ROWS in df.columns:
        value = _cents(col).cast("decimal(18,0)") * F.col(ROWS).cast("decimal(15,0)")
    else:
        value = _cents(col).cast("decimal(18,0)")
    if where is not None:
        value = F.when(where, value)
    return F.coalesce(F.sum(value).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def from_cents(total: Column) -> Column:
    return total.cast("double") / 100


def money_sum(df: DataFrame, col: str = PAYMENT, where: Column | None = None) -> Column:
    """Aggregate: exact sum over fact rows, handed out as double."""
    return from_cents(money_total(df, col, where))


def money_mean(df: DataFrame, col: str = PAYMENT) -> Column:
    """Aggregate: mean over the fact rows that have a value."""
    n = count_values(df, col)
    return F.when(n > 0, money_sum(df, col) / n)


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def quarter_key(ts: Column | str) -> Column:
    return F.concat(F.year(_col(ts)).cast("string"), F.lit("Q"), F.quarter(_col(ts)).cast("string"))


def cut(value: Column | str, edges: Sequence[Column | float], labels: Sequence) -> Column:
    """Right-closed bins: the first label whose edge is not below the value."""
    value = _col(value)
    out = F
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge, F.lit(label))
    return F.when(value.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(labels[-1])))


def half_even(c: Column | str, scale: int = 2) -> Column:
    """Round the scaled double, ties to even."""
    unit = F.lit(10.0**scale)
    return F.rint(_col(c) * unit) / unit


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate over ``df`` as a scalar subquery: no join, no collect."""
    return df.agg(value.alias("v")).scalar()


def share_hash(key: Column | str, seed: int, buckets: int) -> Column:
    """A bucket in ``0..buckets-1`` that depends on the key alone."""
    digest = F.md5(F.concat_ws("-", _col(key).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
