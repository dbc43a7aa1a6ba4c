"""The sales fact: orders with customers, items, products and payments.

One fact row per order x item x payment, by left joins, so an order without
items keeps one row and a payment repeats for every item. ``sales_fact`` holds
those rows; ``order_fact`` holds one row per order x payment together with the
number of fact rows it stands for; item columns that are asked for split the
count. Operators give the same answer on both, and the second moves far less
data: items are counted on the map side, before any shuffle, so an order of
any length arrives as few rows.

Only the joins whose columns are asked for are built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, CITY, CUSTOMER, ORDER, PAYMENT, PURCHASED, ROWS, STATE, ZIP, money
from ..functions.skew import skew_join
from ..sources.tables import RetailTables

#: What the analyses use when no columns are named.
ORDER_COLUMNS = (CUSTOMER, PURCHASED, PAYMENT)
FACT_COLUMNS = (*ORDER_COLUMNS, ZIP, CITY, STATE, "product_id", "seller_id", "price", "freight_value", CATEGORY)

ITEM_X_PAYMENT = "item_x_payment"
PER_ORDER = "order"


def _own(df: DataFrame | None, wanted: Sequence[str], taken: set[str]) -> list[str]:
    if df is None:
        return []
    return [c for c in wanted if c in df.columns and c not in taken]


def _orders(t: RetailTables, wanted: Sequence[str]) -> tuple[DataFrame, set[str]]:
    """Orders, with the customer columns that the order rows lack."""
    own = _own(t.orders, wanted, {ORDER})
    lacking = _own(t.customers, wanted, {ORDER, *own})
    if not lacking:
        return t.orders.select(ORDER, *own), {ORDER, *own}
    key = "customer_id"
    base = t.orders.select(ORDER, key, *[c for c in own if c != key])
    dims = t.customers.select(key, *[c for c in lacking if c != key])
    joined = skew_join(base, dims, key, keep="big")
    return (joined if key in wanted else joined.drop(key)), {ORDER, *own, *lacking}


def _payments(t: RetailTables, wanted: Sequence[str], taken: set[str], grain: str) -> DataFrame | None:
    if t.order_payments is None:
        return None
    cols = _own(t.order_payments, wanted, taken)
    if grain == PER_ORDER:
        total = F.sum(money(PAYMENT)).cast("double").alias(PAYMENT)
        return t.order_payments.groupBy(ORDER).agg(total) if PAYMENT in cols else None
    return t.order_payments.select(ORDER, *cols)


def _items(t: RetailTables, wanted: Sequence[str], taken: set[str], known_category: bool = False) -> tuple[DataFrame, list[str]]:
    """Items with the wanted item and product columns."""
    item_cols = _own(t.order_items, wanted, taken)
    product_cols = _own(t.products, wanted, {*taken, *item_cols})
    cols = [*item_cols, *product_cols]
    needed = [*product_cols, *([CATEGORY] if known_category and CATEGORY not in product_cols else [])]
    if not needed:
        return t.order_items.select(ORDER, *cols), cols
    key = "product_id"
    products = t.products.select(key, *needed)
    items = t.order_items.select(ORDER, *item_cols, *([] if key in item_cols else [key]))
    # Before the order columns are attached: the rows are narrow here, and the
    # result ends up placed by order for the joins to come.
    if known_category:
        items = skew_join(items, products.where(F.col(CATEGORY).isNotNull()), key)
    else:
        items = skew_join(items, products, key, keep="big")
    return items.select(ORDER, *cols), cols


def sales_fact(t: RetailTables, columns: Sequence[str] = FACT_COLUMNS, empty_orders: bool = True) -> DataFrame:
    """One row per order x item x payment, with the named columns.

    An order of any number of items or payments can be split over tasks.
    Without ``empty_orders`` orders without items have no row.
    """
    fact, taken = _orders(t, columns)
    if t.order_items is not None:
        items, cols = _items(t, columns, taken)
        taken |= set(cols)
        fact = skew_join(items, fact, ORDER, keep="small" if empty_orders else "neither")
    payments = _payments(t, columns, taken, ITEM_X_PAYMENT)
    if payments is not None:
        fact = skew_join(payments, fact, ORDER, keep="small")
    return fact.select(ORDER, *[c for c in columns if c in fact.columns and c != ORDER])


def order_fact(
    t: RetailTables,
    columns: Sequence[str] = ORDER_COLUMNS,
    payment_grain: str = ITEM_X_PAYMENT,
    complete_items: bool = False,
) -> DataFrame:
    """One row per order x payment and the number of fact rows it stands for.

    Item and product columns among ``columns`` split the rows further, one per
    combination. ``complete_items`` counts only items whose product has a
    category. ``payment_grain="order"`` counts each order and its payments once.
    """
    if payment_grain not in (ITEM_X_PAYMENT, PER_ORDER):
        raise ValueError(f"unknown payment grain: {payment_grain}")
    fact, taken = _orders(t, columns)
    one = F.lit(1).cast("bigint")
    if t.order_items is None or (payment_grain == PER_ORDER and not complete_items):
        fact = fact.withColumn(ROWS, one)
    else:
        items, cols = _items(t, columns, taken, complete_items)
        if payment_grain == PER_ORDER:
            cols = []
        taken |= set(cols)
        counted = items.groupBy(ORDER, *cols).agg(F.count(one).alias(ROWS))
        fact = fact.join(counted, ORDER, "inner" if complete_items else "left")
        fact = fact.withColumn(ROWS, one if payment_grain == PER_ORDER else F.coalesce(F.col(ROWS), one))
    payments = _payments(t, columns, taken, payment_grain)
    if payments is not None:
        fact = skew_join(payments, fact, ORDER, keep="small")
    return fact.select(ORDER, *[c for c in columns if c in fact.columns and c != ORDER], ROWS)


def build_sales_fact(t: RetailTables, payment_grain: str = ITEM_X_PAYMENT, columns: Sequence[str] | None = None) -> DataFrame:
    """The fact at item x payment grain, or with payments counted once per order."""
    if payment_grain == PER_ORDER:
        return order_fact(t, columns or (*ORDER_COLUMNS, ZIP, CITY, STATE), PER_ORDER)
    return sales_fact(t, columns or FACT_COLUMNS)
