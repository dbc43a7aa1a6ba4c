"""Recency, frequency and monetary value per customer, and what follows.

``rfm_base`` reads the fact once; everything later works on one row per
customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    CATEGORY,
    CUSTOMER,
    ORDER,
    PAYMENT,
    count_orders,
    count_rows,
    count_values,
    cut,
    elapsed_days,
    half_even,
    latest,
    money,
    money_sum,
    month_key,
    purchased,
    scalar,
)
from ..functions.ordering import down, global_row_number
from ..functions.quantiles import quantiles
from ..functions.staging import materialize
from .profile import crosstab

QUARTILES = (0.25, 0.5, 0.75)
GROUPS = ("Low-value", "Medium-value", "High-value")


def rfm_base(fact: DataFrame, freq: str = "rows") -> DataFrame:
    """Recency, Frequency and Monetary per customer.

    Recency counts from one day after the latest purchase of the data.
    Frequency counts fact rows, or distinct orders with ``freq="orders"``.
    """
    if freq not in ("rows", "orders"):
        raise ValueError(f"unknown frequency: {freq}")
    end = scalar(fact, latest(fact))
    times = count_values(fact, ORDER) if freq == "rows" else count_orders(fact)
    per_customer = (
        fact.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(latest(fact).alias("last"), times.alias("Frequency"), money_sum(fact, PAYMENT).alias("Monetary"))
    )
    recency = elapsed_days(F.col("last"), end + F.expr("INTERVAL 1 DAY"))
    return per_customer.select(CUSTOMER, recency.alias("Recency"), "Frequency", "Monetary")


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Scores 1-4 from the quartiles of the customer table, and the joined code.

    Low recency scores high; low frequency and spend score low.
    """
    rfm = materialize(rfm, "rfm")
    q = quantiles(rfm, {"Recency": QUARTILES, "Frequency": QUARTILES, "Monetary": QUARTILES})
    scored = rfm.withColumns(
        {
            "R": cut("Recency", q["Recency"], (4, 3, 2, 1)),
            "F": cut("Frequency", q["Frequency"], (1, 2, 3, 4)),
            "M": cut("Monetary", q["Monetary"], (1, 2, 3, 4)),
        }
    )
    return scored.withColumn("RFM_Score", F.concat(*[F.col(c).cast("string") for c in ("R", "F", "M")]))


def customer_group(rfm: DataFrame, rule: str = "all") -> DataFrame:
    """Add ``CustomerGroup``.

    ``all``: every score must reach 3 (High) or 2 (Medium). ``code``: the
    three-digit code is compared as a number with 444 and 222.
    """
    if rule == "all":
        value, high, medium = F.least("R", "F", "M"), 3, 2
    elif rule == "code":
        value, high, medium = F.col("RFM_Score").cast("int"), 444, 222
    else:
        raise ValueError(f"unknown rule: {rule}")
    group = F.when(value >= high, GROUPS[2]).when(value >= medium, GROUPS[1]).otherwise(GROUPS[0])
    return rfm.withColumn("CustomerGroup", group)


def behavior_segment(rfm: DataFrame, precedence: str = "first") -> DataFrame:
    """Add ``BehaviorSegment``: the first rule that matches, or the last."""
    r, f, m = F.col("R"), F.col("F"), F.col("M")
    rules: list[tuple[str, Column]] = [
        ("Champions", (r == 4) & (f == 4) & (m == 4)),
        ("Loyal Customers", (r >= 3) & (f >= 3)),
        ("Recent Customers", r == 4),
        ("Frequent Buyers", f == 4),
        ("Big Spenders", m == 4),
    ]
    if precedence == "last":
        rules.reverse()
    elif precedence != "first":
        raise ValueError(f"unknown precedence: {precedence}")
    segment = F
    for name, matches in rules:
        segment = segment.when(matches, name)
    return rfm.withColumn("BehaviorSegment", segment.otherwise("Others"))


def rank_bucket(rank: Column, n: Column, buckets: int = 4) -> Column:
    """Equal-width quantile bucket 1..buckets of a rank 1..n, in whole numbers."""
    ahead = (rank - 1) * buckets
    step = F.greatest(n - 1, F.lit(1))
    up = ((ahead + F.pmod(-ahead, step)) / step).cast("int")
    return F.greatest(F.lit(1), up)


def rfm_quartiles(rfm: DataFrame) -> DataFrame:
    """Add quartile numbers: recency by value, the others by descending rank.

    Equal values are ranked in customer order, so every customer has a rank of
    their own and the ranking needs a global order, not a window.
    """
    rfm = materialize(rfm, "rfm")
    q = quantiles(rfm, {"Recency": QUARTILES})["Recency"]
    n = scalar(rfm, F.count(F.lit(1)))
    out = rfm.withColumn("R_Quartile", cut("Recency", q, (1, 2, 3, 4)))
    for source, target in (("Frequency", "F_Quartile"), ("Monetary", "M_Quartile")):
        out = global_row_number(out, [down(source), CUSTOMER], "_rank", written=True)
        out = out.withColumn(target, rank_bucket(F.col("_rank"), n)).drop("_rank")
    return out


def segment_summary(rfm: DataFrame, by: str = "CustomerGroup") -> DataFrame:
    """Customers and mean recency, frequency and spend per segment."""
    n = F.count(F.lit(1))
    return (
        rfm.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            half_even(F.sum("Recency") / n).alias("Recency"),
            half_even(F.sum("Frequency") / n).alias("Frequency"),
            half_even(F.sum(money("Monetary")).cast("double") / n).alias("Monetary"),
            n.alias("CustomerCount"),
        )
    )


def score_matrix(rfm: DataFrame, x: str, y: str) -> DataFrame:
    """Customers per pair of scores: rows ``x``, columns ``y`` 1..4."""
    table = crosstab(rfm, x, y, [1, 2, 3, 4])
    return table.select(x, *[F.col(f"`{v}`").alias(f"{y}_{v}") for v in (1, 2, 3, 4)])


def _rows_per_customer(fact: DataFrame, *keys: Column) -> DataFrame:
    """Fact rows per customer and key, so that a busy customer joins as few rows."""
    known = fact.where(F.col(CUSTOMER).isNotNull())
    return known.groupBy(CUSTOMER, *keys).agg(count_rows(fact).alias("rows"))


def category_by_segment(fact: DataFrame, seg: DataFrame, seg_col: str) -> DataFrame:
    """Purchases per customer segment and product category."""
    bought = _rows_per_customer(fact.where(F.col(CATEGORY).isNotNull()), F.col(CATEGORY))
    labelled = seg.where(F.col(seg_col).isNotNull()).select(CUSTOMER, seg_col)
    counts = bought.join(labelled, CUSTOMER).groupBy(seg_col, CATEGORY).agg(F.sum("rows").alias("purchase_count"))
    return counts.orderBy(seg_col, F.desc("purchase_count"), CATEGORY)


def revenue_by_segment(rfm: DataFrame, by: str = "BehaviorSegment") -> DataFrame:
    """Total spend per segment, largest first."""
    totals = rfm.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum(money("Monetary")).cast("double").alias("Monetary"))
    return totals.orderBy(F.desc("Monetary"), by)


def segment_orders_by_month(fact: DataFrame, rfm: DataFrame) -> DataFrame:
    """Fact rows per month and customer group; customers without a group drop out."""
    rows = _rows_per_customer(fact.where(purchased(fact).isNotNull()), month_key(purchased(fact)).alias("order_month"))
    joined = rows.join(rfm.select(CUSTOMER, "CustomerGroup"), CUSTOMER)
    return joined.groupBy("order_month", "CustomerGroup").agg(F.sum("rows").alias("order_count"))


def segment_customers_by_month(fact: DataFrame, rfm: DataFrame) -> DataFrame:
    """Distinct customers per month and customer group."""
    active = _rows_per_customer(fact.where(purchased(fact).isNotNull()), month_key(purchased(fact)).alias("order_month"))
    # one row per customer and month: counting rows counts customers
    joined = active.join(rfm.select(CUSTOMER, "CustomerGroup"), CUSTOMER)
    return joined.groupBy("order_month", "CustomerGroup").agg(F.count(F.lit(1)).alias("unique_customers"))
