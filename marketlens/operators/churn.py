"""Churn labels and the customer features used to predict them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    CUSTOMER,
    LAST,
    ORDER,
    PURCHASED,
    count_values,
    earliest,
    elapsed_days,
    is_state,
    latest,
    money_mean,
    money_sum,
    purchased,
    row_weight,
    scalar,
    share_hash,
)
from .cltv import SEGMENT

CHURN_DAYS = 180

#: Model inputs of the holdout data set.
FEATURES = (
    "total_orders",
    "total_revenue",
    "recency_days",
    "customer_age_days",
    "avg_order_value",
    "days_since_last_purchase",
    "cltv_segment_encoded",
)


def last_purchase(fact: DataFrame) -> DataFrame:
    known = fact.where(F.col(CUSTOMER).isNotNull())
    return known.groupBy(CUSTOMER).agg(latest(fact).alias("last_purchase"))


def churn_features(fact: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """Features before the cutoff and the holdout label, in one aggregation.

    The cutoff lies ``days`` before the latest purchase. A customer with
    purchases up to it and none after has churned; since both sides are
    conditional aggregates of the same rows, no second table is joined. A
    customer state must have been split at the cutoff (``split_state``).
    """
    cutoff = scalar(fact, latest(fact)) - F.expr(f"INTERVAL {int(days)} DAYS")
    known = fact.where(F.col(CUSTOMER).isNotNull()).withColumn("_cutoff", cutoff)
    # no row of a split state lies on both sides
    before = (F.col(LAST) if is_state(fact) else F.col(PURCHASED)) <= F.col("_cutoff")
    after = purchased(fact) > F.col("_cutoff")
    has_order = before if is_state(fact) else before & F.col(ORDER).isNotNull()
    per_customer = known.groupBy(CUSTOMER).agg(
        F.sum(F.when(has_order, row_weight(fact))).alias("total_orders"),
        money_sum(fact, where=before).alias("total_revenue"),
        latest(fact, before).alias("last_order"),
        earliest(fact, before).alias("first_order"),
        F.max("_cutoff").alias("_cutoff"),
        F.max(F.coalesce(after, F.lit(False))).alias("_returned"),
    )
    return per_customer.where(F.col("last_order").isNotNull()).select(
        CUSTOMER,
        "total_orders",
        "total_revenue",
        "last_order",
        "first_order",
        elapsed_days("last_order", "_cutoff").alias("recency_days"),
        elapsed_days("first_order", "_cutoff").alias("customer_age_days"),
        (F.col("total_revenue") / F.col("total_orders")).alias("avg_order_value"),
        elapsed_days("last_order", "_cutoff").alias("days_since_last_purchase"),
        F.when(F.col("_returned"), 0).otherwise(1).alias("churned"),
    )


def churn_label(fact: DataFrame, rule: str = "holdout", days: int = CHURN_DAYS) -> DataFrame:
    """Customer and ``churned``.

    ``holdout``: bought up to the cutoff and not after. ``inactive``: the last
    purchase is more than ``days`` before the end of the data.
    """
    if rule == "holdout":
        return churn_features(fact, days).select(CUSTOMER, "churned")
    if rule == "inactive":
        end = scalar(fact, latest(fact))
        idle = elapsed_days(F.col("last_purchase"), end) > days
        return last_purchase(fact).select(CUSTOMER, "last_purchase", idle.cast("int").alias("churned"))
    raise ValueError(f"unknown rule: {rule}")


def customer_features(fact: DataFrame) -> DataFrame:
    """Full-history features; recency counts to the last midnight of the data."""
    midnight = F.date_trunc("day", scalar(fact, latest(fact)))
    per_customer = (
        fact.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            count_values(fact, ORDER).alias("num_orders"),
            money_mean(fact).alias("avg_order_value"),
            money_sum(fact).alias("total_revenue"),
            earliest(fact).alias("first_purchase"),
            latest(fact).alias("last_purchase"),
        )
    )
    out = per_customer.withColumns(
        {
            "recency_days": elapsed_days(F.col("last_purchase"), midnight),
            "purchase_span_days": elapsed_days("first_purchase", "last_purchase"),
        }
    )
    return out.withColumn("order_frequency", F.try_divide("purchase_span_days", "num_orders"))


def churn_dataset(features: DataFrame, cltv: DataFrame) -> DataFrame:
    """Customers with more than one order, with their value segment."""
    repeat = cltv.where(F.col("total_orders") > 1).dropna()
    return features.join(repeat.select(CUSTOMER, SEGMENT), CUSTOMER)


def churn_cltv_dataset(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """Labels with the model-scored customers."""
    return labels.select(CUSTOMER, "last_purchase", "churned").join(scored, CUSTOMER)


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Codes 0.. in alphabetical order of the labels.

    For label columns: the distinct labels pass through the driver, the rows
    do not.
    """
    indexer = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    coded = indexer.fit(df.where(F.col(col).isNotNull())).transform(df)
    return coded.withColumn(out, F.when(F.col(col).isNotNull(), F.col(out).cast("int")))


def churn_rate_by(df: DataFrame, by: str = SEGMENT) -> DataFrame:
    known = df.where(F.col(by).isNotNull())
    return known.groupBy(by).agg(F.count(F.lit(1)).alias("customers"), F.avg("churned").alias("churn_rate"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, over the rows that have both.

    A column that never varies has no correlation: NULL. ``df`` is read twice:
    the means of the first pass keep the products of the second small and, with
    no gaps in the columns, make them all it needs.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    facts = (("n", F.count), ("lo", F.min), ("hi", F.max), ("mean", F.avg))
    ends = df.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{name}_{c}") for c in cols for name, f in facts]).first()
    varies = [c for c in cols if ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    whole = [c for c in varies if ends[f"n_{c}"] == ends["rows"]]
    off = {c: F.col(c) - F.lit(ends[f"mean_{c}"]) for c in varies}
    pairs = [(a, b) for i, a in enumerate(varies) for b in varies[i:]]

    def gapped(a: str, b: str) -> Column:
        both_a, both_b = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(both_a) * F.stddev_pop(both_b))

    sums = [F.sum(off[a] * off[b]) if {a, b} <= set(whole) else gapped(a, b) for a, b in pairs]
    wide = df.agg(F.count(F.lit(1)), *[v.alias(f"{a}|{b}") for v, (a, b) in zip(sums, pairs)])

    def found(a: str, b: str) -> Column:
        if not {a, b} <= set(varies):
            return F.lit(None).cast("double")
        if a == b:
            return F.lit(1.0)
        value = F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`")
        if {a, b} <= set(whole):
            return value / F.sqrt(F.col(f"`{a}|{a}`") * F.col(f"`{b}|{b}`"))
        return value

    rows = [F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("col_name"), found(a, b).alias("corr")) for a, b in product(cols, cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def split(df: DataFrame, key: str = CUSTOMER, frac: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same in any partitioning."""
    bucket = share_hash(key, seed, 10_000)
    edge = round(frac * 10_000)
    return df.where(bucket < edge), df.where(bucket >= edge)


def class_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """Balanced weight per class, and the ratio of negatives to positives."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = df.agg(
        F.struct(
            F.count(label).alias("all"),
            F.count_if(F.col(label) == 0).alias("neg"),
            F.count_if(F.col(label) == 1).alias("pos"),
        ).alias("t")
    ).scalar()
    return counts.select(
        label,
        "n",
        (totals.getField("all") / (2 * F.col("n"))).alias("balanced_weight"),
        F.when(F.col(label) == 1, F.try_divide(totals.getField("neg"), totals.getField("pos")))
        .otherwise(F.lit(1.0))
        .alias("pos_weight"),
    )
