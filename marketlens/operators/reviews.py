"""Review scores against sellers, categories, delivery and freight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, ORDER, PURCHASED, elapsed_days
from ..functions.skew import skew_join

DELIVERED = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"

#: Fact columns of every review fact; the category costs a join more and is asked for by name.
REVIEW_COLUMNS = (PURCHASED, DELIVERED, ESTIMATED, "seller_id", "price", "freight_value")


def sentiment(reviews: DataFrame) -> DataFrame:
    score = F.col("review_score")
    label = F.when(score >= 4, "Positive").when(score == 3, "Neutral").otherwise("Negative")
    return reviews.withColumn("review_sentiment", label)


def review_fact(fact: DataFrame, reviews: DataFrame, max_days: int = 100) -> DataFrame:
    """Sold items with their reviews, delivered in less than ``max_days``.

    Undelivered items drop out; a delivery before the purchase stays.
    """
    sold = fact.where(F.col("seller_id").isNotNull())
    rf = sold.withColumn("delivery_days", elapsed_days(PURCHASED, DELIVERED)).where(F.col("delivery_days") < max_days)
    rf = skew_join(rf, reviews.select(ORDER, "review_id", "review_score"), ORDER)
    return rf.withColumns(
        {
            "low_score": F.col("review_score") < 3,
            "delayed": F.coalesce(F.col(DELIVERED) > F.col(ESTIMATED), F.lit(False)),
            "freight_ratio": F.try_divide("freight_value", "price"),
        }
    )


def _mean_score() -> Column:
    return F.sum("review_score") / F.count("review_score")


def _score_deviation() -> Column:
    """Sample standard deviation from whole-number sums: exact in any order."""
    n, s = F.count("review_score"), F.sum(F.col("review_score").cast("bigint"))
    squares = F.sum((F.col("review_score") * F.col("review_score")).cast("bigint"))
    spread = (n.cast("decimal(19,0)") * squares - s.cast("decimal(19,0)") * s).cast("double")
    return F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1))))


def rating_stats(rf: DataFrame, key: str) -> DataFrame:
    """Number, mean and deviation of scores and the share of low ones per key."""
    low = F.try_divide(F.count_if(F.col("low_score")), F.count("low_score")) * 100
    return (
        rf.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("review_score").alias("num_reviews"),
            _mean_score().alias("avg_rating"),
            _score_deviation().alias("rating_std"),
            low.alias("pct_low_scores"),
        )
    )


def top_rated(stats: DataFrame, key: str, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("avg_rating"), F.desc("num_reviews"), key).limit(n)


def worst_rated(stats: DataFrame, key: str, n: int = 10, min_reviews: int = 10) -> DataFrame:
    return stats.where(F.col("num_reviews") >= min_reviews).orderBy("avg_rating", key).limit(n)


def delivery_by_score(rf: DataFrame) -> DataFrame:
    days = F.sum(F.col("delivery_days").cast("bigint")) / F.count("delivery_days")
    known = rf.where(F.col("review_score").isNotNull())
    return known.groupBy("review_score").agg(days.alias("avg_delivery_days"), F.count(ORDER).alias("num_orders"))


def slow_sellers(rf: DataFrame, min_orders: int = 10, max_rating: float = 2.0, n: int = 10) -> DataFrame:
    """Poorly rated sellers that take longest to deliver."""
    days = F.sum(F.col("delivery_days").cast("bigint")) / F.count("delivery_days")
    per_seller = rf.groupBy("seller_id").agg(
        F.count(ORDER).alias("num_orders"), _mean_score().alias("avg_rating"), days.alias("avg_delivery_days")
    )
    kept = per_seller.where((F.col("num_orders") >= min_orders) & (F.col("avg_rating") <= max_rating))
    return kept.orderBy(F.desc("avg_delivery_days"), "seller_id").limit(n)


def delay_impact(rf: DataFrame) -> DataFrame:
    """Mean score and count of late and on-time deliveries."""
    label = F.when(F.col("delayed"), "Late").otherwise("On-Time")
    return rf.groupBy(label.alias("delayed")).agg(_mean_score().alias("avg_rating"), F.count("review_score").alias("count"))


def freight_vs_rating(rf: DataFrame, more_than: int = 10) -> DataFrame:
    """Mean freight share and score per seller and category with enough rows."""
    known = rf.where(F.col("seller_id").isNotNull() & F.col(CATEGORY).isNotNull())
    grouped = known.groupBy("seller_id", CATEGORY).agg(
        F.count(ORDER).alias("num_reviews"),
        _mean_score().alias("avg_rating"),
        F.avg("freight_ratio").alias("avg_freight_ratio"),
    )
    return grouped.where(F.col("num_reviews") > more_than)
