"""Cleaning of the raw tables before the sales fact is built."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import RetailTables

PRODUCT_SIZES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
_TIMESTAMPS = ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")


def coerce_ts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to timestamps; what does not parse becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in cols})


def clean_reviews(df: DataFrame) -> DataFrame:
    """Integer scores; reviews without a score or an id are dropped."""
    score = F.col("review_score").try_cast("double").try_cast("int")
    return df.withColumn("review_score", score).dropna(subset=["review_score", "review_id"])


def translate_category(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace the category by its English name; unmapped products are dropped."""
    return (
        products.join(dictionary, "product_category_name", "left")
        .drop("product_category_name")
        .withColumnRenamed("product_category_name_english", "product_category")
        .dropna(subset=["product_category"])
    )


def impute_mean(df: DataFrame, cols: Sequence[str] = PRODUCT_SIZES) -> DataFrame:
    """Fill missing numbers with the column mean."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means.getField(c)) for c in cols})


def valid_items(df: DataFrame) -> DataFrame:
    """Items with a positive price and a freight that is not negative."""
    return df.where((F.col("price") > 0) & (F.col("freight_value") >= 0))


def clean_tables(t: RetailTables) -> RetailTables:
    """Every cleaning step a raw set of tables needs; done steps are skipped."""
    text = {"string"}
    orders = coerce_ts(t.orders, [c for c, kind in t.orders.dtypes if c in _TIMESTAMPS and kind in text])
    items = valid_items(t.order_items) if t.order_items is not None else None
    reviews = t.order_reviews
    if reviews is not None:
        reviews = coerce_ts(clean_reviews(reviews), ["review_creation_date"])
    products = t.products
    if products is not None and "product_category" not in products.columns:
        products = impute_mean(translate_category(products, t.category_translation))
    return replace(t, orders=orders, order_items=items, order_reviews=reviews, products=products)
