"""The retail tables read from a star schema of orders, lines and dimensions.

A line is an item, an order carries its one payment and its review score, and
suppliers stand in for the zip-code gazetteer. Columns that the order row
already holds (customer id, payment) are left there, so the fact needs no join
to fetch them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import RetailTables


# Stated, so that no job has to open files just to learn the columns.
STAR_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def star_tables(spark: SparkSession, folder: str) -> RetailTables:
    src = {name: read_star(spark, folder, name) for name in STAR_SCHEMAS}

    orders = src["orders"].select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_custkey").alias("customer_unique_id"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("order_estimated_delivery_date"),
        F.col("o_totalprice").alias("payment_value"),
    )
    customers = (
        src["customer"]
        .join(src["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )
    # price x tax in whole cents, rounded half up: exact without decimals
    price, tax = (F.rint(F.col(c) * 100).cast("bigint") for c in ("l_extendedprice", "l_tax"))
    freight = F.floor((price * tax + 50) / 100) / 100.0
    order_items = src["lineitem"].select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        freight.alias("freight_value"),
        F.col("l_shipdate").alias("order_delivered_customer_date"),
    )
    order_reviews = src["orders"].select(
        F.col("o_orderkey").cast("string").alias("review_id"),
        F.col("o_orderkey").alias("order_id"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("review_score"),
        F.col("o_orderdate").alias("review_creation_date"),
    )
    products = src["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_category"),
    )
    number = F.col("s_suppkey")
    geolocation = src["supplier"].select(
        F.col("s_nationkey").alias("geolocation_zip_code_prefix"),
        (number % 60 - 30).cast("double").alias("geolocation_lat"),
        ((number * 7) % 60 - 70).cast("double").alias("geolocation_lng"),
        F.col("s_name").alias("geolocation_city"),
        F.col("s_nationkey").cast("string").alias("geolocation_state"),
    )
    sellers = src["supplier"].select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("s_nationkey").cast("string").alias("seller_state"),
    )
    return RetailTables(
        orders=orders,
        customers=customers,
        order_items=order_items,
        order_reviews=order_reviews,
        products=products,
        geolocation=geolocation,
        sellers=sellers,
    )


def with_payments(t: RetailTables) -> RetailTables:
    """The same tables with one to three payments per order in a table of their own.

    An order has ``order_id % 3 + 1`` payments of equal whole cents; the first
    takes what is left over. Product categories get a dictionary as well.
    """
    number = F.col("order_id") % 3 + 1
    split = t.orders.select(
        "order_id", number.alias("n"), F.rint(F.col("payment_value") * 100).cast("bigint").alias("cents")
    ).withColumn("payment_sequential", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    rest = F.when(F.col("payment_sequential") == 1, F.col("cents") % F.col("n")).otherwise(0)
    amount = (F.floor(F.col("cents") / F.col("n")) + rest) / 100.0
    names = t.products.select(F.col("product_category").alias("product_category_name")).distinct()
    return replace(
        t,
        orders=t.orders.drop("payment_value"),
        order_payments=split.select("order_id", "payment_sequential", amount.alias("payment_value")),
        category_translation=names.withColumn("product_category_name_english", F.upper("product_category_name")),
    )
