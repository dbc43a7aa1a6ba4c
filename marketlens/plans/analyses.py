"""Analyses over one set of retail tables.

Each method reads only the columns and builds only the joins that its answer
needs. Questions about customers are answered from one customer state, which a
``Retail`` writes when it is first asked for; an answer that looks at the orders
themselves twice writes them once (``written_orders``) and hands them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, ORDER
from ..functions.staging import materialize
from ..operators import basket, churn, cltv, customer_state, geo, lifetime_model, reviews, rfm
from ..operators.cleaning import clean_tables
from ..operators.fact import ORDER_COLUMNS, order_fact, sales_fact
from ..sources.star import star_tables
from ..sources.tables import RetailTables


class Retail:
    """The retail tables, cleaned, and the analyses that start from them."""

    def __init__(self, tables: RetailTables):
        self.tables = clean_tables(tables)
        self._state: DataFrame | None = None

    @classmethod
    def from_star(cls, spark: SparkSession, folder: str) -> Retail:
        return cls(star_tables(spark, folder))

    def orders(self, *extra: str, complete_items: bool = False) -> DataFrame:
        """Collapsed fact: one row per order and payment, split by item columns."""
        return order_fact(self.tables, (*ORDER_COLUMNS, *extra), complete_items=complete_items)

    def written_orders(self, *extra: str) -> DataFrame:
        """``orders`` as a written table, for answers that read it more than once."""
        return materialize(self.orders(*extra), "orders")

    def items(self, *columns: str, empty_orders: bool = True) -> DataFrame:
        """Fact with one row per item and payment."""
        return sales_fact(self.tables, columns, empty_orders)

    def category_rows(self, empty_orders: bool = True) -> DataFrame:
        """Fact rows with their product category; without ``empty_orders`` only those of items, which takes one scan less.

        Not collapsed first: an order hardly repeats a category, so counting
        would cost a shuffle more than it saves; hot orders are split in the
        join.
        """
        return self.items(*ORDER_COLUMNS, CATEGORY, empty_orders=empty_orders)

    # customers

    def state(self) -> DataFrame:
        """The written customer state, made from the orders on the first call."""
        if self._state is None:
            self._state = materialize(customer_state.customer_state(self.orders()), "state")
        return self._state

    def churn_state(self, days: int = churn.CHURN_DAYS) -> DataFrame:
        """The state split at the churn cutoff."""
        return materialize(customer_state.split_state(self.state(), self.orders(), days), "churn_state")

    def rfm(self, rule: str = "all", precedence: str = "first", orders: DataFrame | None = None) -> DataFrame:
        """Scored customers with group and behaviour segment."""
        scored = rfm.rfm_scores(rfm.rfm_base(self.state() if orders is None else orders))
        return rfm.behavior_segment(rfm.customer_group(scored, rule), precedence)

    def rfm_summary(self) -> DataFrame:
        return rfm.segment_summary(self.rfm())

    def cltv(self, orders: DataFrame | None = None) -> DataFrame:
        """Customer values with both segmentations."""
        return cltv.segment_cltv(cltv.cltv_basic(self.state() if orders is None else orders))

    def rfm_cltv(self) -> DataFrame:
        return cltv.rfm_cltv(self.rfm(), self.cltv())

    def repeat_summary(self, cap: int | None = 365, positive: bool = True, orders: DataFrame | None = None) -> DataFrame:
        """Filtered model input: repeat customers."""
        return cltv.rft_filter(cltv.rft_summary(self.state() if orders is None else orders), cap=cap, positive=positive)

    def modelled_cltv(self, horizon: float = 365.0, cap: int | None = 365, orders: DataFrame | None = None) -> DataFrame:
        return lifetime_model.model_cltv(self.repeat_summary(cap, orders=orders), horizon)

    def churn(self) -> DataFrame:
        """Holdout data set with the encoded value segment."""
        data = materialize(churn.churn_dataset(churn.churn_features(self.churn_state()), self.cltv()), "churn")
        return churn.label_encode(data, cltv.SEGMENT, "cltv_segment_encoded")

    # baskets

    def baskets(self, segment: str | None = None) -> DataFrame:
        """Cleaned baskets of several items, of one value segment or of all."""
        found = basket.baskets(self.category_rows(empty_orders=False))
        if segment is not None:
            found = basket.segment_baskets(found, self.cltv(), segment)
        return basket.clean_items(basket.multi_item(found))

    def rules(self, segment: str | None = None, min_support: float = 0.001, min_lift: float = 1.0) -> tuple[DataFrame, DataFrame]:
        """Association rules with revenue, and the baskets they come from."""
        b = materialize(self.baskets(segment), "baskets")
        itemsets = materialize(basket.frequent_itemsets(b, min_support), "itemsets")
        found = materialize(basket.association_rules(itemsets, b.count(), min_lift), "rules")
        patterns = materialize(basket.basket_patterns(b), "patterns")
        return basket.rule_revenue(found, patterns), b

    # reviews and places

    def sold_categories(self) -> DataFrame:
        """Every product that an order holds, with its category."""
        t = self.tables
        sold = t.order_items.join(t.orders.select(ORDER), ORDER, "left_semi").select("product_id").distinct()
        return sold.join(t.products.select("product_id", CATEGORY), "product_id")

    def review_fact(self, *extra: str) -> DataFrame:
        return reviews.review_fact(self.items(*reviews.REVIEW_COLUMNS, *extra), self.tables.order_reviews)

    def geo_months(self) -> DataFrame:
        fact = self.orders("customer_zip_code_prefix", "customer_state", "customer_city")
        return geo.geo_month(geo.zip_month(fact), geo.zip_centroids(self.tables.geolocation))

    def table_sizes(self) -> DataFrame:
        """Rows of every table."""
        sizes = None
        for name, df in self.tables.named().items():
            one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            sizes = one if sizes is None else sizes.unionByName(one)
        return sizes


