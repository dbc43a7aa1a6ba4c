"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from marketlens.functions.columns import CATEGORY, CITY, CUSTOMER, PAYMENT, PURCHASED, STATE
from marketlens.operators import customer_state, filters, rfm
from marketlens.plans.analyses import Retail
from marketlens.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str) -> dict[str, str]:
    return dict(re.findall(r"/(\w+)\.parquet\].*?ReadSchema: (struct<[^>]*>)", plan))


def test_scans_read_only_what_is_needed(star):
    plan = plan_of(rfm.rfm_base(star.orders()))
    read = scans(plan)
    assert set(read) == {"orders", "lineitem"}
    assert set(re.findall(r"(\w+):", read["lineitem"])) == {"l_orderkey", "l_extendedprice", "l_tax"}
    assert set(re.findall(r"(\w+):", read["orders"])) == {"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}


def test_date_window_reaches_the_scan(star):
    from datetime import date

    window = filters.in_window(star.orders(), date(1996, 1, 1), date(1996, 12, 31))
    pushed = re.search(r"orders\.parquet\].*?PushedFilters: \[(.*?)\]", plan_of(window)).group(1)
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in pushed and "LessThan(o_orderdate,1997-01-01T00:00)" in pushed


def test_price_filter_reaches_the_scan(star):
    pushed = re.search(r"lineitem\.parquet\].*?PushedFilters: \[(.*?)\]", plan_of(star.items("price"))).group(1)
    assert "GreaterThan(l_extendedprice,0.0)" in pushed


def test_items_are_counted_before_the_shuffle(star):
    plan = plan_of(star.orders())
    # partial count below the exchange by order
    assert re.search(r"HashAggregate\(keys=\[order_id#\d+L\], functions=\[partial_count", plan)
    assert plan.count("Exchange hashpartitioning(order_id") <= 2


def test_orders_without_items_come_from_a_stage_of_their_own(star, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(star.items(CUSTOMER, PURCHASED, PAYMENT))
        # the stage of the union would share its tasks out by bytes, and keys are many in few bytes
        kept = plan[plan.index("LeftAnti") - 400 : plan.index("LeftAnti")].splitlines()
        assert any("REBALANCE_PARTITIONS_BY_COL" in line and "hashpartitioning(order_id" in line for line in kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2MB")


def test_baskets_reuse_the_placement_by_order(star, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from marketlens.operators import basket

        plan = plan_of(basket.baskets(star.category_rows(empty_orders=False)))
        # one for the products, one each for items and orders, none for the sets
        assert plan.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2MB")


def test_dimension_joins_are_optional(star):
    assert set(scans(plan_of(star.items(PAYMENT)))) == {"orders", "lineitem"}
    assert "part" in scans(plan_of(star.items(CATEGORY)))
    assert {"customer", "nation"} <= set(scans(plan_of(star.items(STATE, CITY))))
    assert "customer" not in scans(plan_of(star.items(CUSTOMER, PURCHASED)))


def test_reviews_join_products_only_for_the_category(star):
    assert "part" not in scans(plan_of(star.review_fact()))
    assert "part" in scans(plan_of(star.review_fact(CATEGORY)))


def test_facet_values_need_no_order_columns(star):
    read = scans(plan_of(filters.facet_values(star.sold_categories(), CATEGORY)))
    assert set(re.findall(r"(\w+):", read["orders"])) == {"o_orderkey"}


def test_customer_questions_build_the_orders_once(spark, monkeypatch):
    built, orders = [], Retail.orders
    monkeypatch.setattr(Retail, "orders", lambda self, *a, **k: built.append(a) or orders(self, *a, **k))
    shop = Retail.from_star(spark, SMALL)
    shop.rfm_cltv()
    shop.repeat_summary()
    assert len(built) == 1
    shop.churn()
    assert len(built) == 2  # the month of the cutoff


@pytest.mark.parametrize("name, times", [("b12_category_by_segment", 1), ("c13_top_categories_per_segment", 1), ("c16_repeat_rate", 0), ("f03_multi_item", 1), ("b14_segment_orders_by_month", 0)])
def test_answers_by_segment_scan_the_items_once(spark, name, times):
    plan = plan_of(QUERIES[name](spark, SMALL))
    plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.count("/lineitem.parquet") == times


def test_the_cutoff_month_alone_is_read_again(spark):
    shop = Retail.from_star(spark, SMALL)
    split = customer_state.split_state(shop.state(), shop.orders(), 180)
    pushed = re.search(r"orders\.parquet\].*?PushedFilters: \[(.*?)\]", plan_of(split)).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
