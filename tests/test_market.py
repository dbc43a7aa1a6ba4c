"""Golden answers on the small marketplace, worked out by hand."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import by_key, rows_of
from marketlens.functions.columns import CATEGORY, CITY, CUSTOMER, ORDER, PAYMENT, PURCHASED, STATE, ZIP
from marketlens.operators import basket, churn, cltv, fact, filters, geo, profile, reviews, rfm, timeseries
from marketlens.sources.tables import SCHEMAS, export_csv, load_tables, read_table


def test_csv_tables_have_their_schemas(raw_market):
    assert set(raw_market.named()) == {
        "orders", "customers", "order_items", "order_payments", "order_reviews",
        "products", "category_translation", "geolocation", "sellers",
    }
    assert dict(raw_market.order_items.dtypes)["price"] == "double"
    assert raw_market.orders.count() == 7


def test_parquet_tables(spark, raw_market, tmp_path):
    for name, df in raw_market.named().items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    again = load_tables(spark, str(tmp_path), "parquet")
    assert rows_of(again.orders.select(ORDER)) == rows_of(raw_market.orders.select(ORDER))


def test_wrong_format(spark, market_folder):
    with pytest.raises(ValueError):
        load_tables(spark, str(market_folder), "xml")


def test_parquet_takes_the_stated_schema(spark, tmp_path):
    """A column too many, one too few, and one of another type."""
    path = str(tmp_path / "order_items.parquet")
    rows = [("o1", "p1", 3, "x"), ("o2", None, None, "y")]
    spark.createDataFrame(rows, "order_id string, product_id string, price int, stray string").write.parquet(path)
    got = read_table(spark, path, SCHEMAS["order_items"], "parquet")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in SCHEMAS["order_items"]]
    assert rows_of(got.select("order_id", "product_id", "price", "freight_value")) == [("o1", "p1", 3.0, None), ("o2", None, None, None)]
    assert "stray" not in got._jdf.queryExecution().executedPlan().toString()


def test_bad_timestamps_become_null(market):
    ts = by_key(market.tables.orders, ORDER)
    assert ts["o7"][PURCHASED] is None
    assert ts["o1"][PURCHASED] == datetime(2018, 1, 1, 23)
    assert ts["o3"]["order_delivered_customer_date"] is None


def test_reviews_need_a_score_and_an_id(market):
    got = by_key(market.tables.order_reviews, "review_id")
    assert {k: v["review_score"] for k, v in got.items()} == {"r1": 5, "r2": 1, "r3": 3, "r4": 2, "r5": 4}
    assert got["r4"]["review_creation_date"] is None


def test_products_are_translated_and_filled(market):
    got = by_key(market.tables.products, "product_id")
    assert {k: v["product_category"] for k, v in got.items()} == {"p1": "Bed ", "p2": "beauty", "p3": "home"}
    # means over the translated products only: p4 has no part in them
    assert got["p3"]["product_weight_g"] == 200
    assert got["p2"]["product_length_cm"] == 15
    assert got["p1"]["product_height_cm"] == 3
    assert "product_category_name" not in market.tables.products.columns


def test_items_need_a_price(market):
    assert market.tables.order_items.where("order_id = 'o5'").count() == 2


def test_fact_fans_out_items_and_payments(market):
    rows = market.items(CUSTOMER, PAYMENT, "product_id", CATEGORY, STATE)
    counts = dict(rows_of(rows.groupBy(ORDER).count()))
    assert counts == {"o1": 4, "o2": 1, "o3": 1, "o4": 1, "o5": 2, "o6": 2, "o7": 1}
    o1 = rows_of(rows.where("order_id = 'o1'").select("product_id", PAYMENT))
    assert o1 == [("p1", 8.5), ("p1", 25.0), ("p2", 8.5), ("p2", 25.0)]
    o3 = rows.where("order_id = 'o3'").first()
    assert o3["product_id"] is None and o3[PAYMENT] == 7.0
    assert rows.where("order_id = 'o4'").first()[PAYMENT] is None
    assert rows.where("order_id = 'o6' AND product_id = 'p4'").first()[CATEGORY] is None


def test_joins_that_are_not_needed_are_not_built(market):
    plan = market.items(PAYMENT)._jdf.queryExecution().optimizedPlan().toString()
    assert "customers.csv" not in plan and "products.csv" not in plan


@pytest.mark.parametrize("extra", [(), (CATEGORY,), ("seller_id", CATEGORY), (STATE, CITY, ZIP)])
def test_collapsed_fact_stands_for_the_same_rows(market, extra):
    cols = (CUSTOMER, PURCHASED, PAYMENT, *extra)
    whole = market.items(*cols).groupBy(ORDER, *cols).count()
    short = market.orders(*extra).groupBy(ORDER, *cols).agg(F.sum("fact_rows"))
    assert rows_of(whole) == rows_of(short)


@pytest.mark.parametrize(
    "answer",
    [
        rfm.rfm_base,
        lambda f: rfm.rfm_base(f, "orders"),
        cltv.cltv_basic,
        cltv.rft_summary,
        cltv.cohort_summary,
        churn.churn_features,
        churn.customer_features,
        basket.order_revenue,
        timeseries.monthly,
        timeseries.seasonality,
        lambda f: timeseries.category_monthly(f, "beauty"),
        lambda f: basket.basket_patterns(basket.baskets(f)),
        lambda f: geo.zip_month(f),
        lambda f: geo.state_month(f),
        lambda f: geo.value_per_customer(f),
    ],
)
def test_operators_agree_on_both_facts(market, answer):
    dims = (CATEGORY, STATE, CITY, ZIP)
    whole = market.items(CUSTOMER, PURCHASED, PAYMENT, *dims)
    assert rows_of(answer(whole)) == rows_of(answer(market.orders(*dims)))


def test_payments_counted_once_per_order(market):
    once = fact.build_sales_fact(market.tables, payment_grain="order")
    assert once.count() == 7
    assert once.where("order_id = 'o1'").first()[PAYMENT] == 33.5
    assert set(r["fact_rows"] for r in once.collect()) == {1}
    with pytest.raises(ValueError):
        fact.order_fact(market.tables, payment_grain="item")


def test_complete_items(market):
    rows = market.orders(STATE, CITY, complete_items=True)
    counts = {r[ORDER]: r["fact_rows"] for r in filters.complete_rows(rows, (STATE, CITY)).collect()}
    want = filters.complete_rows(market.items(STATE, CITY, CATEGORY)).groupBy(ORDER).count()
    # payments multiply the rows of the full fact; o1 has two of them
    assert counts == {"o1": 2, "o2": 1, "o4": 1, "o5": 2, "o7": 1}
    assert set(dict(rows_of(want))) == set(counts)


def test_window_includes_both_days(market):
    rows = filters.in_window(market.tables.orders, date(2018, 1, 2), date(2018, 3, 10))
    assert rows_of(rows.select(ORDER)) == [("o2",), ("o3",)]


def test_facets(market):
    rows = market.items(STATE, CITY, CATEGORY)
    assert filters.facet_filter(rows).count() == rows.count()
    assert filters.facet_filter(rows, states=["SP"], categories=["beauty"]).count() == 2
    assert [r[0] for r in filters.facet_values(rows, CATEGORY).collect()] == ["Bed ", "beauty", "home"]
    assert filters.slice_by(rows, STATE, "All").count() == rows.count()
    assert filters.slice_by(rows, STATE, "RJ").count() == 4
    assert filters.slice_by(rows, STATE, ["RJ", "SP"]).count() == 9


def test_profile(market):
    got = by_key(profile.profile(market.tables.customers), "column_name")
    assert got["customer_city"]["null_pct"] == pytest.approx(14.29)
    assert got["customer_id"]["null_pct"] == 0
    assert {v["row_count"] for v in got.values()} == {7} and {v["column_count"] for v in got.values()} == {5}
    assert got["customer_zip_code_prefix"]["data_type"] == "int"
    empty = profile.profile(market.tables.customers.where("false"))
    assert {r["null_pct"] for r in empty.collect()} == {None}


def test_preview_and_dedupe(market):
    t = market.tables
    assert [r[0] for r in profile.preview(t.orders, 2, [F.desc(ORDER)]).select(ORDER).collect()] == ["o7", "o6"]
    joined = t.orders.select(ORDER, "customer_id").join(t.customers, t.orders["customer_id"] == t.customers["customer_id"])
    once = filters.dedupe_columns(joined)
    assert once.columns == [ORDER, "customer_id", CUSTOMER, ZIP, CITY, STATE]
    assert once.count() == 7


def test_csv_export(spark, market, tmp_path):
    path = str(tmp_path / "out")
    export_csv(market.tables.sellers, path)
    back = spark.read.option("header", True).csv(path)
    assert rows_of(back.select("seller_id")) == [("s1",), ("s2",)]


def test_rfm_base(market):
    got = by_key(rfm.rfm_base(market.orders()), CUSTOMER)
    # the latest purchase is 2018-09-30 09:00; u4's own counts one day
    assert got["u4"] == {CUSTOMER: "u4", "Recency": 1, "Frequency": 2, "Monetary": 136.0}
    assert got["u1"]["Frequency"] == 5 and got["u1"]["Monetary"] == 33.5 * 2 + 15
    assert got["u2"]["Recency"] == 1 and got["u2"]["Monetary"] == 7 + 40
    assert got["u3"] == {CUSTOMER: "u3", "Recency": 203, "Frequency": 1, "Monetary": 0.0}
    assert got["u5"]["Recency"] is None
    by_orders = by_key(rfm.rfm_base(market.orders(), "orders"), CUSTOMER)
    assert {k: v["Frequency"] for k, v in by_orders.items()} == {"u1": 2, "u2": 2, "u3": 1, "u4": 1, "u5": 1}
    with pytest.raises(ValueError):
        rfm.rfm_base(market.orders(), "visits")


def test_cltv_basic_and_summary(market):
    got = by_key(cltv.cltv_basic(market.orders()), CUSTOMER)
    assert got["u1"]["total_orders"] == 2 and got["u1"]["avg_order_value"] == pytest.approx(82 / 5)
    assert got["u1"]["purchase_frequency"] == pytest.approx(2 / 5)
    assert got["u3"]["avg_order_value"] is None and got["u3"]["cltv"] is None
    rft = by_key(cltv.rft_summary(market.orders()), CUSTOMER)
    # 23:00 to 01:00 is no whole day
    assert (rft["u1"]["frequency"], rft["u1"]["recency"], rft["u1"]["T"]) == (1, 0, 271)
    assert (rft["u2"]["frequency"], rft["u2"]["recency"]) == (1, 203)


def test_cohorts_and_months(market):
    cohorts = by_key(cltv.cohort_summary(market.orders()), "first_purchase_quarter")
    assert {k: (v["customer_count"], v["total_revenue"]) for k, v in cohorts.items()} == {
        "2018Q1": (3, 82 + 47.0),
        "2018Q3": (1, 136.0),
    }
    months = by_key(timeseries.monthly(market.orders()), "order_month")
    assert {k: (v["total_revenue"], v["order_count"]) for k, v in months.items()} == {
        "2018-01": (82.0, 2),
        "2018-03": (7.0, 2),
        "2018-09": (176.0, 2),
    }
    season = by_key(timeseries.seasonality(market.orders()), "month")
    assert season["Sep"]["month_number"] == 9 and season["Sep"]["total_revenue"] == 176.0


def test_churn(market):
    # the cutoff is 2018-04-03 09:00
    got = by_key(churn.churn_features(market.orders()), CUSTOMER)
    assert set(got) == {"u1", "u2", "u3"}
    assert {k: v["churned"] for k, v in got.items()} == {"u1": 1, "u2": 0, "u3": 1}
    assert got["u2"]["total_orders"] == 1 and got["u2"]["recency_days"] == 23
    assert got["u1"]["avg_order_value"] == pytest.approx(82 / 5)
    inactive = by_key(churn.churn_label(market.orders(), "inactive"), CUSTOMER)
    assert {k: v["churned"] for k, v in inactive.items() if k != "u5"} == {"u1": 1, "u2": 0, "u3": 1, "u4": 0}
    full = by_key(churn.customer_features(market.orders()), CUSTOMER)
    # the last day's buyers come after its midnight
    assert full["u4"]["recency_days"] == -1 and full["u2"]["recency_days"] == -1
    assert full["u2"]["order_frequency"] == pytest.approx(203 / 3)
    with pytest.raises(ValueError):
        churn.churn_label(market.orders(), "gone")


def test_baskets(market):
    b = by_key(basket.baskets(market.category_rows()), ORDER)
    assert {k: v["items"] for k, v in b.items()} == {
        "o1": ["Bed ", "beauty"], "o2": ["Bed "], "o3": [], "o4": ["beauty"], "o5": ["Bed "], "o6": ["beauty"], "o7": ["home"],
    }
    # a missing category next to a known one does not make two items
    several = basket.clean_items(basket.multi_item(basket.baskets(market.category_rows())))
    assert [(r[ORDER], r["items"]) for r in several.collect()] == [("o1", ["beauty", "bed"])]


def test_review_fact(market):
    rf = market.review_fact(CATEGORY)
    got = rows_of(rf.select(ORDER, "seller_id", "review_id", "delivery_days", "low_score", "delayed"))
    assert got == [
        ("o1", "s1", "r1", 3, False, False), ("o1", "s1", "r1", 3, False, False),
        ("o1", "s2", "r1", 3, False, False), ("o1", "s2", "r1", 3, False, False),
        ("o2", "s1", "r2", 17, True, True),
        ("o4", "s2", "r3", -1, False, False),
        ("o5", "s1", "r4", 2, True, True), ("o5", "s1", "r4", 2, True, True),
        ("o5", "s1", "r5", 2, False, True), ("o5", "s1", "r5", 2, False, True),
    ]
    late = by_key(reviews.delay_impact(rf), "delayed")
    assert late["Late"]["count"] == 5 and late["Late"]["avg_rating"] == pytest.approx(13 / 5)
    stats = by_key(reviews.rating_stats(rf, "seller_id"), "seller_id")
    assert stats["s1"]["num_reviews"] == 7 and stats["s1"]["pct_low_scores"] == pytest.approx(300 / 7)
    assert stats["s2"]["rating_std"] == pytest.approx((4 / 3) ** 0.5)
    freight = by_key(reviews.freight_vs_rating(rf, more_than=1), "seller_id", CATEGORY)
    assert freight[("s2", "beauty")]["avg_freight_ratio"] == pytest.approx((0.125 * 2 + 0.1) / 3)


def test_geography(market):
    cents = by_key(geo.zip_centroids(market.tables.geolocation), "geolocation_zip_code_prefix")
    assert (cents[1001]["lat"], cents[1001]["lon"], cents[1001]["geo_city"]) == (-23.5, -46.5, "sao paulo")
    months = market.geo_months()
    assert {r[ZIP] for r in months.collect()} == {1001, 2002}
    totals = by_key(geo.geo_bubbles(months, "2018-01", "2018-03"), "city")
    assert totals["sao paulo"]["total_revenue"] == 82.0 and totals["rio"]["total_revenue"] == 7.0
    assert set(by_key(geo.geo_bubbles(months, exclude=["rio"]), "city")) == {"sao paulo"}
    scaled = geo.scaled_metric(geo.geo_bubbles(months, metric="total_orders"), "total_orders").where("city = 'rio'").first()
    assert scaled["scaled_metric"] == pytest.approx(4 / 18735 * 40000 + 1000)
    with pytest.raises(ValueError):
        geo.top_cities(months, "profit")
    wide = by_key(geo.state_month_pivot(geo.state_month(market.orders(STATE)), ["SP", "RJ"]), "year_month")
    assert wide["2018-03"] == {"year_month": "2018-03", "SP": 0.0, "RJ": 7.0}
    each = geo.value_per_customer(market.orders(STATE), STATE, 2).collect()
    assert [(r[STATE], r["avg_cltv_per_customer"]) for r in each] == [("MG", 84.5), ("SP", 82.0)]


def test_drop_looks_at_the_previous_month_with_sales(market, make):
    worth = make([("u2", 10.0), ("u3", 1.0)], f"{CUSTOMER} string, predicted_cltv double")
    got = by_key(geo.drop_detection(market.orders(STATE), worth), "year_month")
    assert set(got) == {"2018-03", "2018-09"}
    assert got["2018-09"]["prev_revenue"] == 7.0 and got["2018-09"]["cltv"] == 20.0
    assert got["2018-03"]["pct_change"] is None and got["2018-03"]["drop_flag"] is False


def test_sentiment(market):
    got = by_key(reviews.sentiment(market.tables.order_reviews), "review_id")
    assert {k: v["review_sentiment"] for k, v in got.items()} == {
        "r1": "Positive", "r2": "Negative", "r3": "Neutral", "r4": "Negative", "r5": "Positive",
    }


def test_empty_market(spark, raw_market):
    from dataclasses import replace

    from marketlens.plans.analyses import Retail

    none = Retail(replace(raw_market, orders=raw_market.orders.where("false")))
    assert none.rfm_summary().count() == 0
    assert none.cltv().count() == 0
