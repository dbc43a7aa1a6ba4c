"""The registered queries: one or more per operator of the inventory.

Every query reads the whole given tables. Names start with the operator's id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, CITY, CUSTOMER, ORDER, PAYMENT, PURCHASED, STATE, ZIP, from_cents
from ..functions.ordering import down, global_row_number, running_sum
from ..functions.staging import materialize, scratch_path
from ..operators import (
    basket,
    certificates,
    churn,
    churn_models,
    cleaning,
    cltv,
    clusters,
    fact,
    filters,
    geo,
    lifetime_model,
    metrics,
    profile,
    reviews,
    rfm,
    timeseries,
)
from ..sources.star import read_star, star_tables, with_payments
from ..sources.tables import export_csv, export_tables, load_tables
from .analyses import Retail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Parameters of the registered queries.
SEGMENT_OF_BASKETS = "Medium CLTV"
STATES = ["NATION_3", "NATION_7", "NATION_12"]
GAMMA = {"p": 6.0, "q": 4.0, "v": 15000.0}
#: With q below 1 the population's mean is negative, and so are some customers' values.
ODD_GAMMA = {"p": 0.048, "q": 0.5, "v": 15000.0}
TRAINERS = {
    "Random Forest": churn_models.train_rf,
    "Logistic Regression": churn_models.train_lr,
    "Gradient Boosting": churn_models.train_gbt,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(*cols: str):
    return {c: F.round(F.col(c), 6) for c in cols}


# A: scans, cleaning, fact assembly, sinks


@query
def a01_load_tables(spark, d):
    return Retail.from_star(spark, d).table_sizes()


@query
def a01_load_csv_tables(spark, d):
    """All nine tables, written as CSV and read back."""
    tables = with_payments(star_tables(spark, d))
    products = tables.products.withColumnRenamed("product_category", "product_category_name")
    folder = scratch_path(spark, "csv_tables")
    export_tables(replace(tables, products=products), folder)
    return Retail(load_tables(spark, folder)).table_sizes()


@query
def a02_coerce_ts(spark, d):
    raw = read_star(spark, d, "orders").select(
        F.col("o_orderkey").alias(ORDER),
        F.col("o_orderdate").cast("string").alias("purchased"),
        F.col("o_orderpriority").alias("not_a_date"),
    )
    out = cleaning.coerce_ts(raw, ["purchased", "not_a_date"])
    return out.select(ORDER, F.date_format("purchased", "yyyy-MM-dd").alias("purchased"), F.col("not_a_date").isNull().alias("unparsed"))


@query
def a03_clean_reviews(spark, d):
    priority = F.col("o_orderpriority")
    raw = read_star(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("review_id"),
        F.when(~priority.endswith("NOT SPECIFIED"), F.substring(priority, 1, 1)).alias("review_score"),
    )
    return cleaning.clean_reviews(raw)


def _products(spark, d):
    part = read_star(spark, d, "part")
    size = F.col("p_size")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_category_name"),
        F.nullif(size, F.lit(1)).cast("double").alias("product_weight_g"),
        F.nullif(size, F.lit(2)).cast("double").alias("product_length_cm"),
        F.nullif(size, F.lit(3)).cast("double").alias("product_height_cm"),
        F.col("p_retailprice").alias("product_width_cm"),
    )
    names = part.select(F.col("p_name").alias("product_category_name")).distinct()
    dictionary = names.where(~F.col("product_category_name").endswith("ring")).withColumn(
        "product_category_name_english", F.upper("product_category_name")
    )
    return cleaning.translate_category(products, dictionary)


@query
def a04_translate_category(spark, d):
    return _products(spark, d).select("product_id", "product_category")


@query
def a05_impute_mean(spark, d):
    out = cleaning.impute_mean(_products(spark, d))
    return out.select("product_id", *[F.round(c, 6).alias(c) for c in cleaning.PRODUCT_SIZES])


@query
def a06_valid_items(spark, d):
    return Retail.from_star(spark, d).tables.order_items.select(ORDER, "product_id", "seller_id", "price", "freight_value")


@query
def a07_sales_fact(spark, d):
    return fact.build_sales_fact(Retail.from_star(spark, d).tables)


@query
def a07_sales_fact_per_order(spark, d):
    return fact.build_sales_fact(Retail.from_star(spark, d).tables, payment_grain="order")


def _paid(spark, d) -> Retail:
    """The shop with payments in a table of their own, one to three per order."""
    return Retail(with_payments(star_tables(spark, d)))


@query
def a07_sales_fact_payments(spark, d):
    return fact.build_sales_fact(_paid(spark, d).tables)


@query
def a07_sales_fact_payments_per_order(spark, d):
    return fact.build_sales_fact(_paid(spark, d).tables, payment_grain="order")


@query
def a08_complete_rows(spark, d):
    rows = filters.complete_rows(Retail.from_star(spark, d).items(STATE, CITY, CATEGORY))
    return rows.groupBy(STATE, CITY, CATEGORY).agg(F.count(F.lit(1)).alias("row_count"))


@query
def a09_in_window(spark, d):
    rows = filters.in_window(Retail.from_star(spark, d).items(CUSTOMER, PURCHASED, PAYMENT), date(1996, 3, 1), date(1997, 2, 28))
    return rows.select(ORDER, CUSTOMER, PURCHASED, PAYMENT)


@query
def a10_facet_filter(spark, d):
    rows = Retail.from_star(spark, d).items(STATE, CITY, CATEGORY, "price")
    return filters.facet_filter(rows, states=STATES, cities=["MACHINERY", "BUILDING"], categories=[])


@query
def a11_slice_by(spark, d):
    rows = Retail.from_star(spark, d).items(STATE, CATEGORY, "price")
    return filters.slice_by(filters.slice_by(rows, STATE, "NATION_3"), CATEGORY, "All")


@query
def a12_facet_values(spark, d):
    return filters.facet_values(Retail.from_star(spark, d).sold_categories(), CATEGORY)


@query
def a13_profile(spark, d):
    return profile.profile(Retail.from_star(spark, d).items(CUSTOMER, PURCHASED, PAYMENT, STATE, "seller_id", CATEGORY))


@query
def a14_preview(spark, d):
    rows = Retail.from_star(spark, d).items(CUSTOMER, "seller_id", "price", CATEGORY)
    return profile.preview(rows, 50, [F.desc_nulls_last("price"), ORDER, "seller_id", CATEGORY])


@query
def a15_dedupe_columns(spark, d):
    t = Retail.from_star(spark, d).tables
    left = t.orders.select(ORDER, "customer_id")
    right = t.customers.select("customer_id", STATE)
    return filters.dedupe_columns(left.join(right, left["customer_id"] == right["customer_id"], "left"))


@query
def a16_export_csv(spark, d):
    """Written as CSV and read back."""
    table = Retail.from_star(spark, d).rfm()
    path = scratch_path(spark, "export")
    export_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query
def a16_export_cltv_csv(spark, d):
    """The table of customer values, written as CSV and read back."""
    table = Retail.from_star(spark, d).cltv()
    path = scratch_path(spark, "export")
    export_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


# B: RFM


@query
def b01_rfm_base(spark, d):
    return rfm.rfm_base(Retail.from_star(spark, d).orders())


@query
def b01_rfm_base_orders(spark, d):
    return rfm.rfm_base(Retail.from_star(spark, d).orders(), freq="orders")


@query
def b01_rfm_base_payments(spark, d):
    return rfm.rfm_base(_paid(spark, d).orders())


@query
def b01_rfm_base_payments_per_order(spark, d):
    return rfm.rfm_base(fact.order_fact(_paid(spark, d).tables, payment_grain="order"))


def _scores(spark, d):
    return rfm.rfm_scores(rfm.rfm_base(Retail.from_star(spark, d).orders()))


@query
def b02_rfm_scores(spark, d):
    return _scores(spark, d).select(CUSTOMER, "R", "F", "M")


@query
def b03_rfm_code(spark, d):
    return _scores(spark, d).select(CUSTOMER, "RFM_Score")


@query
def b04_customer_group_code(spark, d):
    return rfm.customer_group(_scores(spark, d), "code").select(CUSTOMER, "RFM_Score", "CustomerGroup")


@query
def b05_customer_group_all(spark, d):
    return rfm.customer_group(_scores(spark, d)).select(CUSTOMER, "RFM_Score", "CustomerGroup")


@query
def b06_behavior_segment_first(spark, d):
    return rfm.behavior_segment(_scores(spark, d)).select(CUSTOMER, "RFM_Score", "BehaviorSegment")


@query
def b07_behavior_segment_last(spark, d):
    return rfm.behavior_segment(_scores(spark, d), "last").select(CUSTOMER, "RFM_Score", "BehaviorSegment")


@query
def b08_rfm_quartiles(spark, d):
    table = rfm.rfm_quartiles(rfm.rfm_base(Retail.from_star(spark, d).orders()))
    return table.select(CUSTOMER, "R_Quartile", "F_Quartile", "M_Quartile")


@query
def b09_segment_summary(spark, d):
    return Retail.from_star(spark, d).rfm_summary()


@query
def b10_value_counts(spark, d):
    return profile.value_counts(Retail.from_star(spark, d).rfm(), "BehaviorSegment")


@query
def b11_score_matrix_rf(spark, d):
    return rfm.score_matrix(_scores(spark, d), "R", "F")


@query
def b11_score_matrix_rm(spark, d):
    return rfm.score_matrix(_scores(spark, d), "R", "M")


@query
def b11_score_matrix_mf(spark, d):
    return rfm.score_matrix(_scores(spark, d), "M", "F")


@query
def b12_category_by_segment(spark, d):
    shop = Retail.from_star(spark, d)
    return rfm.category_by_segment(shop.category_rows(empty_orders=False), shop.rfm(), "BehaviorSegment")


@query
def b12_category_by_group(spark, d):
    shop = Retail.from_star(spark, d)
    return rfm.category_by_segment(shop.category_rows(empty_orders=False), shop.rfm(rule="code"), "CustomerGroup")


@query
def b13_revenue_by_segment(spark, d):
    return rfm.revenue_by_segment(Retail.from_star(spark, d).rfm())


@query
def b14_segment_orders_by_month(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    return rfm.segment_orders_by_month(rows, shop.rfm(orders=rows))


@query
def b15_segment_customers_by_month(spark, d):
    shop = Retail.from_star(spark, d)
    window = filters.in_window(shop.orders(), date(1996, 1, 1), date(1998, 6, 30))
    tagged = rfm.customer_group(rfm.rfm_scores(rfm.rfm_base(window)))
    return rfm.segment_customers_by_month(window, tagged)


# C: customer lifetime value


@query
def c01_cltv_basic(spark, d):
    return cltv.cltv_basic(Retail.from_star(spark, d).orders())


def _basic(spark, d):
    return materialize(cltv.cltv_basic(Retail.from_star(spark, d).orders()), "cltv")


@query
def c02_minmax(spark, d):
    return cltv.minmax(_basic(spark, d), "cltv", "normalized_cltv").select(CUSTOMER, "normalized_cltv")


@query
def c03_cut_fixed(spark, d):
    scaled = cltv.minmax(_basic(spark, d), "cltv", "normalized_cltv")
    return cltv.cut_fixed(scaled, "normalized_cltv", "CLTV_Segment").select(CUSTOMER, "CLTV_Segment")


@query
def c04_cltv_lifespan(spark, d):
    return cltv.cltv_lifespan(_basic(spark, d)).select(CUSTOMER, "better_cltv")


@query
def c05_cut_quantile(spark, d):
    table = materialize(cltv.cltv_lifespan(_basic(spark, d)), "cltv")
    return cltv.cut_quantile(table, "better_cltv", cltv.SEGMENT).select(CUSTOMER, cltv.SEGMENT)


@query
def c05_segment_cltv(spark, d):
    return Retail.from_star(spark, d).cltv()


@query
def c06_rfm_cltv(spark, d):
    return Retail.from_star(spark, d).rfm_cltv()


@query
def c07_crosstab(spark, d):
    table = profile.crosstab(Retail.from_star(spark, d).rfm_cltv(), cltv.SEGMENT, "CustomerGroup", rfm.GROUPS)
    return table.select(cltv.SEGMENT, *[F.col(f"`{g}`").alias(g.replace("-", "_").lower()) for g in rfm.GROUPS])


@query
def c08_log_scale(spark, d):
    table = cltv.log_scale(Retail.from_star(spark, d).cltv(), "cltv_normalized", "cltv_transformed")
    return table.select(CUSTOMER, F.round("cltv_transformed", 6).alias("cltv_transformed"))


@query
def c09_box_stats(spark, d):
    table = cltv.box_stats(Retail.from_star(spark, d).cltv(), cltv.SEGMENT, "cltv_normalized")
    return table.withColumns(r6("min", "q1", "median", "q3", "max", "lower_fence", "upper_fence"))


def _histogram(spark, d, col):
    table = cltv.histogram(materialize(Retail.from_star(spark, d).repeat_summary()), col)
    return table.withColumns(r6("bin_start"))


@query
def c10_histogram_recency(spark, d):
    return _histogram(spark, d, "recency")


@query
def c10_histogram_age(spark, d):
    return _histogram(spark, d, "T")


@query
def c11_score_vs_cltv(spark, d):
    return cltv.score_vs_cltv(Retail.from_star(spark, d).rfm_cltv()).withColumns(r6("min_cltv", "mean_cltv", "max_cltv"))


def _stand_in(shop: Retail, orders: DataFrame | None = None, gamma: dict[str, float] = GAMMA) -> DataFrame:
    """Repeat customers scored with stated parameters instead of fitted ones."""
    scored = lifetime_model.predict_value(shop.repeat_summary(orders=orders), gamma)
    scored = scored.withColumn("predicted_purchases", F.col("frequency") / (F.col("T") + 365.0) * 365.0)
    return lifetime_model.predicted_cltv(scored)


def _tertiles(shop: Retail, orders: DataFrame | None = None) -> DataFrame:
    table = materialize(_stand_in(shop, orders), "scored")
    return cltv.cut_quantile(table, "predicted_cltv", "cltv_segment", (1 / 3, 2 / 3), ("Low", "Mid", "High"))


@query
def c12_revenue_comparison(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    table = cltv.revenue_comparison(rows, _tertiles(shop, rows))
    return table.withColumn("predicted_cltv", F.round("predicted_cltv", 1))


@query
def c12_revenue_comparison_model(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    return cltv.revenue_comparison(rows, shop.modelled_cltv(orders=rows))


@query
def c13_top_categories_per_segment(spark, d):
    shop = Retail.from_star(spark, d)
    return cltv.top_categories_per_segment(shop.category_rows(empty_orders=False), shop.cltv())


@query
def c14_cohort_summary(spark, d):
    return cltv.cohort_summary(Retail.from_star(spark, d).state())


@query
def c15_cltv_by_quarter(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    return cltv.cltv_by_quarter(rows, shop.cltv(rows)).withColumns(r6("cltv_normalized"))


@query
def c15_cltv_by_first_quarter(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    return cltv.cltv_by_quarter(rows, shop.cltv(rows), "first").withColumns(r6("cltv_normalized"))


@query
def c16_repeat_rate(spark, d):
    shop = Retail.from_star(spark, d)
    return cltv.repeat_rate(shop.state(), shop.cltv())


# D: probabilistic lifetime model


@query
def d01_rft_summary(spark, d):
    return cltv.rft_summary(Retail.from_star(spark, d).orders())


@query
def d02_rft_filter(spark, d):
    return Retail.from_star(spark, d).repeat_summary()


@query
def d03_bounds(spark, d):
    return cltv.bounds(Retail.from_star(spark, d).repeat_summary())


def _params(spark, fit: lifetime_model.Fit) -> DataFrame:
    columns = [*(f"{k} double" for k in fit), "converged boolean", "steps int"]
    return spark.createDataFrame([(*fit.values(), fit.converged, fit.steps)], ", ".join(columns))


@query
def d04_fit_pareto_nbd(spark, d):
    return _params(spark, lifetime_model.fit_pareto_nbd(Retail.from_star(spark, d).repeat_summary()))


@query
def d05_fit_gamma_gamma(spark, d):
    return _params(spark, lifetime_model.fit_gamma_gamma(Retail.from_star(spark, d).repeat_summary()))


@query
def d06_predict_purchases(spark, d):
    kept = materialize(Retail.from_star(spark, d).repeat_summary(), "summary")
    return lifetime_model.predict_purchases(kept, lifetime_model.fit_pareto_nbd(kept))


@query
def d04_pareto_nbd_at_rest(spark, d):
    """The fit's slopes, from a likelihood by series."""
    kept = materialize(Retail.from_star(spark, d).repeat_summary(), "summary")
    fit = lifetime_model.fit_pareto_nbd(kept)
    # fitted on ages scaled to ten units, with the penalty on those parameters
    scale = 10.0 / kept.agg(F.max("T")).first()[0]
    params = {k: v * scale if k in ("alpha", "beta") else v for k, v in fit.items()}
    return certificates.pareto_nbd_slopes(kept, params, scale, 1.0)


@query
def d05_gamma_gamma_at_rest(spark, d):
    kept = materialize(Retail.from_star(spark, d).repeat_summary(), "summary")
    x, m = F.col("frequency").cast("double"), F.col("monetary_value").cast("double")
    return certificates.slopes(kept, lambda p: certificates.gamma_gamma_loglik(x, m, p), lifetime_model.fit_gamma_gamma(kept), 0.1)


@query
def d06_purchase_bounds(spark, d):
    """Nobody is predicted a negative number, and of equal ages and last purchases more past ones never mean fewer to come."""
    rows = materialize(d06_predict_purchases(spark, d), "predicted")
    same = rows.groupBy("recency", "T").agg(F.sort_array(F.collect_set(F.struct("frequency", "predicted_purchases"))).alias("s"))
    rising = F.aggregate("s", F.struct(F.lit(True).alias("ok"), F.lit(-1.0).alias("p")), lambda acc, s: F.struct((acc["ok"] & (s["predicted_purchases"] >= acc["p"] - 1e-9)).alias("ok"), s["predicted_purchases"].alias("p")), lambda acc: acc["ok"])
    sound = same.where("recency = T").agg(F.coalesce(F.bool_and(rising), F.lit(True))).scalar()
    return rows.agg(F.count(F.lit(1)).alias("customers"), F.bool_and(F.col("predicted_purchases") >= 0).alias("not_negative"), F.first(sound).alias("rising"))


@query
def d07_predict_value(spark, d):
    kept = Retail.from_star(spark, d).repeat_summary()
    return lifetime_model.predict_value(kept, GAMMA).select(CUSTOMER, F.round("predicted_avg_value", 6).alias("predicted_avg_value"))


@query
def d08_predicted_cltv(spark, d):
    return _stand_in(Retail.from_star(spark, d)).select(CUSTOMER, F.round("predicted_cltv", 4).alias("predicted_cltv"))


@query
def d08_anomalies(spark, d):
    scored = _stand_in(Retail.from_star(spark, d), gamma=ODD_GAMMA)
    return lifetime_model.anomalies(scored).select(CUSTOMER, F.round("predicted_cltv", 4).alias("predicted_cltv"))


@query
def d08_modelled_cltv(spark, d):
    return Retail.from_star(spark, d).modelled_cltv()


@query
def d09_tertiles(spark, d):
    return _tertiles(Retail.from_star(spark, d)).select(CUSTOMER, "cltv_segment")


@query
def d10_pareto_segment(spark, d):
    table = cltv.pareto_segment(materialize(_stand_in(Retail.from_star(spark, d)), "scored"))
    return table.select(CUSTOMER, F.round("cum_cltv_perc", 6).alias("cum_cltv_perc"), "cltv_segment")


@query
def d11_regression_error(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    both = _stand_in(shop, rows).join(shop.cltv(rows).select(CUSTOMER, "better_cltv"), CUSTOMER)
    return cltv.regression_error(both, "better_cltv", "predicted_cltv").select(
        F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse")
    )


# E: churn


@query
def e01_last_purchase(spark, d):
    return churn.last_purchase(Retail.from_star(spark, d).orders())


@query
def e02_churn_inactive(spark, d):
    return churn.churn_label(Retail.from_star(spark, d).orders(), "inactive").select(CUSTOMER, "churned")


@query
def e03_churn_holdout(spark, d):
    return churn.churn_label(Retail.from_star(spark, d).orders())


@query
def e04_churn_features(spark, d):
    return churn.churn_features(Retail.from_star(spark, d).orders())


@query
def e05_customer_features(spark, d):
    return churn.customer_features(Retail.from_star(spark, d).state())


@query
def e06_churn_dataset(spark, d):
    shop = Retail.from_star(spark, d)
    data = churn.churn_dataset(churn.churn_features(shop.churn_state()), shop.cltv())
    return data.select(CUSTOMER, "total_orders", "total_revenue", "churned", cltv.SEGMENT)


@query
def e07_churn_cltv_dataset(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.state()
    data = churn.churn_cltv_dataset(churn.churn_label(rows, "inactive"), _tertiles(shop, rows))
    return data.select(CUSTOMER, "churned", "frequency", "recency", "T", F.round("predicted_cltv", 4).alias("predicted_cltv"), "cltv_segment")


@query
def e08_label_encode(spark, d):
    return Retail.from_star(spark, d).churn().select(CUSTOMER, cltv.SEGMENT, "cltv_segment_encoded")


@query
def e09_churn_rate_by(spark, d):
    return churn.churn_rate_by(Retail.from_star(spark, d).churn())


@query
def e09_class_counts(spark, d):
    return profile.value_counts(Retail.from_star(spark, d).churn(), "churned")


@query
def e09_recency_box_by_churn(spark, d):
    data = materialize(Retail.from_star(spark, d).churn(), "churn")
    return cltv.box_stats(data, "churned", "days_since_last_purchase").withColumns(r6("q1", "median", "q3", "lower_fence", "upper_fence"))


@query
def e10_corr_matrix(spark, d):
    return churn.corr_matrix(Retail.from_star(spark, d).churn(), ("churned", *churn.FEATURES)).withColumns(r6("corr"))


@query
def e11_split(spark, d):
    train, test = churn.split(churn.churn_features(Retail.from_star(spark, d).orders()))
    return train.select(CUSTOMER, F.lit("train").alias("part")).unionByName(test.select(CUSTOMER, F.lit("test").alias("part")))


@query
def e12_dummy_baseline(spark, d):
    train, test = churn.split(churn.churn_features(Retail.from_star(spark, d).orders()))
    return churn_models.dummy_baseline(train, test)


def _split_data(spark, d):
    data = materialize(churn_models.with_vector(Retail.from_star(spark, d).churn()), "churn")
    return (data, *churn.split(data))


_SCORED = [CUSTOMER, *churn.FEATURES, metrics.LABEL, metrics.PREDICTED, metrics.SCORE]


@query
def e13_random_forest(spark, d):
    _, train, test = _split_data(spark, d)
    return churn_models.score(churn_models.train_rf(train), test).select(*_SCORED)


@query
def e14_logistic_regression(spark, d):
    _, train, test = _split_data(spark, d)
    return churn_models.score(churn_models.train_lr(train), test).select(*_SCORED)


@query
def e15_boosted_trees(spark, d):
    _, train, test = _split_data(spark, d)
    return churn_models.score(churn_models.train_gbt(train), test).select(*_SCORED)


@query
def e13_scored_checks(spark, d):
    return certificates.scored_checks(e13_random_forest(spark, d))


@query
def e14_logistic_at_rest(spark, d):
    _, train, _ = _split_data(spark, d)
    train = materialize(train, "train")
    weighted = churn_models.with_weight(train)
    return certificates.logistic_slopes(churn_models.train_lr(train), weighted, "churned", churn.FEATURES, 1.0 / train.count())


@query
def e15_scored_checks(spark, d):
    return certificates.scored_checks(e15_boosted_trees(spark, d))


@query
def e16_class_weights(spark, d):
    return churn.class_weights(Retail.from_star(spark, d).churn())


@query
def e17_cross_val(spark, d):
    data, _, _ = _split_data(spark, d)
    rows = [(name, i, a) for name, fit in TRAINERS.items() for i, a in enumerate(churn_models.cross_val(fit, data))]
    return spark.createDataFrame(rows, "model string, fold int, accuracy double")


def _folds(spark, d):
    return churn_models.with_folds(materialize(Retail.from_star(spark, d).churn(), "churn"))


@query
def e17_folds(spark, d):
    return _folds(spark, d).select(CUSTOMER, "churned", "fold")


@query
def e17_fold_sizes(spark, d):
    data = _folds(spark, d)
    return data.groupBy("fold", "churned").agg(F.count(F.lit(1)).alias("customers"))


def _scored(spark, d):
    """Churn data scored by a stated rule: the longer idle, the likelier gone."""
    idle = F.col("recency_days").cast("double")
    data = churn.churn_features(Retail.from_star(spark, d).orders()).withColumns(
        {metrics.LABEL: F.col("churned"), metrics.SCORE: idle / (idle + 90.0)}
    )
    return data.withColumn(metrics.PREDICTED, (F.col(metrics.SCORE) >= 0.5).cast("int"))


@query
def e18_confusion(spark, d):
    return metrics.confusion(_scored(spark, d))


@query
def e19_class_report(spark, d):
    return metrics.class_report(_scored(spark, d))


@query
def e20_roc(spark, d):
    return metrics.roc(_scored(spark, d))


@query
def e20_auc(spark, d):
    return metrics.auc(_scored(spark, d))


@query
def e21_pr_curve(spark, d):
    return metrics.pr_curve(_scored(spark, d))


@query
def e22_importances(spark, d):
    _, train, _ = _split_data(spark, d)
    return churn_models.importances(churn_models.train_rf(train))


@query
def e22_boosted_importances(spark, d):
    _, train, _ = _split_data(spark, d)
    return churn_models.importances(churn_models.train_gbt(train))


@query
def e22_importance_shares(spark, d):
    rows = materialize(e22_importances(spark, d), "importances")
    return rows.agg(F.sort_array(F.collect_list("feature")).cast("string").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("shares"))


@query
def e23_compare_models(spark, d):
    data, train, test = _split_data(spark, d)
    results = [
        churn_models.ModelResult(
            name,
            materialize(churn_models.score(fit(train), test), "scored"),
            sum(acc := churn_models.cross_val(fit, data)) / len(acc),
        )
        for name, fit in TRAINERS.items()
    ]
    return churn_models.compare_models(results)


@query
def e24_scored_output(spark, d):
    """The predictions as exported."""
    _, train, test = _split_data(spark, d)
    table = churn_models.score(churn_models.train_lr(train), test).select(*_SCORED)
    path = scratch_path(spark, "export")
    export_csv(table, path)
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query
def e24_exported_scores(spark, d):
    """The exported table, read back."""
    return certificates.scored_checks(e24_scored_output(spark, d))


# F: market basket


def _joined(items: str) -> Column:
    return F.concat_ws(", ", items)


@query
def f01_baskets(spark, d):
    rows = basket.baskets(Retail.from_star(spark, d).category_rows())
    return rows.select(ORDER, CUSTOMER, _joined("items").alias("items"))


@query
def f02_segment_baskets(spark, d):
    shop = Retail.from_star(spark, d)
    rows = basket.segment_baskets(basket.baskets(shop.category_rows()), shop.cltv(), SEGMENT_OF_BASKETS)
    return rows.select(ORDER, CUSTOMER, _joined("items").alias("items"), cltv.SEGMENT)


@query
def f03_multi_item(spark, d):
    rows = basket.multi_item(basket.baskets(Retail.from_star(spark, d).category_rows(empty_orders=False)))
    return rows.select(ORDER, CUSTOMER, F.size("items").alias("item_count"))


@query
def f04_clean_items(spark, d):
    shop = Retail.from_star(spark, d)
    shouted = shop.category_rows().withColumn(CATEGORY, F.concat(F.lit("  "), F.upper(CATEGORY), F.lit(" ")))
    rows = basket.clean_items(basket.baskets(shouted))
    return rows.select(ORDER, _joined("items").alias("items"))


@query
def f05_frequent_itemsets(spark, d):
    b = materialize(Retail.from_star(spark, d).baskets(SEGMENT_OF_BASKETS), "baskets")
    return basket.frequent_itemsets(b).select(_joined("items").alias("items"), F.size("items").alias("item_count"), "freq")


@query
def f05_frequent_itemsets_all(spark, d):
    """Of the baskets of all segments."""
    b = materialize(Retail.from_star(spark, d).baskets(), "baskets")
    return basket.frequent_itemsets(b).select(_joined("items").alias("items"), F.size("items").alias("item_count"), "freq")


def _rules(spark, d) -> DataFrame:
    return Retail.from_star(spark, d).rules(SEGMENT_OF_BASKETS)[0]


_RULE_NUMBERS = ("antecedent_support", "consequent_support", "support", "confidence", "lift")


@query
def f06_association_rules(spark, d):
    b = materialize(Retail.from_star(spark, d).baskets(SEGMENT_OF_BASKETS), "baskets")
    itemsets = materialize(basket.frequent_itemsets(b), "itemsets")
    rules = basket.association_rules(itemsets, b.count())
    return rules.select(_joined("antecedents").alias("antecedents"), _joined("consequents").alias("consequents"), *_RULE_NUMBERS)


@query
def f07_rule_label(spark, d):
    return _rules(spark, d).select("rule")


@query
def f08_order_revenue(spark, d):
    return basket.order_revenue(Retail.from_star(spark, d).orders())


@query
def f09_rule_revenue(spark, d):
    return _rules(spark, d).select("rule", "estimated_revenue")


@query
def f09_rule_revenue_all(spark, d):
    return Retail.from_star(spark, d).rules()[0].select("rule", "estimated_revenue")


@query
def f10_top_bundles(spark, d):
    return basket.top_bundles(_rules(spark, d)).select("rule", "lift", "estimated_revenue")


@query
def f11_rule_points(spark, d):
    return basket.rule_points(_rules(spark, d))


@query
def f12_dead_ends(spark, d):
    """Items that no strong rule leads to."""
    rules, b = Retail.from_star(spark, d).rules(SEGMENT_OF_BASKETS)
    strong = basket.filter_rules(rules, confidence=0.0, lift=1.25, support=0.0)
    return basket.dead_ends(b, strong)


@query
def f12_dead_ends_of_all_rules(spark, d):
    rules, b = Retail.from_star(spark, d).rules(SEGMENT_OF_BASKETS)
    return basket.dead_ends(b, rules)


@query
def f13_rule_edges(spark, d):
    return basket.rule_edges(_rules(spark, d))


@query
def f13_rule_nodes(spark, d):
    return basket.rule_nodes(basket.rule_edges(_rules(spark, d)))


@query
def f14_filter_rules(spark, d):
    kept = basket.filter_rules(_rules(spark, d), confidence=0.07, lift=1.2, support=0.004)
    return kept.select("rule", "support", "confidence", "lift", "estimated_revenue")


@query
def f15_uplift(spark, d):
    return basket.uplift(_rules(spark, d)).select("rule", "estimated_revenue", F.round("predicted_uplift_revenue", 2).alias("predicted_uplift_revenue"))


# G: time series


@query
def g01_with_time_keys(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.written_orders()
    return timeseries.with_time_keys(rows, shop.cltv(rows)).select(ORDER, "order_month", "month", cltv.SEGMENT)


@query
def g02_monthly(spark, d):
    return timeseries.monthly(Retail.from_star(spark, d).orders())


@query
def g03_rolling_mean(spark, d):
    months = timeseries.monthly(Retail.from_star(spark, d).orders())
    months = timeseries.rolling_mean(months, "order_month", "total_revenue", out="revenue_3mo")
    months = timeseries.rolling_mean(months, "order_month", "order_count", out="orders_3mo")
    return months.withColumn("revenue_3mo", F.round("revenue_3mo", 2))


@query
def g04_seasonality(spark, d):
    return timeseries.seasonality(Retail.from_star(spark, d).orders())


@query
def g05_forecast(spark, d):
    shop = Retail.from_star(spark, d)
    months = timeseries.monthly(shop.orders(STATE).where(F.col(STATE).isNotNull()), by=[STATE])
    return timeseries.forecast(timeseries.long_series(months, by=[STATE]), [STATE, "metric"])


@query
def g05_forecast_structure(spark, d):
    """What can be told of a forecast without fitting one: its dates, the order of its lines, a band that widens."""
    rows = materialize(g05_forecast(spark, d), "forecast")
    width = F.col("yhat_upper") - F.col("yhat_lower")
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    future = F.col("is_future")
    return rows.groupBy(STATE, "metric").agg(
        F.count_if(~future).alias("months"),
        F.min("ds").cast("string").alias("first_month"),
        F.max(F.when(~future, F.col("ds"))).cast("string").alias("last_month"),
        F.min(F.when(future, F.col("ds"))).cast("string").alias("first_forecast"),
        F.max(F.when(future, F.col("ds"))).cast("string").alias("last_forecast"),
        F.bool_and(ordered).alias("ordered"),
        (F.max_by(width, "ds") > F.min_by(F.when(future, width), F.when(future, F.col("ds")))).alias("widens"),
    )


@query
def g06_forecast_error(spark, d):
    months = timeseries.rolling_mean(timeseries.monthly(Retail.from_star(spark, d).orders()), "order_month", "total_revenue")
    months = materialize(months, "months")
    actual = months.select(F.col("order_month").alias("ds"), F.col("total_revenue").alias("y"))
    predicted = months.where("rolling_3mo IS NOT NULL").select(F.col("order_month").alias("ds"), F.col("rolling_3mo").alias("yhat"))
    return timeseries.forecast_error(actual, predicted).select(
        F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape", 6).alias("mape")
    )


@query
def g07_category_monthly(spark, d):
    return timeseries.category_monthly(Retail.from_star(spark, d).category_rows(empty_orders=False), "small ring")


# H: reviews


@query
def h01_sentiment(spark, d):
    return reviews.sentiment(Retail.from_star(spark, d).tables.order_reviews).select("review_id", "review_score", "review_sentiment")


@query
def h02_review_fact(spark, d):
    rf = Retail.from_star(spark, d).review_fact(CATEGORY)
    return rf.select(ORDER, "seller_id", CATEGORY, "review_score", "delivery_days", "low_score", "delayed", "freight_ratio")


@query
def h03_rating_stats_seller(spark, d):
    return reviews.rating_stats(Retail.from_star(spark, d).review_fact(), "seller_id").withColumns(r6("rating_std"))


@query
def h03_rating_stats_category(spark, d):
    return reviews.rating_stats(Retail.from_star(spark, d).review_fact(CATEGORY), CATEGORY).withColumns(r6("rating_std"))


@query
def h04_top_rated(spark, d):
    stats = reviews.rating_stats(Retail.from_star(spark, d).review_fact(), "seller_id")
    return reviews.top_rated(stats, "seller_id").select("seller_id", "num_reviews", "avg_rating")


@query
def h04_worst_rated(spark, d):
    stats = reviews.rating_stats(Retail.from_star(spark, d).review_fact(CATEGORY), CATEGORY)
    return reviews.worst_rated(stats, CATEGORY).select(CATEGORY, "num_reviews", "avg_rating")


@query
def h05_delivery_by_score(spark, d):
    return reviews.delivery_by_score(Retail.from_star(spark, d).review_fact())


@query
def h06_slow_sellers(spark, d):
    return reviews.slow_sellers(Retail.from_star(spark, d).review_fact(), max_rating=3.0)


@query
def h06_slow_sellers_rated_two(spark, d):
    return reviews.slow_sellers(Retail.from_star(spark, d).review_fact())


@query
def h07_delay_impact(spark, d):
    return reviews.delay_impact(Retail.from_star(spark, d).review_fact())


@query
def h08_freight_vs_rating(spark, d):
    return reviews.freight_vs_rating(Retail.from_star(spark, d).review_fact(CATEGORY)).withColumns(r6("avg_freight_ratio"))


# I: geography


@query
def i01_cltv_geo(spark, d):
    shop = Retail.from_star(spark, d)
    orders = shop.written_orders(STATE)
    rows = geo.cltv_geo(orders, shop.cltv(orders))
    return rows.select(ORDER, CUSTOMER, STATE, "better_cltv", "fact_rows")


@query
def i02_zip_centroids(spark, d):
    return geo.zip_centroids(Retail.from_star(spark, d).tables.geolocation)


@query
def i03_zip_month(spark, d):
    return geo.zip_month(Retail.from_star(spark, d).orders(ZIP, STATE, CITY))


@query
def i04_geo_month(spark, d):
    return Retail.from_star(spark, d).geo_months().drop("geolocation_zip_code_prefix")


@query
def i05_geo_bubbles(spark, d):
    table = geo.geo_bubbles(Retail.from_star(spark, d).geo_months(), "1995-06", "1998-03", "total_revenue", ["AUTOMOBILE"])
    return table


@query
def i06_scaled_metric(spark, d):
    months = Retail.from_star(spark, d).geo_months()
    table = geo.scaled_metric(geo.geo_bubbles(months, metric="total_orders"), "total_orders")
    return table


@query
def i07_top_cities(spark, d):
    return geo.top_cities(Retail.from_star(spark, d).geo_months())


@query
def i08_value_per_customer_state(spark, d):
    return geo.value_per_customer(Retail.from_star(spark, d).orders(STATE))


@query
def i08_value_per_customer_city(spark, d):
    return geo.value_per_customer(Retail.from_star(spark, d).orders(CITY), CITY)


@query
def i09_standardize(spark, d):
    features = clusters.cluster_features(churn.customer_features(Retail.from_star(spark, d).state()))
    table = clusters.standardize(materialize(features, "features"), clusters.CUSTOMER_FEATURES)
    return table.select(CUSTOMER, *[F.round(f"{c}_std", 6).alias(f"{c}_std") for c in clusters.CUSTOMER_FEATURES])


@query
def i10_geo_clusters(spark, d):
    return clusters.geo_clusters(geo.geo_bubbles(Retail.from_star(spark, d).geo_months()))


@query
def i10_geo_cluster_means(spark, d):
    return clusters.cluster_means(clusters.geo_clusters(geo.geo_bubbles(Retail.from_star(spark, d).geo_months())))


@query
def i10_nearest_mean(spark, d):
    return certificates.nearest_mean(materialize(i10_geo_clusters(spark, d), "clusters"), clusters.GEO_FEATURES)


@query
def i11_chosen_clusters(spark, d):
    table = clusters.geo_clusters(geo.geo_bubbles(Retail.from_star(spark, d).geo_months()))
    return filters.slice_by(table, "cluster", [0, 2])


def _clustered(spark, d):
    return clusters.customer_clusters(churn.customer_features(Retail.from_star(spark, d).state()))


@query
def i12_customer_clusters(spark, d):
    return _clustered(spark, d).select(CUSTOMER, *clusters.CUSTOMER_FEATURES, "cluster")


@query
def i13_pca2(spark, d):
    features = clusters.cluster_features(churn.customer_features(Retail.from_star(spark, d).state()))
    return clusters.pca2(materialize(features, "features")).select(CUSTOMER, "pca1", "pca2")


@query
def i12_nearest_mean(spark, d):
    return certificates.nearest_mean(materialize(_clustered(spark, d), "clusters"), clusters.CUSTOMER_FEATURES)


@query
def i13_component_equations(spark, d):
    features = materialize(clusters.cluster_features(churn.customer_features(Retail.from_star(spark, d).state())), "features")
    return certificates.component_equations(materialize(clusters.pca2(features), "scores"), clusters.CUSTOMER_FEATURES)


@query
def i14_label_clusters(spark, d):
    """Clusters given by the recency quartile score, so that SQL can follow."""
    shop = Retail.from_star(spark, d)
    features = clusters.cluster_features(churn.customer_features(shop.state()))
    given = features.join(_scores(spark, d).select(CUSTOMER, F.col("R").alias("cluster")), CUSTOMER)
    return clusters.label_clusters(materialize(given, "clusters"))


@query
def i14_label_kmeans_clusters(spark, d):
    return clusters.label_clusters(materialize(_clustered(spark, d), "clusters"))


@query
def i15_state_month(spark, d):
    return geo.state_month(Retail.from_star(spark, d).orders(STATE))


@query
def i15_state_month_pivot(spark, d):
    return geo.state_month_pivot(geo.state_month(Retail.from_star(spark, d).orders(STATE)), STATES)


@query
def i16_segments_by_state(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.written_orders(STATE)
    return geo.segments_by_state(rows, shop.cltv(rows))


@query
def i16_segment_state_pivot(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.written_orders(STATE)
    return geo.segment_state_pivot(geo.segments_by_state(rows, shop.cltv(rows)), STATES)


@query
def i17_drop_detection(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.written_orders(STATE)
    table = geo.drop_detection(rows, shop.cltv(rows), value="better_cltv")
    return table.withColumn("cltv", F.round(F.col("cltv").cast("decimal(28,6)"), 2).cast("double"))


@query
def i17_flagged_drops(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.written_orders(STATE)
    table = geo.drop_detection(rows, shop.cltv(rows), value="better_cltv").where("drop_flag")
    return table.select(STATE, "year_month", "revenue", "pct_change")


# J: shared operators


@query
def j01_global_row_number(spark, d):
    base = rfm.rfm_base(Retail.from_star(spark, d).orders()).select(CUSTOMER, "Monetary")
    return global_row_number(base, [down("Monetary"), CUSTOMER], "place")


@query
def j02_running_sum(spark, d):
    orders = Retail.from_star(spark, d).tables.orders.select(ORDER, F.col(PAYMENT).cast("decimal(18,2)").alias("paid"))
    table = running_sum(orders, [down("paid"), ORDER], {"paid": "running"})
    return table.select(ORDER, F.col("running").cast("double").alias("running"))


@query
def j03_scalars(spark, d):
    rows = Retail.from_star(spark, d).orders()
    latest = rows.agg(F.max(PURCHASED).alias("v")).scalar()
    return rows.where(F.col(PURCHASED) == latest).select(ORDER, CUSTOMER, PAYMENT)


@query
def j04_complete_pairs(spark, d):
    shop = Retail.from_star(spark, d)
    rows = shop.rfm().withColumn("last_r", F.col("R"))
    return profile.complete_pairs(rows, "BehaviorSegment", "last_r", [1, 2, 3, 4], F.count(F.lit(1)), "customers")


@query
def j05_containment_join(spark, d):
    """Sets of two categories that one order bought, and the orders holding each."""
    b = materialize(basket.multi_item(basket.baskets(Retail.from_star(spark, d).category_rows())), "baskets")
    pairs = b.where(F.size("items") == 2).select(F.col("items").alias("set_items")).distinct()
    found = basket.containment_join(pairs, materialize(basket.basket_patterns(b), "patterns"))
    counts = found.groupBy("set_items").agg(F.sum("baskets").alias("orders"), from_cents(F.sum("revenue_cents")).alias("revenue"))
    return counts.select(_joined("set_items").alias("set_items"), "orders", "revenue")


@query
def j06_train_score_evaluate(spark, d):
    _, train, test = _split_data(spark, d)
    return metrics.class_report(materialize(churn_models.score(churn_models.train_lr(train), test), "scored"))


@query
def j06_support(spark, d):
    """Rows per class behind the report."""
    report = j06_train_score_evaluate(spark, d)
    return report.where(F.col("class").isin("0", "1", "accuracy")).select("class", "support")
