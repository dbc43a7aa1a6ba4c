"""Customer lifetime value from order history, its segments and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    CATEGORY,
    CUSTOMER,
    PAYMENT,
    count_orders,
    count_rows,
    cut,
    earliest,
    elapsed_days,
    from_cents,
    latest,
    money,
    money_mean,
    money_sum,
    money_total,
    purchased,
    quarter_key,
    scalar,
)
from ..functions.ordering import down, running_sum
from ..functions.quantiles import quantile_table, quantiles
from ..functions.staging import materialize

SEGMENTS = ("Low CLTV", "Medium CLTV", "High CLTV")
SEGMENT = "CLTV_new_Segment"


def cltv_basic(fact: DataFrame) -> DataFrame:
    """Orders, mean payment and frequency-weighted value per customer."""
    known = fact.where(F.col(CUSTOMER).isNotNull())
    customers = scalar(known.select(CUSTOMER).distinct(), F.count(F.lit(1)))
    per_customer = known.groupBy(CUSTOMER).agg(
        count_orders(fact).alias("total_orders"),
        money_sum(fact).alias("total_payment"),
        money_mean(fact).alias("avg_order_value"),
    )
    frequency = F.col("total_orders") / customers
    return per_customer.withColumn("purchase_frequency", frequency).withColumn(
        "cltv", F.col("avg_order_value") * F.col("purchase_frequency")
    )


def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """Scale to 0..1 over the whole column; a constant column gives 0."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    return df.withColumn(out, (F.col(col) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo))


def cut_fixed(
    df: DataFrame, col: str, out: str, edges: Sequence[float] = (0.2, 0.8), labels: Sequence[str] = SEGMENTS
) -> DataFrame:
    """Label by fixed right-closed edges."""
    return df.withColumn(out, cut(col, edges, labels))


def cut_quantile(
    df: DataFrame, col: str, out: str, probs: Sequence[float] = (0.2, 0.8), labels: Sequence[str] = SEGMENTS
) -> DataFrame:
    """Label by the column's own quantiles. ``df`` should be a written table."""
    edges = quantiles(df, {col: probs})[col]
    return df.withColumn(out, cut(col, edges, labels))


def cltv_lifespan(df: DataFrame, months: int = 12) -> DataFrame:
    """Value over a lifespan: mean payment x orders per customer x months."""
    frequency = scalar(df, F.sum("total_orders") / F.count(F.lit(1)))
    return df.withColumn("better_cltv", F.col("avg_order_value") * frequency * months)


def segment_cltv(basic: DataFrame, months: int = 12) -> DataFrame:
    """All value columns and both segmentations on the customer table.

    The customer table is written once; a few numbers about it then turn
    every further column into a plain expression over one scan.
    """
    basic = materialize(basic, "cltv")
    total = basic.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_orders").alias("orders"),
        *[f(c).alias(f"{c}_{f.__name__}") for c in ("cltv", "avg_order_value") for f in (F.min, F.max)],
    ).first()
    frequency = (total["orders"] or 0) / max(total["n"], 1)

    def scaled(col: Column, lo: float | None, hi: float | None) -> Column:
        span = 1.0 if lo == hi else hi - lo
        return (col - F.lit(lo)) / F.lit(span)

    out = basic.withColumn("normalized_cltv", scaled(F.col("cltv"), total["cltv_min"], total["cltv_max"]))
    out = cut_fixed(out, "normalized_cltv", "CLTV_Segment")
    out = out.withColumn("better_cltv", F.col("avg_order_value") * F.lit(frequency) * months)
    ends = [None if v is None else v * frequency * months for v in (total["avg_order_value_min"], total["avg_order_value_max"])]
    out = out.withColumn("cltv_normalized", scaled(F.col("better_cltv"), *ends))
    edges = quantiles(out, {"better_cltv": (0.2, 0.8)})["better_cltv"]
    return out.withColumn(SEGMENT, cut("better_cltv", edges, SEGMENTS))


def rfm_cltv(rfm: DataFrame, cltv: DataFrame) -> DataFrame:
    """RFM columns with the value columns of the same customer."""
    return rfm.join(cltv.select(CUSTOMER, "better_cltv", "cltv_normalized", SEGMENT), CUSTOMER)


def log_scale(df: DataFrame, col: str, out: str, factor: float = 1000.0) -> DataFrame:
    return df.withColumn(out, F.log1p(F.col(col) * factor))


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Five-number summary per group with fences at 1.5 interquartile ranges.

    ``df`` should be a written table: the quartiles read it again.
    """
    known = df.where(F.col(group).isNotNull() & F.col(col).isNotNull()).select(group, col)
    ends = known.groupBy(group).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(F.lit(1)).alias("n"))
    quartiles = quantile_table(known, col, (0.25, 0.5, 0.75), by=[group])
    quartiles = quartiles.select(
        group, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return ends.join(quartiles, group).select(
        group,
        "n",
        "min",
        "q1",
        "median",
        "q3",
        "max",
        (F.col("q1") - reach).alias("lower_fence"),
        (F.col("q3") + reach).alias("upper_fence"),
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo) / F.lit(float(bins)))
    bin_no = F.least(F.lit(bins), F.floor((F.col(col) - lo) / width).cast("int") + 1)
    counts = df.where(F.col(col).isNotNull()).select(bin_no.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (lo + (F.col("bin") - 1) * width).alias("bin_start"), "count")


def score_vs_cltv(scored: DataFrame) -> DataFrame:
    """Where RFM codes and normalised value meet, as counts and ranges."""
    return scored.groupBy("RFM_Score", SEGMENT).agg(
        F.count(F.lit(1)).alias("customers"),
        F.min("cltv_normalized").alias("min_cltv"),
        F.avg("cltv_normalized").alias("mean_cltv"),
        F.max("cltv_normalized").alias("max_cltv"),
    )


def past_revenue(fact: DataFrame) -> DataFrame:
    known = fact.where(F.col(CUSTOMER).isNotNull())
    return known.groupBy(CUSTOMER).agg(money_sum(fact).alias("past_revenue"))


def revenue_comparison(fact: DataFrame, scored: DataFrame, by: str = "cltv_segment") -> DataFrame:
    """Past and predicted revenue per model segment; no history counts as zero."""
    joined = scored.select(CUSTOMER, by, "predicted_cltv").join(past_revenue(fact), CUSTOMER, "left")
    return (
        joined.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.coalesce(F.sum(money("past_revenue")), F.lit(0)).cast("double").alias("past_revenue"),
            F.coalesce(F.sum(F.col("predicted_cltv").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("predicted_cltv"),
        )
    )


def top_categories_per_segment(fact: DataFrame, cltv: DataFrame, n: int = 5) -> DataFrame:
    """The most bought categories of each value segment."""
    bought = (
        fact.where(F.col(CATEGORY).isNotNull() & F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER, CATEGORY)
        .agg(count_rows(fact).alias("rows"))
    )
    labelled = cltv.where(F.col(SEGMENT).isNotNull()).select(CUSTOMER, SEGMENT)
    counts = bought.join(labelled, CUSTOMER).groupBy(SEGMENT, CATEGORY).agg(F.sum("rows").alias("purchase_count"))
    # one row per segment and category: the window sorts the catalogue, not the sales
    place = F.row_number().over(Window.partitionBy(SEGMENT).orderBy(F.desc("purchase_count"), F.asc(CATEGORY)))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def cohort_summary(fact: DataFrame) -> DataFrame:
    """Customers and lifetime revenue by the quarter of the first purchase.

    Two aggregations instead of a window over a customer's rows.
    """
    per_customer = (
        fact.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(earliest(fact).alias("first"), money_total(fact).alias("revenue"))
        .where(F.col("first").isNotNull())
    )
    return per_customer.groupBy(quarter_key("first").alias("first_purchase_quarter")).agg(
        F.count(F.lit(1)).alias("customer_count"), from_cents(F.sum("revenue")).alias("total_revenue")
    )


def cltv_by_quarter(fact: DataFrame, scored: DataFrame, quarter: str = "order") -> DataFrame:
    """Mean normalised value per quarter and segment, weighted by fact rows.

    ``quarter="order"`` takes the quarter of every order, ``"first"`` the
    customer's first.
    """
    known = fact.where(F.col(CUSTOMER).isNotNull() & purchased(fact).isNotNull())
    if quarter == "order":
        rows = known.groupBy(CUSTOMER, quarter_key(purchased(fact)).alias("first_quarter")).agg(count_rows(fact).alias("rows"))
    elif quarter == "first":
        rows = known.groupBy(CUSTOMER).agg(earliest(fact).alias("first"), count_rows(fact).alias("rows"))
        rows = rows.select(CUSTOMER, quarter_key("first").alias("first_quarter"), "rows")
    else:
        raise ValueError(f"unknown quarter: {quarter}")
    joined = rows.join(scored.select(CUSTOMER, SEGMENT, "cltv_normalized"), CUSTOMER)
    mean = F.sum(F.col("cltv_normalized") * F.col("rows")) / F.sum("rows")
    return joined.where(F.col(SEGMENT).isNotNull()).groupBy("first_quarter", SEGMENT).agg(mean.alias("cltv_normalized"))


def repeat_rate(fact: DataFrame, cltv: DataFrame) -> DataFrame:
    """Share of customers with more than one order, per value segment."""
    orders = fact.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER).agg(count_orders(fact).alias("orders"))
    joined = orders.join(cltv.where(F.col(SEGMENT).isNotNull()).select(CUSTOMER, SEGMENT), CUSTOMER)
    return joined.groupBy(SEGMENT).agg(F.avg((F.col("orders") > 1).cast("int")).alias("repeat_flag"))


def rft_summary(fact: DataFrame) -> DataFrame:
    """Repeat orders, first-to-last days, age and mean payment per customer."""
    end = scalar(fact, latest(fact))
    per_customer = (
        fact.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            (count_orders(fact) - 1).alias("frequency"),
            earliest(fact).alias("first"),
            latest(fact).alias("last"),
            money_mean(fact).alias("monetary_value"),
        )
    )
    return per_customer.select(
        CUSTOMER,
        "frequency",
        elapsed_days("first", "last").alias("recency"),
        elapsed_days(F.col("first"), end).alias("T"),
        "monetary_value",
    )


def rft_filter(summary: DataFrame, min_frequency: int = 2, cap: int | None = 365, positive: bool = True) -> DataFrame:
    """Repeat buyers below the 99th percentile of spend, with capped ages."""
    kept = materialize(summary.where(F.col("frequency") >= min_frequency).dropna(), "rft")
    top = quantiles(kept, {"monetary_value": [0.99]})["monetary_value"][0]
    kept = kept.where(F.col("monetary_value") <= F.lit(top))
    if positive:
        kept = kept.where(F.col("monetary_value") > 0)
    if cap is not None:
        kept = kept.withColumns({c: F.least(F.col(c), F.lit(cap)) for c in ("recency", "T")})
    return kept


def bounds(df: DataFrame, cols: Sequence[str] = ("frequency", "recency", "T", "monetary_value")) -> DataFrame:
    """Smallest and largest value and the number of NULLs of each column."""
    wide = df.agg(
        *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))],
        *[F.count_if(F.col(c).isNull()).alias(f"no{i}") for i, c in enumerate(cols)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            F.col(f"no{i}").alias("null_count"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pareto_segment(
    df: DataFrame,
    col: str = "predicted_cltv",
    key: str = CUSTOMER,
    edges: Sequence[float] = (0.80, 0.95),
    labels: Sequence[str] = ("High", "Mid", "Low"),
    out: str = "cltv_segment",
) -> DataFrame:
    """Largest first, labelled by the running share of the total.

    The running total is taken over exact decimals across the whole cluster.
    """
    exact = df.withColumn("_v", F.col(col).cast("decimal(28,6)"))
    summed = running_sum(exact, [down(col), key], {"_v": "_cum"})
    total = scalar(df, F.sum(F.col(col).cast("decimal(28,6)")))
    share = F.try_divide(F.col("_cum").cast("double"), total.cast("double"))
    out_df = summed.withColumn("cum_cltv", F.col("_cum").cast("double")).withColumn("cum_cltv_perc", share)
    return out_df.withColumn(out, cut("cum_cltv_perc", edges, labels)).drop("_v", "_cum")


def regression_error(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute and root mean squared error of two columns."""
    gap = F.col(actual) - F.col(predicted)
    return df.where(gap.isNotNull()).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
