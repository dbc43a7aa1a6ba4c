"""Sales by place: maps, rankings, monthly series and drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    CITY,
    CUSTOMER,
    ORDER,
    PAYMENT,
    PURCHASED,
    STATE,
    ZIP,
    count_rows,
    count_values,
    from_cents,
    money,
    money_sum,
    money_total,
    month_key,
)
from ..functions.skew import skew_join
from .cltv import SEGMENT

METRICS = ("total_revenue", "total_orders")

# Places the map leaves out, and the display divisors of the bubble size:
# fixed values.
OFF_MAP = ("porto trombetas", "ibiajara", "vila dos cabanos", "pau d'arco", "santana do sobrado", "santo antonio do canaa")
ORDERS_AT_FULL_SIZE = 18735
FULL_SIZE = 40000
SMALLEST_SIZE = 1000
REVENUE_PER_UNIT = 10


def cltv_geo(fact: DataFrame, cltv: DataFrame) -> DataFrame:
    return skew_join(fact, cltv.select(CUSTOMER, "better_cltv"), CUSTOMER)


def zip_centroids(geo: DataFrame) -> DataFrame:
    """Mean position per zip code and the first place name in order."""
    zip_code = "geolocation_zip_code_prefix"
    place = F.min(
        F.when(
            F.col("geolocation_city").isNotNull(),
            F.struct(F.col("geolocation_city").alias("city"), F.col("geolocation_state").alias("state")),
        )
    )
    per_zip = geo.where(F.col(zip_code).isNotNull()).groupBy(zip_code).agg(
        F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lon"), place.alias("p")
    )
    return per_zip.select(zip_code, "lat", "lon", F.col("p.city").alias("geo_city"), F.col("p.state").alias("geo_state"))


def zip_month(fact: DataFrame) -> DataFrame:
    """Revenue and fact rows per customer zip code and month."""
    known = fact.where(F.col(ZIP).isNotNull() & F.col(PURCHASED).isNotNull())
    return known.groupBy(ZIP, month_key(PURCHASED).alias("year_month")).agg(
        money_sum(fact, PAYMENT).alias("total_revenue"),
        count_values(fact, ORDER).alias("total_orders"),
        F.min(STATE).alias("state"),
        F.min(CITY).alias("city"),
    )


def geo_month(zips: DataFrame, centroids: DataFrame) -> DataFrame:
    """Zip-code months that have a position."""
    return zips.join(centroids, F.col(ZIP) == F.col("geolocation_zip_code_prefix"))


def months_between(gm: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Months from ``start`` to ``end`` (``yyyy-MM``), both included."""
    if start is not None:
        gm = gm.where(F.col("year_month") >= start)
    if end is not None:
        gm = gm.where(F.col("year_month") <= end)
    return gm


def _metric_sum(metric: str):
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    total = F.sum(money(metric)).cast("double") if metric == "total_revenue" else F.sum(metric)
    return total.alias(metric)


def geo_bubbles(
    gm: DataFrame,
    start: str | None = None,
    end: str | None = None,
    metric: str = "total_revenue",
    exclude: Sequence[str] = OFF_MAP,
) -> DataFrame:
    """A metric per place over a range of months."""
    places = months_between(gm, start, end).dropna(subset=["state", "city", "lat", "lon"])
    if exclude:
        places = places.where(~F.col("city").isin(list(exclude)))
    return places.groupBy("state", "city", "lat", "lon").agg(_metric_sum(metric))


def scaled_metric(
    df: DataFrame, metric: str, full: float = ORDERS_AT_FULL_SIZE, out: str = "scaled_metric"
) -> DataFrame:
    """Bubble size of a metric."""
    if metric == "total_orders":
        size = F.col(metric) / F.lit(float(full)) * FULL_SIZE + SMALLEST_SIZE
    else:
        size = F.col(metric) / REVENUE_PER_UNIT
    return df.withColumn(out, size)


def top_cities(gm: DataFrame, metric: str = "total_revenue", n: int = 10) -> DataFrame:
    totals = gm.where(F.col("city").isNotNull()).groupBy("city").agg(_metric_sum(metric))
    return totals.orderBy(F.desc(metric), "city").limit(n)


def value_per_customer(fact: DataFrame, level: str = STATE, n: int = 10) -> DataFrame:
    """Places by revenue per distinct customer."""
    totals = fact.where(F.col(level).isNotNull()).groupBy(level).agg(
        money_sum(fact).alias("total_revenue"), F.countDistinct(CUSTOMER).alias("unique_customers")
    )
    each = totals.withColumn("avg_cltv_per_customer", F.try_divide("total_revenue", "unique_customers"))
    return each.orderBy(F.desc("avg_cltv_per_customer"), level).limit(n)


def state_month(fact: DataFrame) -> DataFrame:
    known = fact.where(F.col(STATE).isNotNull() & F.col(PURCHASED).isNotNull())
    return known.groupBy(STATE, month_key(PURCHASED).alias("year_month")).agg(money_sum(fact).alias(PAYMENT))


def state_month_pivot(sm: DataFrame, states: Sequence[str]) -> DataFrame:
    """One column per chosen state, zero in months without sales."""
    chosen = sm.where(F.col(STATE).isin(list(states)))
    return chosen.groupBy("year_month").pivot(STATE, list(states)).agg(F.first(PAYMENT)).fillna(0.0, subset=list(states))


def segments_by_state(fact: DataFrame, cltv: DataFrame) -> DataFrame:
    """Fact rows per state and value segment."""
    known = fact.where(F.col(CUSTOMER).isNotNull() & F.col(STATE).isNotNull())
    rows = known.groupBy(CUSTOMER, STATE).agg(count_rows(fact).alias("rows"))
    labels = cltv.where(F.col(SEGMENT).isNotNull()).select(CUSTOMER, F.col(SEGMENT).alias("segment"))
    return rows.join(labels, CUSTOMER).groupBy(STATE, "segment").agg(F.sum("rows").alias("count"))


def segment_state_pivot(counts: DataFrame, states: Sequence[str]) -> DataFrame:
    chosen = counts.where(F.col(STATE).isin(list(states)))
    return chosen.groupBy("segment").pivot(STATE, list(states)).agg(F.sum("count")).fillna(0, subset=list(states))


def drop_detection(fact: DataFrame, scored: DataFrame, pct: float = -20.0, value: str = "predicted_cltv") -> DataFrame:
    """Monthly revenue and value per state with the change to the month before.

    The month before is the state's previous month with sales. The window
    works on one row per state and month.
    """
    known = fact.where(F.col(CUSTOMER).isNotNull() & F.col(STATE).isNotNull() & F.col(PURCHASED).isNotNull())
    per_customer = known.groupBy(CUSTOMER, STATE, month_key(PURCHASED).alias("year_month")).agg(
        money_total(fact).alias("paid"), count_rows(fact).alias("rows")
    )
    worth = (F.col(value).cast("decimal(22,6)") * F.col("rows").cast("decimal(15,0)")).alias("worth")
    joined = per_customer.join(scored.select(CUSTOMER, value), CUSTOMER).select(STATE, "year_month", "paid", worth)
    totals = joined.groupBy(STATE, "year_month").agg(
        from_cents(F.sum("paid")).alias("revenue"), F.coalesce(F.sum("worth"), F.lit(0)).cast("double").alias("cltv")
    )
    before = F.lag("revenue").over(Window.partitionBy(STATE).orderBy("year_month"))
    out = totals.withColumn("prev_revenue", before)
    change = F.try_divide(F.col("revenue") - F.col("prev_revenue"), F.col("prev_revenue")) * 100
    out = out.withColumn("pct_change", change)
    return out.withColumn("drop_flag", F.coalesce(F.col("pct_change") < pct, F.lit(False)))
