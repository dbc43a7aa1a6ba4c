"""Monthly series, trailing means, seasonality and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, CUSTOMER, ORDER, PURCHASED, money_sum, month_key
from ..functions.skew import skew_join
from .cltv import SEGMENT


def with_time_keys(fact: DataFrame, cltv: DataFrame) -> DataFrame:
    """Add the month, the calendar month and the customer's value segment."""
    keyed = fact.withColumns({"order_month": month_key(PURCHASED), "month": F.month(PURCHASED)})
    return skew_join(keyed, cltv.select(CUSTOMER, SEGMENT), CUSTOMER, keep="big")


def monthly(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue and distinct orders per month."""
    dated = fact.where(F.col(PURCHASED).isNotNull())
    return dated.groupBy(*by, month_key(PURCHASED).alias("order_month")).agg(
        money_sum(fact).alias("total_revenue"), F.countDistinct(ORDER).alias("order_count")
    )


def rolling_mean(df: DataFrame, order: str, col: str, n: int = 3, by: Sequence[str] = (), out: str = "rolling_3mo") -> DataFrame:
    """Mean of the last ``n`` rows; NULL until there are ``n``.

    For aggregated series: the window holds one row per period and key.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(F.col(col)).over(w) == n, F.avg(col).over(w)))


def seasonality(fact: DataFrame) -> DataFrame:
    """Revenue and orders per calendar month, all years together."""
    dated = fact.where(F.col(PURCHASED).isNotNull())
    return dated.groupBy(F.month(PURCHASED).alias("month_number"), F.date_format(PURCHASED, "MMM").alias("month")).agg(
        money_sum(fact).alias("total_revenue"), F.countDistinct(ORDER).alias("order_count")
    )


def category_monthly(fact: DataFrame, category: str) -> DataFrame:
    """Monthly revenue of one product category."""
    rows = fact.where((F.col(CATEGORY) == category) & F.col(PURCHASED).isNotNull())
    return rows.groupBy(month_key(PURCHASED).alias("order_month")).agg(money_sum(fact).alias("total_revenue"))


def long_series(months: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = ("total_revenue", "order_count")) -> DataFrame:
    """One row per series and month: keys, ``metric``, ``ds`` and ``y``."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics]))
    day = F.to_date(F.concat("order_month", F.lit("-01")))
    return months.select(*by, day.alias("ds"), values.alias("v")).select(*by, "v.metric", "ds", "v.y")


def _design(days: np.ndarray, start: float, span: float, changes: np.ndarray, waves: int) -> np.ndarray:
    """Piecewise-linear trend and yearly Fourier terms."""
    t = (days - start) / span
    angle = 2 * np.pi * days / 365.25
    cols = [np.ones_like(t), t]
    cols += [np.maximum(0.0, t - c) for c in changes]
    for k in range(1, waves + 1):
        cols += [np.sin(k * angle), np.cos(k * angle)]
    return np.column_stack(cols)


def fit_series(ds: pd.Series, y: np.ndarray, periods: int, waves: int = 4, n_changes: int = 25) -> pd.DataFrame:
    """Fit one series and predict its own dates and the next month-ends.

    Ridge least squares on the scaled series, with the same trend bends and
    yearly waves whatever its length: on a short series the ridge holds them
    back. The 80 % band adds up three variances: the noise around the fit, what
    the fit leaves open about the coefficients, and, behind the last date, bends
    yet to come. Those are taken to come as often and to be as strong as the
    past ones, so the variance they add grows with the third power of the time
    ahead.
    """
    dates = pd.DatetimeIndex(pd.to_datetime(ds))
    future = pd.date_range(dates.max() + pd.offsets.Day(1), periods=periods, freq="ME") if len(dates) else dates
    every = dates.append(future)
    days = every.to_numpy().astype("datetime64[D]").astype(float)
    known = len(dates)
    scale = max(float(np.abs(y).max()), 1e-12)
    span = max(days[known - 1] - days[0], 1.0)
    reach = 0.95  # bends lie in this part of the history
    changes = np.linspace(0, reach, n_changes + 2)[1:-1]
    x = _design(days, days[0], span, changes, waves)
    # the level is free, the slope nearly so, bends and waves are held back
    penalty = np.concatenate([[0.0, 1e-3], np.full(n_changes, 0.01), np.full(2 * waves, 0.1)]) + 1e-9
    a = x[:known]
    inverse = np.linalg.inv(a.T @ a + np.diag(penalty))
    beta = inverse @ (a.T @ (y / scale))
    yhat = x @ beta * scale
    free = known - np.trace(a @ inverse @ a.T)
    noise = np.sum((y - yhat[:known]) ** 2) / max(free, 1.0)
    bends = beta[2 : 2 + n_changes] * scale
    ahead = np.maximum(0.0, days - days[known - 1]) / span
    trend = n_changes / reach * np.mean(bends**2) * ahead**3 / 3
    spread = 1.2815515655446004 * np.sqrt(noise * (1 + np.einsum("ij,jk,ik->i", x, inverse, x)) + trend)
    return pd.DataFrame(
        {
            "ds": every.date,
            "yhat": yhat,
            "yhat_lower": yhat - spread,
            "yhat_upper": yhat + spread,
            "is_future": np.arange(len(every)) >= known,
        }
    )


def forecast(series: DataFrame, keys: Sequence[str], periods: int = 6) -> DataFrame:
    """Forecast many series at once, one fit per key.

    ``series`` holds one row per key and period, so a group is as long as the
    calendar, whatever the sales.
    """
    fields = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, ds date, yhat double, yhat_lower double, yhat_upper double, is_future boolean"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        out = fit_series(pdf["ds"], pdf["y"].to_numpy(dtype=float), periods)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return series.where("y IS NOT NULL").groupBy(*keys).applyInPandas(fit, schema)


def forecast_error(actual: DataFrame, predicted: DataFrame, on: Sequence[str] = ("ds",), by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and MAPE over the dates both have; zero actuals have no MAPE."""
    joined = actual.select(*on, "y").join(predicted.select(*on, "yhat"), list(on))
    gap = F.col("y") - F.col("yhat")
    return joined.groupBy(*by).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(gap, F.col("y")))) * 100).alias("mape"),
    )
