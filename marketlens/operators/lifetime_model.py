"""Probabilistic customer lifetime value: Pareto/NBD and Gamma-Gamma.

The likelihood of a parameter set is a sum over customers, so it is a Spark
aggregate. Each pass over the data evaluates a whole batch of parameter sets
(the point, its finite-difference neighbours, candidate steps) and returns one
number per set; the driver sees nothing else. Scoring is columnar.

Published sources: Schmittlein, Morrison and Colombo (1987), "Counting your
customers"; Fader and Hardie (2005), "A note on deriving the Pareto/NBD
model"; Fader and Hardie (2013), "The Gamma-Gamma model of monetary value".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import materialize
from .cltv import pareto_segment

PARETO_NBD = ("r", "alpha", "s", "beta")
GAMMA_GAMMA = ("p", "q", "v")
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)
#: Ages are scaled so that the oldest customer is this old while fitting; the
#: penalty on the parameters refers to that scale.
_SCALED_AGE = 10.0


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series above 10, shifted below."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    while True:
        low = y < 10.0
        if not low.any():
            break
        shift = np.where(low, shift + np.log(y), shift)
        y = np.where(low, y + 1.0, y)
    inv = 1.0 / y
    sq = inv * inv
    series = inv * (1 / 12 - sq * (1 / 360 - sq * (1 / 1260 - sq * (1 / 1680 - sq / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _log_dropout_integral(x, tx, t, r, alpha, s, beta) -> np.ndarray:
    """ln of the integral of (alpha+u)^-(r+x) (beta+u)^-(s+1) over u in [tx, t].

    In w = ln(c+u), c the smaller shape, the integrand falls off like an
    exponential of known rate; what lies beyond 45 of its e-folds is nothing.
    """
    c = min(alpha, beta)
    lo = np.log(c + tx)
    hi = np.log(c + t)
    # at c+u -> larger values the slope is at least (r+x+s) * (c+u)/(max+u)
    slope = (r + x) * (c + tx) / (alpha + tx) + (s + 1) * (c + tx) / (beta + tx) - 1.0
    hi = np.minimum(hi, lo + 45.0 / np.maximum(slope, 1e-3))
    half = np.maximum(hi - lo, 0.0) / 2
    w = lo[:, None] + half[:, None] * (1 + _NODES[None, :])
    u = np.exp(w) - c
    f = w - (r + x)[:, None] * np.log(alpha + u) - (s + 1) * np.log(beta + u)
    top = f.max(axis=1)
    with np.errstate(divide="ignore"):
        return top + np.log(half * (np.exp(f - top[:, None]) @ _WEIGHTS))


def pareto_nbd_loglik(x, tx, t, params: Sequence[float]) -> np.ndarray:
    """Log-likelihood per customer of x repeats, the last at tx, observed to t."""
    r, alpha, s, beta = params
    common = _log_gamma(r + x) - lgamma(r) + r * np.log(alpha) + s * np.log(beta)
    alive = -(r + x) * np.log(alpha + t) - s * np.log(beta + t)
    gone = np.log(s) + _log_dropout_integral(x, tx, t, r, alpha, s, beta)
    return common + np.logaddexp(alive, gone)


def gamma_gamma_loglik(x, m, params: Sequence[float]) -> np.ndarray:
    """Log-likelihood per customer of a mean spend m over x purchases."""
    p, q, v = params
    return (
        _log_gamma(p * x + q)
        - _log_gamma(p * x)
        - lgamma(q)
        + q * np.log(v)
        + (p * x - 1) * np.log(m)
        + p * x * np.log(x)
        - (p * x + q) * np.log(x * m + v)
    )


def _mean_loss(df: DataFrame, cols: Sequence[str], loglik: Callable, penalizer: float) -> Callable:
    """A function from parameter sets to penalised mean negative log-likelihoods."""

    def evaluate(sets: np.ndarray) -> np.ndarray:
        sets = np.asarray(sets, dtype=float)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, weight = np.zeros(len(sets)), 0.0
            for pdf in batches:
                data = [pdf[c].to_numpy(dtype=float) for c in cols]
                n = pdf["n"].to_numpy(dtype=float)
                with np.errstate(all="ignore"):
                    total += np.array([np.sum(n * loglik(*data, p)) for p in sets])
                weight += n.sum()
            yield pd.DataFrame({"i": np.arange(len(sets)), "total": total, "weight": weight})

        sums = (
            df.select(*cols, "n")
            .mapInPandas(partial, "i int, total double, weight double")
            .groupBy("i")
            .agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
            .collect()  # one row per parameter set
        )
        out = np.full(len(sets), np.inf)
        for row in sums:
            if row["weight"] > 0 and np.isfinite(row["total"]):
                out[row["i"]] = -row["total"] / row["weight"] + penalizer * np.sum(sets[row["i"]] ** 2)
        return out

    return evaluate


class Fit(dict):
    """Parameters by name; ``converged`` tells whether the search reached a minimum, in ``steps``."""

    def __init__(self, names: Sequence[str], values: Sequence[float], converged: bool, steps: int):
        super().__init__(zip(names, (float(v) for v in values)))
        self.converged, self.steps = converged, steps


def _minimize(
    loss: Callable, start: np.ndarray, steps: int = 60, tol: float = 1e-7, flat: float = 1e-3
) -> tuple[np.ndarray, bool, int]:
    """Damped Newton descent in log parameters, two passes over the data a step.

    Converged: a step gains less than ``tol``, or none gains and no slope exceeds ``flat``.
    """
    d, h = len(start), 1e-3
    eye = np.eye(d) * h
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    theta, converged, taken = np.log(start), False, 0
    for taken in range(1, steps + 1):
        around = [theta, *(theta + e for e in eye), *(theta - e for e in eye)]
        around += [theta + a * eye[i] + b * eye[j] for i, j in pairs for a, b in product((1, -1), (1, -1))]
        f = loss(np.exp(around))
        up, down = f[1 : d + 1], f[d + 1 : 2 * d + 1]
        grad = (up - down) / (2 * h)
        hess = np.diag((up - 2 * f[0] + down) / h**2)
        for k, (i, j) in enumerate(pairs):
            pp, pm, mp, mm = f[2 * d + 1 + 4 * k : 2 * d + 5 + 4 * k]
            hess[i, j] = hess[j, i] = (pp - pm - mp + mm) / (4 * h**2)
        if not np.all(np.isfinite(hess)) or not np.all(np.isfinite(grad)):
            break
        values, vectors = np.linalg.eigh(hess)
        candidates = []
        for damp in (0.0, 0.01, 0.1, 1.0, 10.0):
            step = -vectors @ ((vectors.T @ grad) / (np.maximum(np.abs(values), 1e-6) + damp))
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
            candidates += [theta + step, theta + step / 4]
        g = loss(np.exp(candidates))
        best = int(np.argmin(g))
        if not g[best] < f[0]:
            converged = bool(np.abs(grad).max() < flat)
            break
        gain = f[0] - g[best]
        theta = candidates[best]
        if gain < tol * max(1.0, abs(g[best])):
            converged = True
            break
    return np.exp(theta), converged, taken


def _best_start(loss: Callable, grid: Sequence[Sequence[float]]) -> np.ndarray:
    starts = np.array(list(product(*grid)), dtype=float)
    return starts[int(np.argmin(loss(starts)))]


def fit_pareto_nbd(summary: DataFrame, penalizer: float = 1.0) -> Fit:
    """Fit r, alpha, s, beta; customers with equal histories are folded first."""
    folded = summary.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("n"))
    folded = materialize(folded, "histories")
    oldest = folded.agg(F.max("T").alias("t")).first()["t"]
    if oldest is None:
        raise ValueError("no customers to fit")
    scale = _SCALED_AGE / max(float(oldest), 1.0)
    scaled = folded.select(
        F.col("frequency").cast("double").alias("frequency"),
        (F.col("recency") * scale).alias("recency"),
        (F.col("T") * scale).alias("T"),
        "n",
    )
    loss = _mean_loss(scaled, ("frequency", "recency", "T"), pareto_nbd_loglik, penalizer)
    start = _best_start(loss, [(0.3, 1.0, 3.0), (0.3, 1.0, 3.0), (0.1, 0.5, 1.5), (0.3, 1.0, 3.0)])
    params = Fit(PARETO_NBD, *_minimize(loss, start))
    params["alpha"] /= scale
    params["beta"] /= scale
    return params


def fit_gamma_gamma(summary: DataFrame, penalizer: float = 0.1) -> Fit:
    """Fit p, q, v on repeat customers with a positive mean spend."""
    kept = summary.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    folded = kept.groupBy(
        F.col("frequency").cast("double").alias("frequency"), F.col("monetary_value").cast("double").alias("monetary_value")
    ).agg(F.count(F.lit(1)).alias("n"))
    folded = materialize(folded, "spend")
    loss = _mean_loss(folded, ("frequency", "monetary_value"), gamma_gamma_loglik, penalizer)
    start = _best_start(loss, [(0.5, 2.0, 6.0), (0.5, 2.0, 6.0), (0.5, 3.0, 20.0)])
    return Fit(GAMMA_GAMMA, *_minimize(loss, start))


def expected_purchases(x, tx, t, horizon: float, params: Sequence[float]) -> np.ndarray:
    """Expected purchases in the next ``horizon`` days, never below zero."""
    r, alpha, s, beta = params
    log_alive = (
        _log_gamma(r + x)
        - lgamma(r)
        + r * np.log(alpha)
        + s * np.log(beta)
        - (r + x) * np.log(alpha + t)
        - s * np.log(beta + t)
        - pareto_nbd_loglik(x, tx, t, params)
    )
    ratio = np.log(beta + t) - np.log(beta + t + horizon)
    lasting = -ratio if abs(s - 1) < 1e-9 else -np.expm1((s - 1) * ratio) / (s - 1)
    return np.maximum(np.exp(log_alive) * (r + x) * (beta + t) / (alpha + t) * lasting, 0.0)


def predict_purchases(df: DataFrame, params: dict[str, float], horizon: float = 365.0) -> DataFrame:
    """Add ``predicted_purchases`` for the next ``horizon`` days."""
    values = tuple(params[k] for k in PARETO_NBD)

    @F.pandas_udf("double")
    def predict(x: pd.Series, tx: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(expected_purchases(*(c.to_numpy(dtype=float) for c in (x, tx, t)), horizon, values))

    return df.withColumn("predicted_purchases", predict("frequency", "recency", "T"))


def predict_value(df: DataFrame, params: dict[str, float]) -> DataFrame:
    """Add ``predicted_avg_value``: the customer's mean, drawn to the population's."""
    p, q, v = (F.lit(float(params[k])) for k in GAMMA_GAMMA)
    x, m = F.col("frequency").cast("double"), F.col("monetary_value")
    own: Column = p * x / (p * x + q - 1)
    return df.withColumn("predicted_avg_value", own * m + (F.lit(1.0) - own) * (v * p / (q - 1)))


def predicted_cltv(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_cltv", F.col("predicted_purchases") * F.col("predicted_avg_value"))


def anomalies(df: DataFrame) -> DataFrame:
    """Customers with a negative predicted value."""
    return df.where(F.col("predicted_cltv") < 0)


def model_cltv(summary: DataFrame, horizon: float = 365.0) -> DataFrame:
    """Fit both models on the filtered summary, score it and segment it."""
    kept = materialize(summary, "summary")
    scored = predict_purchases(kept, fit_pareto_nbd(kept), horizon)
    scored = predicted_cltv(predict_value(scored, fit_gamma_gamma(kept)))
    return pareto_segment(materialize(scored, "scored"))
