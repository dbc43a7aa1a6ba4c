"""What must hold of a fitted model, computed without the code that fitted it.

A fit cannot be repeated in another engine number by number, but its defining
equations can be checked: slopes vanish at a maximum of a likelihood, the
gradient of a logistic regression is zero, a point is nearest to its own
cluster's mean, a principal component solves the eigen equation. Each function
is a few aggregates over the data with plain column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import materialize
from . import metrics
from .clusters import standardize

#: Terms of the series of the hypergeometric function.
_TERMS = 600
#: A slope is taken between so much above and below a parameter's logarithm.
_STEP = 1e-3


def log_gamma(z: Column) -> Column:
    """By Stirling's series behind ten steps of the recurrence."""
    up = z + 10
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    steps = F.lit(0.0)
    for i in range(10):
        steps = steps + F.log(z + i)
    return series - steps


def pareto_nbd_series(x: Column, at: Column, params: Sequence[float]) -> Column:
    """ln of F(z) / base^n of x repeats at a time, from the series of the hypergeometric function, term by term."""
    r, a, s, b = params
    n = x + (r + s)
    big, power = (a, F.lit(s + 1.0)) if a >= b else (b, x + r)
    z = F.lit(abs(a - b)) / (at + big)

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (power + k) / (k + 1) * z
        return F.struct(term.alias("term"), (acc["sum"] + n / (n + k + 1) * term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(_TERMS)), lambda k: k.cast("double")), start, step, lambda acc: acc["sum"])
    return F.log(total) - n * F.log(at + big)


def pareto_nbd_loglik(x: Column, tx: Column, t: Column, params: Sequence[float], parts: tuple[Column, Column] | None = None) -> Column:
    """Log-likelihood of a history; ``parts`` are the series at the last purchase and at the end, where they are known.

    With n = r + s + x the density is the one of a customer alive all along plus
    s / n times the difference of F(z) / base^n at the last purchase and at the end.
    """
    r, a, s, b = params
    last, end = parts or (pareto_nbd_series(x, tx, params), pareto_nbd_series(x, t, params))
    alive = -(x + r) * F.log(t + a) - s * F.log(t + b)
    gone = F.log(s / (x + (r + s))) + last + F.log(-F.expm1(F.least(end - last, F.lit(-1e-300))))
    top = F.greatest(alive, gone)
    rising = F.aggregate(F.sequence(F.lit(0), x.cast("int") - 1), F.lit(0.0), lambda acc, i: acc + F.log(i + r))
    return rising + r * math.log(a) + s * math.log(b) + top + F.log(F.exp(alive - top) + F.exp(gone - top))


def gamma_gamma_loglik(x: Column, m: Column, params: Sequence[float]) -> Column:
    """Log-likelihood of a mean spend m over x purchases."""
    p, q, v = params
    shape = x * p
    return (
        log_gamma(shape + q) - log_gamma(shape) - math.lgamma(q) + q * math.log(v)
        + (shape - 1) * F.log(m) + shape * F.log(x) - (shape + q) * F.log(x * m + v)
    )


def _moved(params: dict[str, float]) -> list[list[float]]:
    """The parameters with each in turn moved up and down a little in its logarithm."""
    return [[v * math.exp(way * _STEP) if i == j else v for j, v in enumerate(params.values())] for i in range(len(params)) for way in (1, -1)]


def slopes(
    df: DataFrame, loglik: Callable[[Sequence[float]], Column], params: dict[str, float], penalizer: float, most: float = 5e-3, weight: str | None = None
) -> DataFrame:
    """parameter, at_rest: whether the penalised mean loss stands still in the parameter's logarithm.

    A row counts ``weight`` times, or once.
    """
    names, mass = list(params), F.col(weight) if weight else F.lit(1)

    def at(moved: Sequence[float]) -> Column:
        return -F.sum(mass * loglik(moved)) / F.sum(mass) + penalizer * sum(v * v for v in moved)

    losses = [at(moved) for moved in _moved(params)]
    wide = df.agg(*[((losses[2 * i] - losses[2 * i + 1]) / (2 * _STEP)).alias(n) for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("parameter"), (F.abs(n) < most).alias("at_rest")) for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def pareto_nbd_slopes(summary: DataFrame, params: dict[str, float], scale: float, penalizer: float) -> DataFrame:
    """``slopes`` of the Pareto/NBD likelihood over whole days times ``scale``.

    A series depends on the purchases and one time alone, so it is added up once
    for each pair of them, and equal histories count as one: there are as many
    series as purchases and days allow, however many customers there are.
    """
    histories = summary.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("n"))
    histories = materialize(histories, "histories")
    times = histories.select("frequency", F.explode(F.array(F.col("recency"), F.col("T"))).alias("day")).distinct()
    sets = _moved(params)
    x = F.col("frequency").cast("double")
    # dealt out anew: few rows, much work for each
    dealt = times.repartition(summary.sparkSession.sparkContext.defaultParallelism * 4, "frequency", "day")
    series = materialize(dealt.select("frequency", "day", F.array(*[pareto_nbd_series(x, F.col("day") * scale, p) for p in sets]).alias("s")), "series")
    rows = histories.join(series.select("frequency", F.col("day").alias("recency"), F.col("s").alias("_last")), ["frequency", "recency"])
    rows = rows.join(series.select("frequency", F.col("day").alias("T"), F.col("s").alias("_end")), ["frequency", "T"])
    tx, t = F.col("recency") * scale, F.col("T") * scale

    def loglik(moved: Sequence[float]) -> Column:
        i = sets.index(list(moved))
        return pareto_nbd_loglik(x, tx, t, moved, (F.col("_last")[i], F.col("_end")[i]))

    return slopes(rows, loglik, params, penalizer, weight="n")


def logistic_slopes(model, weighted: DataFrame, label: str, features: Sequence[str], penalty: float, most: float = 1e-3) -> DataFrame:
    """feature, at_rest: whether the penalised weighted loss stands still in the coefficient of the standardised feature."""
    x, w = vector_to_array("features"), F.col("weight")
    ready = weighted.select(*[x[i].alias(f"x{i}") for i in range(len(features))], w, F.col(label).cast("double").alias("y"))
    margin = F.lit(float(model.intercept))
    for i, b in enumerate(model.coefficients.toArray()):
        margin = margin + F.col(f"x{i}") * float(b)
    off = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col("y"))
    cols = [f"x{i}" for i in range(len(features))]
    mass, square = F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))
    sums = ready.agg(
        mass.alias("mass"),
        (mass - square / mass).alias("free"),
        F.sum(off).alias("g"),
        *[F.sum(off * F.col(c)).alias(f"g_{c}") for c in cols],
        *[(F.sum(F.col("weight") * F.col(c) * F.col(c)) - F.sum(F.col("weight") * F.col(c)) ** 2 / mass).alias(f"v_{c}") for c in cols],
    )
    rows = [F.struct(F.lit("intercept").alias("feature"), (F.abs(F.col("g") / F.col("mass")) < most).alias("at_rest"))]
    for i, (name, c) in enumerate(zip(features, cols)):
        spread = F.sqrt(F.col(f"v_{c}") / F.col("free"))
        slope = F.col(f"g_{c}") / F.col("mass") / spread + penalty * float(model.coefficients[i]) * spread
        rows.append(F.struct(F.lit(name).alias("feature"), (F.abs(slope) < most).alias("at_rest")))
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def nearest_mean(clustered: DataFrame, cols: Sequence[str], slack: float = 1e-4) -> DataFrame:
    """points, clusters, misplaced: points that lie nearer to another cluster's mean than to their own."""
    scaled = standardize(clustered.dropna(subset=list(cols)), cols)
    std = [f"{c}_std" for c in cols]
    means = scaled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in std])
    table = means.agg(F.collect_list(F.struct("cluster", *std)).alias("m")).scalar()  # one entry per cluster
    placed = scaled.withColumn("_means", table)

    def far(m: Column) -> Column:
        return sum(((F.col(c) - m[c]) * (F.col(c) - m[c]) for c in std), F.lit(0.0))

    nearest = F.array_min(F.transform("_means", far))
    own = F.array_min(F.transform(F.filter("_means", lambda m: m["cluster"] == F.col("cluster")), far))
    return placed.agg(
        F.count(F.lit(1)).alias("points"),
        F.countDistinct("cluster").alias("clusters"),
        F.count_if(own > nearest + slack * (1 + nearest)).alias("misplaced"),
    )


def component_equations(scored: DataFrame, cols: Sequence[str], parts: Sequence[str] = ("pca1", "pca2"), slack: float = 1e-6) -> DataFrame:
    """component, rows, unit, solves, falling: the loadings have length 1, the eigen equation holds, variances fall.

    The loadings of a score t are cov(x, t) / var(t); they have length 1 and give
    back t = sum of loading times x exactly if t is a unit eigenvector's score.
    """
    scaled = standardize(scored.dropna(subset=list(cols)), cols)
    std = [f"{c}_std" for c in cols]
    stats = scaled.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            *[F.var_pop(p).alias(f"v_{p}") for p in parts],
            *[F.covar_pop(c, p).alias(f"{c}_{p}") for c in std for p in parts],
        ).alias("s")
    ).scalar()
    told = scaled.withColumn("_s", stats)
    s = F.col("_s")
    gaps = [F.max(F.abs(F.col(p) - sum((s[f"{c}_{p}"] / s[f"v_{p}"] * F.col(c) for c in std), F.lit(0.0)))).alias(f"gap_{p}") for p in parts]
    wide = told.agg(F.first("_s").alias("_s"), *gaps)
    rows = []
    for i, p in enumerate(parts):
        length = sum(((s[f"{c}_{p}"] / s[f"v_{p}"]) ** 2 for c in std), F.lit(0.0))
        falling = s[f"v_{parts[i - 1]}"] >= s[f"v_{p}"] if i else F.lit(True)
        rows.append(
            F.struct(
                F.lit(p).alias("component"),
                s["n"].alias("rows"),
                (F.abs(length - 1) < slack).alias("unit"),
                (F.col(f"gap_{p}") < slack).alias("solves"),
                falling.alias("falling"),
            )
        )
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scored_checks(scored: DataFrame) -> DataFrame:
    """rows, positives, in_range, consistent of a scored table."""
    y, p, score = F.col(metrics.LABEL), F.col(metrics.PREDICTED), F.col(metrics.SCORE)
    # two classes: a row is predicted positive exactly if its probability is at least a half
    agrees = ((score > 0.5) & (p == 1)) | ((score < 0.5) & (p == 0)) | (score == 0.5)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y.cast("bigint")).alias("positives"),
        F.bool_and(score.between(0, 1)).alias("in_range"),
        F.bool_and(agrees).alias("consistent"),
    )
