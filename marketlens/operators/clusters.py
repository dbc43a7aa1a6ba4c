"""Clusters of places and customers on standardised features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import elapsed_days, half_even, scalar
from ..functions.staging import materialize

GEO_FEATURES = ("lat", "lon", "total_revenue")
CUSTOMER_FEATURES = ("num_orders", "recency_days", "avg_order_value", "purchase_span_days")


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Zero mean, unit population deviation; a constant column becomes 0."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
        ).alias("s")
    ).scalar()

    def scaled(c: str):
        deviation = stats.getField(f"s_{c}")
        return (F.col(c) - stats.getField(f"m_{c}")) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)

    return df.withColumns({f"{c}{suffix}": scaled(c) for c in cols})


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    scaled = standardize(df.dropna(subset=list(cols)), cols)
    assembler = VectorAssembler(inputCols=[f"{c}_std" for c in cols], outputCol="_features")
    return assembler.transform(scaled).drop(*[f"{c}_std" for c in cols])


#: Coordinates are rounded to multiples of this, so that sums of them are exact in any order.
_GRID = 2.0**-20
_SPLIT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _draw(row: np.ndarray, start: int, turn: int) -> np.ndarray:
    """A Gumbel number for each row hash, start and turn."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + _SPLIT[0] * np.uint64(1 + turn + 1000 * start)
        x = (x ^ (x >> np.uint64(30))) * _SPLIT[1]
        x = (x ^ (x >> np.uint64(27))) * _SPLIT[2]
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return -np.log(-np.log(u + 2.0**-54))


def _points(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(-1, width)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every center."""
    return ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)


def _seeds(points: DataFrame, width: int, k: int, starts: Sequence[int]) -> np.ndarray:
    """k centers for every start, each drawn in proportion to the squared distance from those before.

    The point with the largest logarithm of the distance plus a Gumbel number is
    such a draw, so a pass finds the next center of all starts.
    """
    centers = np.empty((len(starts), 0, width))
    for turn in range(k):

        def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[float, list[float]] | None] = [None] * len(starts)
            for batch in batches:
                x, row = _points(batch, width), batch.column(1).to_numpy()
                for i, start in enumerate(starts):
                    with np.errstate(divide="ignore"):
                        far = np.log(_distances(x, centers[i]).min(axis=1)) if turn else np.zeros(len(x))
                    score = far + _draw(row, start, turn)
                    at = int(score.argmax()) if len(x) else 0
                    if len(x) and (best[i] is None or score[at] > best[i][0]):
                        best[i] = (float(score[at]), x[at].tolist())
            some = [i for i, b in enumerate(best) if b]
            yield pa.record_batch(
                [pa.array(some, pa.int32()), pa.array([best[i][0] for i in some], pa.float64()), pa.array([best[i][1] for i in some], pa.list_(pa.float64()))],
                names=["i", "score", "x"],
            )

        found = points.mapInArrow(pick, "i int, score double, x array<double>").groupBy("i").agg(F.max_by("x", F.struct("score", "x")).alias("x")).collect()
        chosen = {r["i"]: r["x"] for r in found}  # one row per start
        if not chosen:
            return centers
        centers = np.concatenate([centers, np.array([chosen[i] for i in range(len(starts))])[:, None, :]], axis=1)
    return centers


def fit_kmeans(points: DataFrame, width: int, k: int, starts: Sequence[int], passes: int = 60) -> tuple[float, np.ndarray]:
    """Cost and centers of the best of several starts.

    ``points`` is a written table of (x array, row hash). All starts take part in
    the same passes until each stands still, so ten starts read the data as often
    as the slowest one alone. A pass brings back one row per start and cluster.
    """
    centers = _seeds(points, width, k, starts)
    if not centers.shape[1]:
        return 0.0, np.empty((0, width))
    cost, moving = np.full(len(starts), np.inf), list(range(len(starts)))
    for _ in range(passes):

        def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros((len(moving), k), np.int64), np.zeros((len(moving), k, width), np.int64)
            paid = np.zeros(len(moving))
            for batch in batches:
                x = _points(batch, width)
                whole = np.rint(x / _GRID).astype(np.int64)
                for i, s in enumerate(moving):
                    far = _distances(x, centers[s])
                    own = far.argmin(axis=1)
                    n[i] += np.bincount(own, minlength=k)
                    np.add.at(sums[i], own, whole)
                    paid[i] += far.min(axis=1).sum()
            start, cluster = np.divmod(np.arange(len(moving) * k), k)
            costs = np.where(cluster == 0, paid[start], 0.0)
            yield pa.record_batch(
                [pa.array(start), pa.array(cluster), pa.array(n.ravel()), pa.array(sums.reshape(-1, width).tolist(), pa.list_(pa.int64())), pa.array(costs)],
                names=["start", "cluster", "n", "sums", "cost"],
            )

        kind = "start bigint, cluster bigint, n bigint, sums array<bigint>, cost double"
        wide = points.mapInArrow(add_up, kind).groupBy("start", "cluster")
        rows = wide.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]).collect()
        before, paid = centers.copy(), np.zeros(len(moving))
        for r in rows:
            paid[r["start"]] += r["cost"]
            if r["n"]:  # an empty cluster keeps its center
                centers[moving[r["start"]], r["cluster"]] = [r[f"s{j}"] * _GRID / r["n"] for j in range(width)]
        cost[moving] = paid
        moving = [s for s in moving if (before[s] != centers[s]).any()]
        if not moving:
            break
    best = int(cost.argmin())
    return float(cost[best]), centers[best]


def kmeans(df: DataFrame, cols: Sequence[str], k: int, starts: int = 10) -> DataFrame:
    """Add ``cluster``, the best of several starts; ids ascend with the first standardised coordinate.

    ``df`` is a written table. Rows with a null among ``cols`` are dropped.
    """
    scaled = standardize(df.dropna(subset=list(cols)), cols)
    x = F.array(*[F.rint(F.col(f"{c}_std") / _GRID) * _GRID for c in cols])
    scaled = scaled.withColumn("_x", x).drop(*[f"{c}_std" for c in cols])
    points = materialize(scaled.select("_x", F.xxhash64(*df.columns).alias("row")), "points")
    _, centers = fit_kmeans(points, len(cols), k, range(starts))
    centers = sorted({tuple(c) for c in centers.tolist()})

    def distance(center: Sequence[float]) -> Column:
        return sum(((F.get("_x", F.lit(j)) - v) * (F.get("_x", F.lit(j)) - v) for j, v in enumerate(center)), F.lit(0.0))

    if not centers:
        return scaled.drop("_x").withColumn("cluster", F.lit(None).cast("int"))
    far = F.array(*[distance(c) for c in centers])
    out = scaled.withColumn("_far", far).withColumn("cluster", (F.array_position("_far", F.array_min("_far")) - 1).cast("int"))
    return out.drop("_x", "_far")


def geo_clusters(bubbles: DataFrame, k: int = 5) -> DataFrame:
    """Places grouped by position and revenue."""
    return kmeans(materialize(bubbles, "places"), GEO_FEATURES, k)


def cluster_means(df: DataFrame, cols: Sequence[str] = GEO_FEATURES) -> DataFrame:
    """Mean of each feature per cluster, 2 decimals."""
    return df.groupBy("cluster").agg(*[half_even(F.avg(c)).alias(c) for c in cols])


def cluster_features(features: DataFrame) -> DataFrame:
    """Customer features as clustered: recency to the latest purchase itself,
    value as revenue per fact row."""
    latest = scalar(features, F.max("last_purchase"))
    return features.withColumns(
        {
            "recency_days": elapsed_days(F.col("last_purchase"), latest),
            "purchase_span_days": elapsed_days("first_purchase", "last_purchase"),
            "avg_order_value": F.try_divide("total_revenue", "num_orders"),
        }
    )


def customer_clusters(features: DataFrame, k: int = 4) -> DataFrame:
    return kmeans(materialize(cluster_features(features), "customers"), CUSTOMER_FEATURES, k)


def pca2(df: DataFrame, cols: Sequence[str] = CUSTOMER_FEATURES) -> DataFrame:
    """Add the first two principal components of the standardised features."""
    vectors = _vectors(df, cols)
    model = PCA(k=2, inputCol="_features", outputCol="_pca").fit(vectors)
    point = vector_to_array("_pca")
    out = model.transform(vectors).withColumns({"pca1": point[0], "pca2": point[1]})
    return out.drop("_features", "_pca")


def label_clusters(df: DataFrame, cols: Sequence[str] = CUSTOMER_FEATURES) -> DataFrame:
    """Cluster means with a name, from comparison with the mean of the means.

    One row per cluster: means are rounded before they are compared.
    """
    means = cluster_means(df, cols)
    level = means.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    orders, recency, value, span = (F.col(c) for c in CUSTOMER_FEATURES)
    m_orders, m_recency, m_value, m_span = (level.getField(c) for c in CUSTOMER_FEATURES)
    name = (
        F.when((orders > m_orders) & (value > m_value) & (span > m_span) & (recency < m_recency), "Loyal Customers")
        .when(value > m_value * 2, "High Value Buyers")
        .when((orders <= 2) & (span < 5) & (recency < m_recency), "New Customers")
        .when(recency > m_recency * 1.2, "Inactive Customers")
        .otherwise("Occasional Buyers")
    )
    return means.withColumn("segment", name)
