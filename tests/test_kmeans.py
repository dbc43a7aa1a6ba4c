"""Several starts in shared passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marketlens.functions.staging import materialize
from marketlens.operators import clusters


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(scale=6, size=(9, 3))
    x = np.round(np.concatenate([rng.normal(c, 1 + i % 3, (40, 3)) for i, c in enumerate(centers)]) * 2**20) / 2**20
    rows = [([float(v) for v in row],) for row in x]
    df = spark.createDataFrame(rows, "_x array<double>")
    return materialize(df.select("_x", F.xxhash64("_x").alias("row")).repartition(5)), x


def cost_of(x, centers):
    return ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_ten_starts_are_as_good_as_ten_runs(blobs):
    points, x = blobs
    cost, centers = clusters.fit_kmeans(points, 3, 9, range(10))
    alone = [clusters.fit_kmeans(points, 3, 9, [s])[0] for s in range(10)]
    assert cost == pytest.approx(min(alone))
    assert cost == pytest.approx(cost_of(x, centers), rel=1e-9)
    vectors = materialize(points.select(array_to_vector("_x").alias("features")))
    other = min(KMeans(k=9, seed=s).fit(vectors).summary.trainingCost for s in range(4))
    assert cost <= other * 1.001


def test_starts_share_their_passes(blobs, monkeypatch):
    points, _ = blobs
    passes = []
    monkeypatch.setattr(type(points), "mapInArrow", lambda self, *a, _m=type(points).mapInArrow, **k: passes.append(1) or _m(self, *a, **k))
    clusters.fit_kmeans(points, 3, 9, range(10))
    together, slowest = len(passes), 0
    for s in range(10):
        passes.clear()
        clusters.fit_kmeans(points, 3, 9, [s])
        slowest = max(slowest, len(passes))
    assert together == slowest


def test_centers_do_not_depend_on_partitions(blobs):
    points, _ = blobs
    a, b = (clusters.fit_kmeans(materialize(points.repartition(n)), 3, 4, range(3)) for n in (1, 7))
    assert np.array_equal(a[1], b[1])


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0)] * 4, [(1.0, 2.0), (2.0, 1.0), (None, 1.0)]])
def test_fewer_points_than_clusters(spark, rows):
    df = materialize(spark.createDataFrame(rows, "a double, b double"))
    out = clusters.kmeans(df, ("a", "b"), 3).collect()
    known = [r for r in rows if None not in r]
    assert len(out) == len(known)
    assert len({(r["a"], r["b"], r["cluster"]) for r in out}) == len(set(known))
