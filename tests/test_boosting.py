"""Boosted trees against a plain version that looks at every row for every split, and stratified folds."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marketlens.functions.columns import CUSTOMER
from marketlens.functions.staging import materialize
from marketlens.operators import boosting, churn_models
from marketlens.operators.boosting import Settings, fit_boosted

SMALL = Settings(rounds=4, depth=3, rate=0.3, bins=8, least_curvature=0.5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 3)), 1)  # rounded, so that values and gains tie
    x[:, 2] = rng.integers(0, 3, 240)
    y = (x[:, 0] - 0.7 * x[:, 1] * (x[:, 2] == 1) + 0.5 * rng.normal(size=240) > 0.3).astype(int)
    rows = [(i, [float(v) for v in row], int(c), i % 3) for i, (row, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"{CUSTOMER} bigint, x array<double>, churned int, part int")
    return materialize(df.select(CUSTOMER, array_to_vector("x").alias("features"), "churned", "part").repartition(5)), x, y


def plain_trees(bins, y, settings, n_bins):
    """Trees as nested tuples; every split is tried on every node's own rows."""
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    margin, trees = np.zeros(len(y)), []

    def worth(g, h):
        return g * g / (h + settings.l2)

    def build(rows, g, h, depth):
        best = (1e-6, None, None)
        for j in range(bins.shape[1]) if depth < settings.depth else ():
            for b in range(n_bins - 1):
                left = rows[bins[rows, j] <= b]
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                gain = worth(gl, hl) + worth(gr, hr) - worth(gl + gr, hl + hr)
                if min(hl, hr) >= settings.least_curvature and gain > best[0]:
                    best = (gain, j, b)
        if best[1] is None:
            return -settings.rate * g[rows].sum() / (h[rows].sum() + settings.l2)
        _, j, b = best
        return j, b, build(rows[bins[rows, j] <= b], g, h, depth + 1), build(rows[bins[rows, j] > b], g, h, depth + 1)

    def answer(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        unit = float(1 << 20)
        g, h = np.rint(weight * (p - y) * unit) / unit, np.rint(weight * p * (1 - p) * unit) / unit
        trees.append(build(np.arange(len(y)), g, h, 0))
        margin = margin + np.array([answer(trees[-1], row) for row in bins])
    return trees, margin


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.leaf[node]
    return int(tree.feature[node]), int(tree.bin[node]), nested(tree, 2 * node + 1), nested(tree, 2 * node + 2)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-9)


def test_trees_equal_the_plain_version(table):
    df, x, y = table
    model = fit_boosted(df, "churned", settings=SMALL)[0]
    bins = model.bins(x)
    trees, margin = plain_trees(bins, y, SMALL, SMALL.bins)
    assert len(model.trees) == SMALL.rounds
    assert all(same(nested(t), want) for t, want in zip(model.trees, trees))
    scored = {r[CUSTOMER]: r["positive"] for r in model.transform(df).collect()}
    assert [scored[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())
    assert model.importances.sum() == pytest.approx(1.0)


def test_folds_share_passes_and_equal_models_of_their_own(table, monkeypatch):
    df, x, y = table
    monkeypatch.setattr(boosting, "_WRITTEN", 2)  # margins are written in between
    passes, sums = [], boosting._level_sums
    monkeypatch.setattr(boosting, "_level_sums", lambda *a: passes.append(a[-1]) or sums(*a))
    together = fit_boosted(df, "churned", "part", range(3), SMALL)
    assert len(passes) <= SMALL.rounds * SMALL.depth
    for i, model in enumerate(together):
        mine = np.arange(len(y)) % 3 != i
        trees, _ = plain_trees(model.bins(x)[mine], y[mine], SMALL, SMALL.bins)
        assert all(same(nested(t), want) for t, want in zip(model.trees, trees))


def test_a_pass_is_one_job(table):
    """600 passes of several jobs each took minutes on any table."""
    df, _, _ = table
    sc, jobs = df.sparkSession.sparkContext, []
    for rounds in (2, 6):
        sc.setJobGroup(f"rounds-{rounds}", "boosted trees")
        fit_boosted(df, "churned", settings=replace(SMALL, rounds=rounds))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 4 * SMALL.depth


def test_a_model_does_not_depend_on_partitions(table):
    df, _, _ = table
    models = [fit_boosted(materialize(df.repartition(n)), "churned", settings=SMALL)[0] for n in (1, 7)]
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for a, b in zip(*(m.trees for m in models)) for k in ("feature", "bin", "leaf"))


def test_one_class_or_one_value(spark):
    df = spark.createDataFrame([([1.0, float(i)], 1) for i in range(9)], "x array<double>, churned int")
    df = materialize(df.select(array_to_vector("x").alias("features"), "churned"))
    out = fit_boosted(df, "churned", settings=SMALL)[0].transform(df).collect()
    assert all(r["positive"] > 0.5 for r in out)


@pytest.mark.parametrize("folds", [2, 3, 5])
def test_folds_hold_each_class_evenly(spark, folds):
    label = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 < 4, 1).otherwise(0)
    df = materialize(spark.range(1003).select(F.col("id").alias(CUSTOMER), label.alias("churned")).repartition(6))
    rows = churn_models.with_folds(df, folds=folds).collect()
    assert len(rows) == 1003
    counts = Counter((r["churned"], r["fold"]) for r in rows)
    for value in (None, 0, 1):
        of = [counts[value, i] for i in range(folds)]
        assert max(of) - min(of) <= 1 and sum(of) == sum(n for (v, _), n in counts.items() if v == value)
    again = churn_models.with_folds(materialize(df.repartition(2)), folds=folds).collect()
    assert {r[CUSTOMER]: r["fold"] for r in rows} == {r[CUSTOMER]: r["fold"] for r in again}
