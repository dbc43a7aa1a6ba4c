"""Fitted models: planted structure is found, and metrics beat the baseline."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import by_key, rows_of
from marketlens.functions.columns import CUSTOMER
from marketlens.functions.staging import materialize
from marketlens.operators import certificates, churn_models, clusters, metrics, timeseries
from marketlens.operators import lifetime_model as lm


def test_log_gamma():
    x = np.array([1e-3, 0.5, 1.0, 2.5, 9.99, 10.0, 170.3, 1e6])
    assert lm._log_gamma(x) == pytest.approx([lgamma(v) for v in x], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("params", [(0.7, 8.0, 0.6, 12.0), (1.3, 15.0, 1.0, 4.0), (0.3, 2.0, 2.5, 2.0)])
def test_likelihood_sums_to_one_over_histories(params):
    """P(no repeat) + the density of the last repeat over all x and times is 1."""
    r, alpha, s, beta = params
    horizon = 5.0
    nodes, weights = np.polynomial.legendre.leggauss(60)
    tx = (nodes + 1) / 2 * horizon
    total = np.exp(lm.pareto_nbd_loglik(np.array([0.0]), np.array([0.0]), np.array([horizon]), params))[0]
    for x in range(1, 60):
        # purchases before the last one fall anywhere: tx^(x-1) / (x-1)!
        ll = lm.pareto_nbd_loglik(np.full(60, float(x)), tx, np.full(60, horizon), params)
        total += np.sum(weights * horizon / 2 * np.exp(ll + (x - 1) * np.log(tx) - lgamma(x)))
    assert total == pytest.approx(1.0, abs=1e-6)


def test_likelihood_of_long_histories_is_finite():
    x = np.array([0.0, 3.0, 400.0, 20000.0])
    ll = lm.pareto_nbd_loglik(x, np.array([0.0, 9.0, 9.9, 10.0]), np.full(4, 10.0), (0.5, 0.01, 0.2, 30.0))
    assert np.isfinite(ll).all()


def simulate(n, params, horizon, seed):
    r, alpha, s, beta = params
    rng = np.random.default_rng(seed)
    rate, life = rng.gamma(r, 1 / alpha, n), rng.exponential(1 / rng.gamma(s, 1 / beta, n))
    rows = []
    for i in range(n):
        end = min(life[i], horizon)
        k = rng.poisson(rate[i] * end)
        rows.append((i, int(k), float(rng.uniform(0, end, k).max()) if k else 0.0, float(horizon)))
    return rows


def test_pareto_nbd_recovers_planted_parameters(spark):
    planted = (0.8, 10.0, 0.7, 15.0)
    rows = simulate(6000, planted, 60, 11)
    df = spark.createDataFrame(rows, f"{CUSTOMER} bigint, frequency bigint, recency double, T double")
    got = lm.fit_pareto_nbd(df, penalizer=0.0)
    assert got.converged
    assert got["r"] / got["alpha"] == pytest.approx(planted[0] / planted[1], rel=0.15)
    assert got["s"] / got["beta"] == pytest.approx(planted[2] / planted[3], rel=0.4)
    # no worse than the truth on its own data
    x, tx, t = (np.array([row[i] for row in rows], dtype=float) for i in (1, 2, 3))
    fitted = lm.pareto_nbd_loglik(x, tx, t, tuple(got.values())).mean()
    assert fitted >= lm.pareto_nbd_loglik(x, tx, t, planted).mean() - 1e-6
    # expected purchases: monotone in frequency and recency, close in total
    assert np.all(np.diff(lm.expected_purchases(np.arange(1.0, 9.0), np.full(8, 50.0), np.full(8, 60.0), 30, tuple(got.values()))) > 0)
    assert np.all(np.diff(lm.expected_purchases(np.full(5, 3.0), np.linspace(20, 60, 5), np.full(5, 60.0), 30, tuple(got.values()))) > 0)
    longer = {row[0]: row[1] for row in simulate(6000, planted, 60, 11)}
    assert len(longer) == 6000


def test_expected_purchases_match_simulation():
    """Customers seen for 40 days, counted again over the next 20."""
    params, rng = (0.9, 6.0, 0.8, 20.0), np.random.default_rng(2)
    n = 40000
    r, alpha, s, beta = params
    rate, life = rng.gamma(r, 1 / alpha, n), rng.exponential(1 / rng.gamma(s, 1 / beta, n))
    x = rng.poisson(rate * np.minimum(life, 40)).astype(float)
    span = np.minimum(life, 40)
    tx = np.where(x > 0, span * rng.random(n) ** (1 / np.maximum(x, 1)), 0.0)
    later = rng.poisson(rate * np.clip(life - 40, 0, 20))
    expected = lm.expected_purchases(x, tx, np.full(n, 40.0), 20.0, params)
    assert expected.sum() == pytest.approx(later.sum(), rel=0.03)
    busy = x >= 5
    assert expected[busy].sum() == pytest.approx(later[busy].sum(), rel=0.05)


def test_gamma_gamma_recovers_planted_parameters(spark):
    p, q, v = 6.0, 4.0, 15.0
    rng = np.random.default_rng(4)
    n = 8000
    x = rng.integers(1, 12, n)
    nu = rng.gamma(q, 1 / v, n)
    m = rng.gamma(p * x, 1 / (nu * x))
    df = spark.createDataFrame(list(zip(range(n), x.tolist(), m.tolist())), f"{CUSTOMER} bigint, frequency bigint, monetary_value double")
    got = lm.fit_gamma_gamma(df, penalizer=0.0)
    assert got.converged
    assert got["p"] * got["v"] / (got["q"] - 1) == pytest.approx(p * v / (q - 1), rel=0.1)
    assert got["q"] == pytest.approx(q, rel=0.25)
    pulled = lm.predict_value(df, got).toPandas()
    mean = got["p"] * got["v"] / (got["q"] - 1)
    assert ((pulled["predicted_avg_value"] - mean).abs() <= (pulled["monetary_value"] - mean).abs() + 1e-9).all()


def test_fit_does_not_depend_on_partitions(spark):
    rows = simulate(800, (0.8, 10.0, 0.7, 15.0), 60, 3)
    schema = f"{CUSTOMER} bigint, frequency bigint, recency double, T double"
    a = lm.fit_pareto_nbd(spark.createDataFrame(rows, schema).repartition(1))
    b = lm.fit_pareto_nbd(spark.createDataFrame(rows, schema).repartition(7))
    assert list(a.values()) == pytest.approx(list(b.values()), rel=1e-3)


def test_a_search_that_cannot_go_on_says_so():
    _, converged, _ = lm._minimize(lambda sets: np.full(len(sets), np.inf), np.array([1.0, 1.0]))
    assert not converged
    _, converged, steps = lm._minimize(lambda sets: (np.log(sets) ** 2).sum(axis=1), np.array([3.0, 0.2]))
    assert converged and steps < 60


# churn models

FEATURES = ("f1", "f2")


@pytest.fixture(scope="module")
def churned(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 2))
    y = (x[:, 0] + 0.4 * rng.normal(size=900) > 0.5).astype(int)
    rows = [(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"{CUSTOMER} bigint, f1 double, f2 double, churned int")
    data = materialize(churn_models.with_vector(df, FEATURES))
    from marketlens.operators.churn import split

    return (data, *split(data))


@pytest.mark.parametrize(
    "train_model",
    [
        lambda df: churn_models.train_rf(df, trees=20),
        lambda df: churn_models.train_rf(df, trees=5, depth=10, balanced=False),
        churn_models.train_lr,
        lambda df: churn_models.train_gbt(df, rounds=5, depth=3),
    ],
    ids=["forest", "deep forest", "logistic", "boosted"],
)
def test_models_beat_the_baseline(churned, train_model):
    _, train, test = churned
    scored = materialize(churn_models.score(train_model(train), test))
    baseline = churn_models.dummy_baseline(train, test).first()["baseline_accuracy"]
    assert by_key(metrics.class_report(scored), "class")["accuracy"]["f1_score"] > baseline + 0.1
    assert metrics.auc(scored).first()["auc"] > 0.85
    assert scored.count() == test.count() and set(r["predicted"] for r in scored.select("predicted").collect()) == {0, 1}


def test_validation_importance_and_comparison(churned):
    data, train, test = churned
    folds = churn_models.cross_val(churn_models.train_lr, data, 3)
    assert len(folds) == 3 and min(folds) > 0.7
    forest = churn_models.train_rf(train, trees=20)
    top = churn_models.importances(forest, FEATURES).collect()
    assert top[0]["feature"] == "f1" and sum(r["importance"] for r in top) == pytest.approx(1.0)
    results = [
        churn_models.ModelResult(name, materialize(churn_models.score(model, test)), cv)
        for name, model, cv in (("forest", forest, 0.5), ("logistic", churn_models.train_lr(train), np.mean(folds)))
    ]
    table = churn_models.compare_models([churn_models.ModelResult(r.name, r.scored, float(r.cross_val)) for r in results]).collect()
    assert {r["model"] for r in table} == {"forest", "logistic"}
    assert table[0]["f1_score"] >= table[1]["f1_score"]


def test_weights(make):
    df = make([(1, 1)] * 6 + [(2, 0)] * 2, "k int, churned int")
    assert set(rows_of(churn_models.with_weight(df).select("churned", "weight"))) == {(1, 8 / 12), (0, 2.0)}
    assert set(rows_of(churn_models.with_weight(df, "positive").select("churned", "weight"))) == {(1, 2 / 6), (0, 1.0)}
    with pytest.raises(ValueError):
        churn_models.with_weight(df, "none")


# clusters


def test_clusters_find_planted_groups(spark):
    rng = np.random.default_rng(6)
    centers = [(0, 0, 10.0), (20, 0, 500.0), (0, 30, 90.0)]
    rows = [(i, *(float(v) for v in rng.normal(centers[i % 3], 0.5))) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double, total_revenue double")
    got = by_key(clusters.geo_clusters(df, 3), "id")
    groups = [{got[i]["cluster"] for i in range(g, 150, 3)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    # ids ascend with the first coordinate
    assert groups[1] == {2}


def test_standardize_and_pca(make):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) @ np.diag([5, 1, 1, 1]) + 3
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    df = materialize(make([(i, *(float(v) for v in row)) for i, row in enumerate(x)], "id bigint, " + ", ".join(f"{c} double" for c in clusters.CUSTOMER_FEATURES)))
    std = clusters.standardize(df, clusters.CUSTOMER_FEATURES).toPandas()[[f"{c}_std" for c in clusters.CUSTOMER_FEATURES]]
    assert np.allclose(std.mean(), 0) and np.allclose(std.std(ddof=0), 1)
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    got = clusters.pca2(df).orderBy("id").toPandas()
    for k, name in enumerate(("pca1", "pca2")):
        want = z @ vt[k]
        assert min(np.abs(got[name] - want).max(), np.abs(got[name] + want).max()) < 1e-6


def test_cluster_names(make):
    rows = [(0, 9, 10, 50.0, 300), (1, 1, 400, 20.0, 0), (2, 1, 5, 10.0, 1), (3, 1, 30, 500.0, 2), (4, 3, 100, 10.0, 20)]
    df = make(rows, "cluster int, num_orders bigint, recency_days int, avg_order_value double, purchase_span_days int")
    got = {r["cluster"]: r["segment"] for r in clusters.label_clusters(df).collect()}
    assert got == {0: "Occasional Buyers", 1: "Inactive Customers", 2: "New Customers", 3: "High Value Buyers", 4: "Occasional Buyers"}
    loyal = make(rows[:1] + [(1, 1, 400, 20.0, 0)], df.schema)
    assert {r["cluster"]: r["segment"] for r in clusters.label_clusters(loyal).collect()}[0] == "Loyal Customers"


# forecasts


def test_forecast_follows_trend_and_season(spark):
    months = pd.date_range("2012-01-01", periods=72, freq="MS")
    rows = []
    for key, slope in (("a", 3.0), ("b", -1.0)):
        for i, day in enumerate(months):
            rows.append((key, day.date(), 500 + slope * i + 40 * np.sin(2 * np.pi * day.dayofyear / 365.25)))
    df = spark.createDataFrame([(k, d, float(y)) for k, d, y in rows], "k string, ds date, y double").repartition(4)
    got = timeseries.forecast(df, ["k"]).toPandas()
    assert len(got) == 2 * 78
    future = got[got["is_future"]].sort_values(["k", "ds"])
    assert [str(d) for d in future[future["k"] == "a"]["ds"]] == [
        "2017-12-31", "2018-01-31", "2018-02-28", "2018-03-31", "2018-04-30", "2018-05-31",
    ]
    for row in future.itertuples():
        days = (pd.Timestamp(row.ds) - pd.Timestamp("2012-01-01")).days / 30.4375
        want = 500 + (3.0 if row.k == "a" else -1.0) * days + 40 * np.sin(2 * np.pi * pd.Timestamp(row.ds).dayofyear / 365.25)
        assert row.yhat == pytest.approx(want, abs=15)
        assert row.yhat_lower <= row.yhat <= row.yhat_upper


@pytest.mark.parametrize("n", [1, 2, 5, 11])
def test_short_series_still_forecast(n):
    ds = pd.Series(pd.date_range("2018-01-01", periods=n, freq="MS"))
    out = timeseries.fit_series(ds, np.full(n, 7.0), 6)
    assert len(out) == n + 6 and np.isfinite(out["yhat"]).all()
    assert out["yhat"].iloc[-1] == pytest.approx(7.0, rel=0.05)


def _path(rng, months, bend, noise):
    """A trend that bends at random, a yearly wave and noise, on month-ends."""
    days = pd.date_range("2008-01-31", periods=months, freq="ME")
    slopes = 1.0 + np.cumsum(rng.normal(0, bend, months) * (rng.random(months) < 0.1))
    season = 5 * np.sin(2 * np.pi * days.dayofyear.to_numpy() / 365.25)
    return pd.Series(days), 100 + np.cumsum(slopes) + season + rng.normal(0, noise, months)


@pytest.mark.parametrize("months, bend", [(40, 0.0), (72, 0.3), (96, 0.6)])
def test_bands_hold_what_comes(months, bend):
    """80 % bands over simulated series, six months ahead."""
    rng, held = np.random.default_rng(months), []
    for _ in range(150):
        ds, y = _path(rng, months + 6, bend, 3.0)
        out = timeseries.fit_series(ds[:months], y[:months], 6)[months:]
        held.append((out["yhat_lower"].to_numpy() <= y[months:]) & (y[months:] <= out["yhat_upper"].to_numpy()))
    assert 0.68 <= np.mean(held) <= 0.93


def test_bands_grow_with_the_horizon_and_with_past_bends():
    rng = np.random.default_rng(4)
    ds, y = _path(rng, 96, 0.0, 3.0)
    bent = y + np.where(np.arange(96) > 40, 4.0 * (np.arange(96) - 40), 0) - np.where(np.arange(96) > 60, 8.0 * (np.arange(96) - 60), 0)
    calm, wild = (timeseries.fit_series(ds, v, 36) for v in (y, bent))
    for out in (calm, wild):
        width = (out["yhat_upper"] - out["yhat_lower"]).to_numpy()[96:]
        assert width[0] < width[11] < width[23] < width[35]
    grown = [(o["yhat_upper"] - o["yhat_lower"]).to_numpy()[[96, 131]] for o in (calm, wild)]
    assert grown[1][1] / grown[1][0] > grown[0][1] / grown[0][0]


@pytest.mark.parametrize("n", [13, 14, 15, 16])
def test_one_more_month_does_not_change_the_kind_of_model(n):
    """A yearly wave shows in the fit on either side of a year and of 14 points."""
    ds, y = _path(np.random.default_rng(n), n, 0.0, 0.1)
    flat = timeseries.fit_series(ds, y, 1)["yhat"][:n] - np.poly1d(np.polyfit(np.arange(n), y, 1))(np.arange(n))
    assert np.abs(flat).max() > 1.0


def test_forecast_error_and_rolling_mean(make):
    actual = make([(1, 10.0), (2, 0.0), (3, 20.0)], "ds int, y double")
    fc = make([(1, 11.0), (2, 2.0), (3, 18.0), (4, 5.0)], "ds int, yhat double")
    row = timeseries.forecast_error(actual, fc).first()
    assert (row["mae"], row["rmse"], row["mape"]) == (pytest.approx(5 / 3), pytest.approx(3**0.5), pytest.approx(10.0))
    rolled = timeseries.rolling_mean(actual, "ds", "y").orderBy("ds").collect()
    assert [r["rolling_3mo"] for r in rolled] == [None, None, 10.0]


def test_series_of_the_certificate_are_added_up_once_for_equal_histories(spark, monkeypatch):
    """A series of 600 terms for every customer took longer than the fit."""
    histories = [(2, 30, 300), (2, 200, 300), (5, 200, 365), (9, 300, 320)]
    rows = [(*histories[i % 4],) for i in range(400)]
    df = materialize(spark.createDataFrame(rows, "frequency bigint, recency int, T int"))
    written, kept = {}, certificates.materialize
    monkeypatch.setattr(certificates, "materialize", lambda t, label: written.setdefault(label, kept(t, label)))
    x, scale = F.col("frequency").cast("double"), 10.0 / 365
    params = {"r": 0.6, "alpha": 0.5, "s": 0.4, "beta": 0.9}
    plain = certificates.slopes(df, lambda p: certificates.pareto_nbd_loglik(x, F.col("recency") * scale, F.col("T") * scale, p), params, 1.0)
    folded = certificates.pareto_nbd_slopes(df, params, scale, 1.0)
    assert written["histories"].count() == 4 and written["series"].count() == 7
    verdicts = [{r["parameter"]: r["at_rest"] for r in t.collect()} for t in (plain, folded)]
    assert verdicts[0] == verdicts[1]
    # the likelihoods behind the verdicts
    moved = [p * 1.001 for p in params.values()]
    of_rows = df.agg(F.avg(certificates.pareto_nbd_loglik(x, F.col("recency") * scale, F.col("T") * scale, moved))).first()[0]
    tx, t = (df.toPandas()[c].to_numpy(float) * scale for c in ("recency", "T"))
    assert of_rows == pytest.approx(lm.pareto_nbd_loglik(df.toPandas()["frequency"].to_numpy(float), tx, t, moved).mean(), rel=1e-6)
