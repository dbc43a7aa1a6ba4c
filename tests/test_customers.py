"""Scores, segments and quantile cuts of customer tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import by_key, rows_of
from marketlens.functions.columns import CUSTOMER
from marketlens.functions.staging import materialize
from marketlens.operators import churn, cltv, profile, rfm

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
RFM = f"{CUSTOMER} bigint, Recency int, Frequency bigint, Monetary double"


def score_of(value, edges, labels):
    for edge, label in zip(edges, labels):
        if value <= edge:
            return label
    return labels[-1]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6), st.integers(0, 500)), min_size=1, max_size=60))
def test_scores_follow_the_quartiles(spark, rows):
    df = spark.createDataFrame([(i, r, f, float(m)) for i, (r, f, m) in enumerate(rows)], RFM)
    got = by_key(rfm.rfm_scores(df), CUSTOMER)
    q = np.quantile(np.array(rows, dtype=float), [0.25, 0.5, 0.75], axis=0)
    for i, (r, f, m) in enumerate(rows):
        assert got[i]["R"] == score_of(r, q[:, 0], (4, 3, 2, 1))
        assert got[i]["F"] == score_of(f, q[:, 1], (1, 2, 3, 4))
        assert got[i]["M"] == score_of(m, q[:, 2], (1, 2, 3, 4))
        assert got[i]["RFM_Score"] == f"{got[i]['R']}{got[i]['F']}{got[i]['M']}"


def test_equal_values_and_a_single_customer(make):
    same = rfm.rfm_scores(make([(i, 5, 2, 9.0) for i in range(6)], RFM))
    assert {(r["R"], r["F"], r["M"]) for r in same.collect()} == {(4, 1, 1)}
    single = rfm.rfm_quartiles(make([(1, 5, 2, 9.0)], RFM))
    assert rows_of(single.select("R_Quartile", "F_Quartile", "M_Quartile")) == [(1, 1, 1)]


SCORES = [(4, 4, 4), (3, 3, 1), (4, 1, 1), (1, 4, 2), (1, 1, 4), (3, 1, 1), (2, 2, 2), (4, 3, 2), (4, 4, 3)]


@pytest.fixture(scope="module")
def scored(make):
    rows = [(i, *s, "".join(map(str, s))) for i, s in enumerate(SCORES)]
    return make(rows, f"{CUSTOMER} bigint, R int, F int, M int, RFM_Score string")


def test_groups_by_both_rules(scored):
    by_all = [r["CustomerGroup"] for r in rfm.customer_group(scored).orderBy(CUSTOMER).collect()]
    assert by_all == [f"{g}-value" for g in ("High", "Low", "Low", "Low", "Low", "Low", "Medium", "Medium", "High")]
    by_code = [r["CustomerGroup"] for r in rfm.customer_group(scored, "code").orderBy(CUSTOMER).collect()]
    assert by_code == [f"{g}-value" for g in ("High", "Medium", "Medium", "Low", "Low", "Medium", "Medium", "Medium", "Medium")]
    with pytest.raises(ValueError):
        rfm.customer_group(scored, "sum")


def test_segments_by_both_precedences(scored):
    first = [r["BehaviorSegment"] for r in rfm.behavior_segment(scored).orderBy(CUSTOMER).collect()]
    assert first == [
        "Champions", "Loyal Customers", "Recent Customers", "Frequent Buyers", "Big Spenders", "Others", "Others",
        "Loyal Customers", "Loyal Customers",
    ]
    last = [r["BehaviorSegment"] for r in rfm.behavior_segment(scored, "last").orderBy(CUSTOMER).collect()]
    assert last == [
        "Big Spenders", "Loyal Customers", "Recent Customers", "Frequent Buyers", "Big Spenders", "Others", "Others",
        "Recent Customers", "Frequent Buyers",
    ]
    with pytest.raises(ValueError):
        rfm.behavior_segment(scored, "middle")


def test_matrix_fills_zeros(scored):
    got = by_key(rfm.score_matrix(scored, "R", "F"), "R")
    assert got[1] == {"R": 1, "F_1": 1, "F_2": 0, "F_3": 0, "F_4": 1}
    assert sum(sum(v for k, v in row.items() if k != "R") for row in got.values()) == len(SCORES)


@pytest.mark.parametrize("n", [4, 5, 7, 10, 37])
def test_quartiles_equal_pandas(make, n):
    rng = np.random.default_rng(n)
    rows = [(i, int(v), int(f), float(m)) for i, (v, f, m) in enumerate(zip(rng.permutation(n * 3)[:n], rng.integers(1, 4, n), rng.integers(0, 5, n)))]
    pdf = pd.DataFrame(rows, columns=[CUSTOMER, "Recency", "Frequency", "Monetary"])
    want = pd.DataFrame(
        {
            "R": pd.qcut(pdf["Recency"], 4, labels=False) + 1,
            "F": pd.qcut(pdf["Frequency"].rank(method="first", ascending=False), 4, labels=False) + 1,
            "M": pd.qcut(pdf["Monetary"].rank(method="first", ascending=False), 4, labels=False) + 1,
        }
    )
    got = rfm.rfm_quartiles(make(rows, RFM)).orderBy(CUSTOMER).toPandas()
    assert got["R_Quartile"].tolist() == want["R"].tolist()
    assert got["F_Quartile"].tolist() == want["F"].tolist()
    assert got["M_Quartile"].tolist() == want["M"].tolist()


def test_summary_rounds_and_counts(make):
    rows = [(1, 1, 1, 1.0, "A"), (2, 2, 2, 2.5, "A"), (3, 2, 3, 1.0, "A"), (4, 9, 9, 9.0, None)]
    df = make(rows, RFM + ", CustomerGroup string")
    assert rows_of(rfm.segment_summary(df)) == [("A", 1.67, 2.0, 1.5, 3)]


BASIC = f"{CUSTOMER} bigint, total_orders bigint, total_payment double, avg_order_value double, purchase_frequency double, cltv double"


def test_value_segments(make):
    rows = [(i, 1 + i % 3, 10.0 * i, 10.0 * i, 0.1, float(i)) for i in range(11)]
    got = by_key(cltv.segment_cltv(make(rows, BASIC)), CUSTOMER)
    assert [got[i]["normalized_cltv"] for i in range(11)] == pytest.approx([i / 10 for i in range(11)])
    assert [got[i]["CLTV_Segment"][:1] for i in range(11)] == list("LLLMMMMMMHH")
    frequency = sum(r[1] for r in rows) / 11
    assert got[4]["better_cltv"] == pytest.approx(40 * frequency * 12)
    assert [got[i][cltv.SEGMENT][:1] for i in range(11)] == list("LLLMMMMMMHH")
    assert got[10]["cltv_normalized"] == 1.0


def test_constant_value_scales_to_zero(make):
    rows = [(i, 1, 5.0, 5.0, 0.1, 2.0) for i in range(4)]
    got = cltv.segment_cltv(make(rows, BASIC)).collect()
    assert {(r["normalized_cltv"], r["cltv_normalized"], r[cltv.SEGMENT]) for r in got} == {(0.0, 0.0, "Low CLTV")}
    assert rows_of(cltv.minmax(make(rows, BASIC), "cltv", "x").select("x")) == [(0.0,)] * 4


def test_customers_without_payments_have_no_segment(make):
    rows = [(1, 1, 0.0, None, 0.5, None), (2, 1, 5.0, 5.0, 0.5, 2.5), (3, 1, 9.0, 9.0, 0.5, 4.5)]
    got = by_key(cltv.segment_cltv(make(rows, BASIC)), CUSTOMER)
    assert got[1][cltv.SEGMENT] is None and got[3][cltv.SEGMENT] == "High CLTV"


@SLOW
@given(st.lists(st.integers(0, 50), min_size=1, max_size=50))
def test_pareto_segments_equal_pandas(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{CUSTOMER} bigint, predicted_cltv double")
    got = by_key(cltv.pareto_segment(materialize(df)), CUSTOMER)
    pdf = pd.DataFrame({"v": values}).sort_values("v", ascending=False, kind="stable")
    share = pdf["v"].cumsum() / pdf["v"].sum()
    for i, s in share.items():
        if not np.isnan(s):
            assert got[i]["cum_cltv_perc"] == pytest.approx(s)
            assert got[i]["cltv_segment"] == ("High" if s <= 0.8 else "Mid" if s <= 0.95 else "Low")


def test_filter_of_the_model_input(make):
    rows = [(i, 2 + i % 2, 400, 500, float(i)) for i in range(1, 101)] + [(200, 1, 5, 5, 3.0), (201, 4, 5, 5, None), (202, 3, 1, 2, 0.0)]
    df = make(rows, f"{CUSTOMER} bigint, frequency bigint, recency int, T int, monetary_value double")
    kept = cltv.rft_filter(df)
    ids = {r[CUSTOMER] for r in kept.collect()}
    assert ids == set(range(1, 100))
    assert {(r["recency"], r["T"]) for r in kept.collect()} == {(365, 365)}
    loose = cltv.rft_filter(df, cap=None, positive=False)
    assert 202 in {r[CUSTOMER] for r in loose.collect()}
    b = by_key(cltv.bounds(kept), "column_name")
    assert b["monetary_value"]["min_value"] == 1.0 and b["monetary_value"]["max_value"] == 99.0 and b["T"]["null_count"] == 0


def test_histogram_and_box(make):
    df = materialize(make([("a", float(v)) for v in range(101)] + [("b", 1.0)], "g string, v double"))
    bins = by_key(cltv.histogram(df, "v"), "bin")
    assert len(bins) == 50 and bins[50]["count"] == 3 and sum(b["count"] for b in bins.values()) == 102
    box = by_key(cltv.box_stats(df, "g", "v"), "g")
    assert box["a"] == {
        "g": "a", "n": 101, "min": 0.0, "q1": 25.0, "median": 50.0, "q3": 75.0, "max": 100.0, "lower_fence": -50.0, "upper_fence": 150.0,
    }
    flat = cltv.histogram(make([(2.0,)] * 3, "v double"), "v").collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(1, 3)]


def test_regression_error(make):
    row = cltv.regression_error(make([(1.0, 2.0), (5.0, 2.0), (None, 1.0)], "y double, p double"), "y", "p").first()
    assert (row["mae"], row["rmse"]) == (2.0, pytest.approx(5**0.5))


def test_counts_and_crosstab(make):
    df = make([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("b", None)], "g string, h string")
    assert [tuple(r) for r in profile.value_counts(df, "g", "n").collect()] == [("a", 2), ("b", 2)]
    assert rows_of(profile.crosstab(df, "g", "h", ["x", "y", "z"])) == [("a", 1, 1, 0), ("b", 1, 0, 0)]


def test_label_codes_are_alphabetical(make):
    df = make([("Low CLTV",), ("High CLTV",), ("High CLTV",), ("Medium CLTV",), ("High CLTV",), (None,)], "s string")
    got = {r["s"]: r["c"] for r in churn.label_encode(df, "s", "c").collect()}
    assert got == {"High CLTV": 0, "Low CLTV": 1, "Medium CLTV": 2, None: None}


def test_correlations(make):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(50, 2))
    rows = [(float(a), float(a + b), 1.0) for a, b in data]
    got = by_key(churn.corr_matrix(make(rows, "a double, b double, c double"), ("a", "b", "c")), "row_name", "col_name")
    want = np.corrcoef(np.array(rows)[:, :2].T)
    assert got[("a", "b")]["corr"] == pytest.approx(want[0, 1]) == got[("b", "a")]["corr"]
    assert got[("a", "a")]["corr"] == pytest.approx(1.0) and got[("a", "c")]["corr"] is None
    gaps = [(None if i % 7 == 0 else a, b, float(i)) for i, (a, b, _) in enumerate(rows)]
    some = by_key(churn.corr_matrix(make(gaps, "a double, b double, c double"), ("a", "b", "c")), "row_name", "col_name")
    want = pd.DataFrame(gaps, columns=list("abc")).astype(float).corr()
    for x in "abc":
        for y in "abc":
            assert some[(x, y)]["corr"] == pytest.approx(want.loc[x, y])


def test_split_is_stable_and_whole(make):
    rows = [(i,) for i in range(2000)]
    parts = [churn.split(make(rows, f"{CUSTOMER} bigint", n)) for n in (1, 6)]
    (a, b), (c, d) = [tuple(map(rows_of, p)) for p in parts]
    assert a == c and b == d and sorted(a + b) == rows
    assert len(a) / 2000 == pytest.approx(0.8, abs=0.03)
