from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import by_key, rows_of
from marketlens.operators import churn, metrics

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "actual int, predicted int, probability double"


@SLOW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8)), min_size=2, max_size=40))
def test_curves_equal_their_definitions(spark, rows):
    df = spark.createDataFrame([(y, int(s >= 4), s / 8) for y, s in rows], SCHEMA).repartition(3)
    pos = [s / 8 for y, s in rows if y == 1]
    neg = [s / 8 for y, s in rows if y == 0]
    area = metrics.auc(df).first()["auc"]
    if not pos or not neg:
        assert area is None
        return
    assert area == pytest.approx(np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg]))
    roc = by_key(metrics.roc(df), "threshold")
    pr = by_key(metrics.pr_curve(df), "threshold")
    assert (roc[None]["fpr"], roc[None]["tpr"]) == (0.0, 0.0) and (pr[None]["precision"], pr[None]["recall"]) == (1.0, 0.0)
    for t in {s / 8 for _, s in rows}:
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        assert (roc[t]["fpr"], roc[t]["tpr"]) == (fp / len(neg), tp / len(pos))
        assert (pr[t]["precision"], pr[t]["recall"]) == (tp / (tp + fp), tp / len(pos))


def test_report(make):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2
    df = make(rows, "actual int, predicted int")
    assert rows_of(metrics.confusion(df)) == [(0, 0, 4), (0, 1, 2), (1, 0, 1), (1, 1, 3)]
    got = by_key(metrics.class_report(df), "class")
    assert got["1"] == {"class": "1", "precision": 0.6, "recall": 0.75, "f1_score": pytest.approx(2 / 3), "support": 4}
    assert got["0"]["precision"] == 0.8 and got["0"]["support"] == 6
    assert got["accuracy"]["f1_score"] == 0.7
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 4 / 6) / 2)
    assert got["weighted avg"]["precision"] == pytest.approx(0.6 * 0.4 + 0.8 * 0.6)


def test_report_of_a_class_never_predicted(make):
    got = by_key(metrics.class_report(make([(1, 0), (0, 0)], "actual int, predicted int")), "class")
    assert got["1"]["precision"] == 0.0 and got["1"]["f1_score"] == 0.0


def test_class_weights(make):
    got = by_key(churn.class_weights(make([(1,)] * 3 + [(0,)], "churned int")), "churned")
    assert got[1]["balanced_weight"] == pytest.approx(4 / 6) and got[0]["balanced_weight"] == 2.0
    assert got[1]["pos_weight"] == pytest.approx(1 / 3) and got[0]["pos_weight"] == 1.0
