"""A customer state answers like the fact it was made of, and merges."""

from __future__ import annotations

from datetime import datetime

import pytest

from helpers import rows_of
from marketlens.functions.columns import CUSTOMER
from marketlens.functions.staging import materialize
from marketlens.operators import churn, cltv, rfm
from marketlens.operators.customer_state import customer_state, merge_states, split_state

DAYS = 10

#: Busy months, a purchase without a time, one without a payment, purchases at the cutoff to the second.
ROWS = [
    ("o1", "u1", "2018-01-01 23:00:00", 10.5),
    ("o1", "u1", "2018-01-01 23:00:00", 2.25),
    ("o2", "u1", "2018-01-31 23:59:59", 7.0),
    ("o3", "u1", "2018-02-01 00:00:00", None),
    ("o4", "u2", "2018-02-18 11:59:59", 1.1),
    ("o5", "u2", "2018-02-18 12:00:00", 2.2),
    ("o6", "u2", "2018-02-18 12:00:01", 3.3),
    ("o7", "u3", "2018-02-28 12:00:00", 5.0),
    ("o8", "u3", None, 4.0),
    ("o9", None, "2018-01-05 00:00:00", 9.0),
    ("o10", "u4", "2018-02-18 13:00:00", 8.0),
    ("o11", "u5", "2017-12-31 00:00:00", 8.0),
]
QUESTIONS = {
    "rfm_base": rfm.rfm_base,
    "rfm_base_orders": lambda f: rfm.rfm_base(f, "orders"),
    "cltv_basic": cltv.cltv_basic,
    "rft_summary": cltv.rft_summary,
    "cohort_summary": cltv.cohort_summary,
    "last_purchase": churn.last_purchase,
    "inactive": lambda f: churn.churn_label(f, "inactive", DAYS),
    "customer_features": churn.customer_features,
    "months": lambda f: rfm.segment_orders_by_month(f, rfm.customer_group(rfm.rfm_scores(rfm.rfm_base(f)))),
}


@pytest.fixture(params=["plain", "collapsed"])
def fact(make, request):
    rows = [(o, u, None if t is None else datetime.fromisoformat(t), p) for o, u, t, p in ROWS]
    names = "order_id string, customer_unique_id string, order_purchase_timestamp timestamp, payment_value double"
    if request.param == "plain":
        return make(rows, names)
    return make([(*r, i % 3 + 1) for i, r in enumerate(rows)], f"{names}, fact_rows bigint")


@pytest.mark.parametrize("name", QUESTIONS)
def test_a_state_answers_like_its_fact(fact, name):
    # the last day of the fact is known to customers of a name only
    known = fact.where(f"{CUSTOMER} IS NOT NULL")
    assert rows_of(QUESTIONS[name](materialize(customer_state(known)))) == rows_of(QUESTIONS[name](known))


def test_a_split_state_answers_the_holdout_question(fact):
    state = materialize(customer_state(fact))
    got = rows_of(churn.churn_features(split_state(state, fact, DAYS), DAYS))
    assert got == rows_of(churn.churn_features(fact, DAYS))
    assert {r[0]: r[-1] for r in got} == {"u1": 1, "u2": 0, "u5": 1}


def test_new_months_merge_in(fact):
    old, new = fact.where("order_purchase_timestamp < '2018-02-01'"), fact.where("NOT coalesce(order_purchase_timestamp < '2018-02-01', false)")
    merged = merge_states(customer_state(old), customer_state(new))
    assert rows_of(merged) == rows_of(customer_state(fact).select(*merged.columns))
    assert merged.dtypes == customer_state(fact).dtypes


def test_an_empty_fact(fact):
    state = customer_state(fact.where("false"))
    assert split_state(state, fact, DAYS).count() == 0
    assert rfm.rfm_base(state).count() == 0
