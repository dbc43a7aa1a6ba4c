from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from helpers import by_key, rows_of
from marketlens.functions.staging import materialize
from marketlens.operators import basket

SUPPORT = 0.025


@pytest.fixture(scope="module")
def orders():
    rng = np.random.default_rng(5)
    items = [f"i{k}" for k in range(8)]
    out = []
    for n in range(240):
        # i0 is in most baskets; a few baskets repeat exactly
        chosen = {i for k, i in enumerate(items) if rng.random() < (0.8 if k == 0 else 0.3)} if n % 3 else {"i0", "i1", "i2"}
        if len(chosen) > 1:
            out.append((f"o{n}", f"u{n % 50}", sorted(chosen), int(rng.integers(100, 10000))))
    return out


@pytest.fixture(scope="module")
def brute(orders):
    """Every itemset and every rule by counting."""
    sets = [frozenset(o[2]) for o in orders]
    n = len(sets)
    universe = sorted(set().union(*sets))
    freq = {}
    for size in range(1, len(universe) + 1):
        for combo in combinations(universe, size):
            count = sum(s.issuperset(combo) for s in sets)
            if count / n >= SUPPORT:
                freq[combo] = count
    rules = {}
    for combo, count in freq.items():
        for size in range(1, len(combo)):
            for left in combinations(combo, size):
                right = tuple(i for i in combo if i not in left)
                lift = (count / freq[left]) / (freq[right] / n)
                if lift >= 1.0:
                    revenue = sum(o[3] for o in orders if set(left) <= set(o[2])) / 100
                    rules[(left, right)] = (count / n, count / freq[left], lift, revenue)
    return freq, rules


@pytest.fixture(scope="module")
def mined(make, orders):
    b = materialize(make(orders, "order_id string, customer_unique_id string, items array<string>, revenue_cents bigint"))
    itemsets = materialize(basket.frequent_itemsets(b, SUPPORT))
    rules = materialize(basket.association_rules(itemsets, b.count()))
    return b, itemsets, materialize(basket.rule_revenue(rules, materialize(basket.basket_patterns(b))))


def test_itemsets_equal_brute_force(mined, brute):
    assert {tuple(r["items"]): r["freq"] for r in mined[1].collect()} == brute[0]
    assert max(len(k) for k in brute[0]) >= 4


def test_wide_baskets_give_the_same_itemsets(mined, brute, monkeypatch):
    monkeypatch.setattr(basket, "MOST_TRIPLES", 0)
    assert {tuple(r["items"]): r["freq"] for r in basket.frequent_itemsets(mined[0], SUPPORT).collect()} == brute[0]


def test_no_trees_are_grown_where_no_long_itemset_can_be(make, monkeypatch):
    """Conditional trees of baskets that share pairs only took most of the time."""
    monkeypatch.setattr(basket, "FPGrowth", None)
    rows = [(list(pair),) for pair in combinations("abcde", 2)] * 3 + [(["a", "b", "c"],)] * 5 + [(["x"],), (None,), ([],)]
    got = {tuple(r["items"]): r["freq"] for r in basket.frequent_itemsets(make(rows, "items array<string>"), 0.06).collect()}
    sets = [set(r[0] or ()) for r in rows]
    want = {c: sum(s.issuperset(c) for s in sets) for k in (1, 2, 3) for c in combinations("abcdex", k)}
    assert got == {c: n for c, n in want.items() if n >= 3}
    assert basket.frequent_itemsets(make([], "items array<string>")).count() == 0


def test_rules_and_revenue_equal_brute_force(mined, brute):
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in mined[2].collect()}
    assert set(got) == set(brute[1])
    for key, (support, confidence, lift, revenue) in brute[1].items():
        r = got[key]
        assert (r["support"], r["confidence"], r["lift"]) == (support, confidence, lift)
        assert r["estimated_revenue"] == pytest.approx(revenue)
        assert r["lift"] == pytest.approx(r["support"] / (r["antecedent_support"] * r["consequent_support"]))
        assert r["rule"] == ", ".join(key[0]) + " → " + ", ".join(key[1])


def test_containment_equals_brute_force(make, orders):
    sets = [["i0"], ["i1", "i2"], ["i3", "i4", "i5"], ["absent"], ["i0", "absent"], ["i1", "i2"]]
    b = make(orders, "order_id string, customer_unique_id string, items array<string>, revenue_cents bigint")
    got = rows_of(basket.containment_join(make([(s,) for s in sets], "set_items array<string>"), b).select("set_items", "order_id"))
    want = sorted((s, o[0]) for s in {tuple(s) for s in sets} for o in orders if set(s) <= set(o[2]))
    assert [(tuple(s), o) for s, o in got] == want


def test_few_baskets_meet_a_set_they_do_not_hold(make, monkeypatch):
    """One item is in every basket, and sets share their popular items."""
    rng = random.Random(9)
    rows = [(f"o{i}", sorted({"all", *(f"i{min(int(rng.paretovariate(1.1)), 30)}" for _ in range(5))})) for i in range(600)]
    b = make(rows, "order_id string, items array<string>")
    sets = {tuple(sorted(rng.sample(r[1], min(len(r[1]), 3)))) for r in rows}
    met, keep = [], basket.materialize
    monkeypatch.setattr(basket, "materialize", lambda df, label: (met.append(keep(df, label)), met[-1])[1] if label == "prefix_holders" else keep(df, label))
    got = basket.containment_join(make([(list(s),) for s in sets], "set_items array<string>"), b).select("set_items", "order_id").collect()
    want = {(s, o) for s in sets for o, items in rows if set(s) <= set(items)}
    assert {(tuple(r["set_items"]), r["order_id"]) for r in got} == want and len(got) == len(want)
    assert sum(m.count() for m in met) <= 2 * len(want)


def test_views_of_the_rules(mined):
    b, _, rules = mined
    top = basket.top_bundles(rules, 5).collect()
    assert [r["estimated_revenue"] for r in top] == sorted((r["estimated_revenue"] for r in rules.collect()), reverse=True)[:5]
    kept = basket.filter_rules(rules, 0.3, 1.05, 0.06)
    assert all(r["confidence"] >= 0.3 and r["lift"] >= 1.05 and r["support"] >= 0.06 for r in kept.collect())
    gain = basket.uplift(kept).collect()
    assert all(r["predicted_uplift_revenue"] == pytest.approx(r["estimated_revenue"] * (r["lift"] - 1)) for r in gain)
    one = rules.where("size(consequents) = 1 AND consequents[0] = 'i1'")
    assert {r["item"] for r in basket.dead_ends(b, one).collect()} == {f"i{k}" for k in range(8)} - {"i1"}
    edges = basket.rule_edges(rules)
    nodes = by_key(basket.rule_nodes(edges), "node")
    assert sum(v["out_degree"] for v in nodes.values()) == edges.count() == sum(v["in_degree"] for v in nodes.values())


def test_support_that_just_meets_the_limit_counts(make):
    b = make([(["a", "b"],)] * 13 + [(["c", "d"],)] * 12987, "items array<string>")
    assert {tuple(r["items"]): r["freq"] for r in basket.frequent_itemsets(b, 0.001).collect()}[("a", "b")] == 13


def test_items_are_cleaned(make):
    b = make([([" B", "b ", "A", None],)], "items array<string>")
    assert basket.clean_items(b).first()["items"] == ["a", "b"]


def test_an_itemset_too_long_to_split_is_an_error(make):
    items = [f"i{k:02}" for k in range(basket.LONGEST_SPLIT + 1)]
    itemsets = make([(items, 3), (items[:1], 3)], "items array<string>, freq bigint")
    with pytest.raises(Exception, match="too many splits"):
        basket.association_rules(itemsets, 3).collect()
