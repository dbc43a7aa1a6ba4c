"""Exact scatter, polynomial, roots and components against plain computations."""

from __future__ import annotations

from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import whitening

SMALL = "/root/testdata/sf0.001"


def table(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").repartition(3)


def exact_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in fractions."""
    d = len(matrix)
    m = [[Fraction(0)] * d for _ in range(d)]
    c = [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(sum(matrix[i][l] * m[l][i] for l in range(d)) for i in range(d)) / k
    return [int(v) for v in c]


@pytest.mark.parametrize("top", [1, 5, 1 << 18, 1 << 30, 1 << 52])
def test_products_are_exact(top):
    x = np.random.default_rng(1).integers(-top, top + 1, (5000, 3))
    want = [[sum(a * b for a, b in zip(x[:, i].tolist(), x[:, j].tolist())) for j in range(3)] for i in range(3)]
    assert whitening.products(x).tolist() == want
    ones = np.full((3, 2), -1)
    assert whitening.products(ones).tolist() == [[3, 3], [3, 3]]


@pytest.mark.parametrize("rank", [1, 3, 7])
def test_polynomial_is_exact(spark, rank):
    x = np.random.default_rng(rank).integers(-1000, 1000, (rank, 7)).astype(object)
    matrix = (x.T @ x).tolist()
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_hessenberg_without_pivots(spark):
    matrix = np.diag([3, 0, 5, 3, 1]).astype(object).tolist()
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_primes():
    found = whitening.primes(30)
    assert found[:3] == [2147483647, 2147483629, 2147483587]
    assert all(all(p % q for q in range(2, 47_000)) for p in found[:5])


@pytest.mark.parametrize("roots", [[9, 7, 4, 1, 0, 0], [5, 5, 5, 2, 2, 1], [10**12 + 1, 10**12, 3, 1], [2, 2]])
def test_roots_and_multiplicities(roots):
    c = [1]
    for r in roots:  # times (x - r)
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    found = whitening.RealRoots(c).largest(len(roots), 40)
    want = {r: roots.count(r) for r in sorted(roots, reverse=True) if r}
    assert [m for _, m in found] == list(want.values())
    assert all(abs(v / 2**40 - r) < 1e-9 for (v, _), r in zip(found, want))


def test_null_vectors_of_close_and_multiple_roots():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    whole = np.round(q * 2**20).astype(object).astype(int).astype(object)
    matrix = (whole @ np.diag([9, 9, 4, 3, 2, 1]).astype(object) @ whole.T).tolist()
    with localcontext(Context(prec=60)):
        e = np.linalg.eigvalsh(np.array(matrix, float))[-3]
        v = np.array(whitening.null_vectors(matrix, Decimal(e), 1))
    assert abs(np.array(matrix, float) @ v[0] - e * v[0]).max() < 1e-8 * e
    twice = [[2, 0, 0], [0, 2, 0], [0, 0, 1]]
    pair = np.array(whitening.null_vectors(twice, Decimal(2), 2))
    assert np.allclose(pair @ pair.T, np.eye(2)) and np.allclose(pair[:, 2], 0)


def plain(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 1024) + 100_000
    n = len(x)
    cov = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    values, v = np.linalg.eigh(cov)
    order = np.argsort(-values)
    keep = [i for i in order if values[i] > 1e-9 * values[order[0]]][:8]
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    return n, far, (x - x.mean(axis=0)) @ v[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(cov)


def check(df, vectors, ids):
    n, far, white, explained = plain(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert len(rows) == len(ids) * len(explained)
    for c in range(len(explained)):
        got = np.array([rows[i, c + 1]["whitened"] for i in ids])
        assert min(abs(got - white[:, c]).max(), abs(got + white[:, c]).max()) < 1e-6
        for i, f in zip(ids, far):
            r = rows[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, f)
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_equals_plain_numpy(spark):
    docs = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = docs.collect()
    check(whitening.whitened_components(docs), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_awkward_vectors(spark):
    good = np.random.default_rng(2).standard_normal((40, 3)).round(3).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    clash = table(spark, [*good, *bad]).withColumns({"component": F.lit("x"), "n": F.lit("y"), "whitened": F.lit("z")})
    check(whitening.whitened_components(clash), good, range(40))


def test_large_entries_and_few_vectors(spark):
    huge = [[3e38, 1.0], [-3e38, 2.0], [1e9, 3.0]]
    rows = whitening.whitened_components(table(spark, huge)).collect()
    assert {r["component"] for r in rows} == {1, 2} and all(r["deviation"] is None for r in rows)
    assert all(r["identity_error"] < 1e-6 for r in rows)
    two = whitening.whitened_components(table(spark, [[1.0, 2.0, 3.0], [2.0, 1.0, 0.0]])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(0, 1, 1.0), (1, 1, 1.0)]


def test_equal_vectors_repeated_ids_and_none(spark):
    assert whitening.whitened_components(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whitened_components(table(spark, [None, None])).count() == 0
    assert whitening.whitened_components(table(spark, [[1.0]]).where("false")).count() == 0
    again = table(spark, [[1.0, 5.0], [2.0, 4.0], [4.0, 4.5]]).withColumn("vec_id", F.lit(7).cast("bigint"))
    assert whitening.whitened_components(again).groupBy("vec_id", "component").count().where("count = 3").count() == 2


def test_multiple_eigenvalue_still_whitens(spark):
    cross = [[a, 0.0] for a in (-1.0, 1.0)] + [[0.0, a] for a in (-1.0, 1.0)]
    rows = whitening.whitened_components(table(spark, cross)).collect()
    assert len(rows) == 8 and all(r["identity_error"] < 1e-9 and abs(r["explained"] - 0.5) < 1e-12 for r in rows)
