"""Whitening against plain linear algebra; exact polynomials, repeated and zero roots, odd rows."""

import random
from fractions import Fraction

import numpy as np
import pytest

from cohortlens.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, n string, explained string"


def plain_polynomial(a):
    """Faddeev and LeVerrier's recurrence in fractions."""
    d = len(a)
    a = np.array([[Fraction(int(v)) for v in row] for row in a], dtype=object)
    one = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], dtype=object)
    m, out = one, [Fraction(1)]
    for k in range(1, d + 1):
        am = a.dot(m)
        out.append(-sum(am[i, i] for i in range(d)) / k)
        m = am + out[-1] * one
    return [int(c) for c in out]


def plain(vectors, count=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (x - np.array([Fraction(int(v), n) for v in s], dtype=object)).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:count]
    return n, ((n * x - s) ** 2).sum(axis=1).tolist(), centred @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_equals_plain_linear_algebra(spark):
    r = np.random.default_rng(5)
    d = 12
    vectors = (r.normal(size=(300, d)) @ np.diag(np.linspace(0.05, 0.6, d))).astype(np.float32).tolist()
    vectors[7] = vectors[8]
    bad = [None, [], [0.1] * 11, [None, *[0.1] * 11], [float("nan"), *[0.1] * 11], [float("inf"), *[0.1] * 11], [1e30, *[0.1] * 11]]
    rows = [(None if k == 3 else k, v, 1, "n", "e") for k, v in enumerate(vectors)] + [(1000 + k, v, None, None, None) for k, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS).repartition(5))
    assert got.columns == ["vec_id", "embedding", "label", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, want, explained = plain(vectors)
    found = sorted(got.collect(), key=lambda q: 3 if q["vec_id"] is None else q["vec_id"])
    assert len(found) == len(vectors) and {q["n"] for q in found} == {n}
    assert [int(q["deviation"]) for q in found] == deviation
    w = np.array([q["whitened"] for q in found])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-9
    assert np.abs(np.array(found[0]["explained"]) / explained - 1).max() < 1e-9
    centred = w - w.mean(axis=0)
    assert abs(found[0]["identity_error"] - np.abs(centred.T @ centred / n - np.eye(8)).max()) < 1e-12 and found[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_polynomial_is_exact(spark, seed):
    r = random.Random(seed)
    b = np.array([[r.randint(-50, 50) if r.random() < 0.6 else 0 for _ in range(9)] for _ in range(7 + seed)], dtype=object)
    a = b.T.dot(b)
    assert whitening.characteristic_polynomial(spark, a) == plain_polynomial(a)


def test_modular_polynomials_of_any_matrix():
    r = random.Random(2)
    for d in (1, 2, 3, 6):
        a = np.array([[r.randint(-9, 9) * (r.random() < 0.5) for _ in range(d)] for _ in range(d)], dtype=object)
        assert whitening.polynomial_modulo(a, 2147483647) == [c % 2147483647 for c in plain_polynomial(a)]


def test_roots_that_are_repeated_close_or_zero():
    def poly(roots):
        out = [1]
        for x in roots:
            out = [p - x * q for p, q in zip([*out, 0], [0, *out])]
        return out

    places = whitening.PLACES
    exact = [(x << places, m) for x, m in ((900, 1), (899, 1), (7, 3), (5, 1), (0, 2))]
    assert whitening.largest_roots(poly([900, 899, 7, 7, 7, 5, 0, 0]), 8) == exact
    assert whitening.largest_roots(poly([900, 899, 7, 7, 7, 5, 0, 0]), 3) == exact[:3]
    assert whitening.largest_roots(poly([0, 0]), 8) == [(0, 2)]
    near = whitening.largest_roots([1, -(2 * 10**30 + 1), 10**30 * (10**30 + 1)], 2)  # 10**30 and one more
    assert near == [((10**30 + 1) << places, 1), (10**30 << places, 1)]
    (one, m), _ = whitening.largest_roots([1, -10, 18], 2)  # 5 + sqrt 7
    assert m == 1 and abs(Fraction(one, 1 << places) - 5) ** 2 - 7 < Fraction(1, 1 << 250)


def test_components_of_repeated_roots_are_orthonormal():
    q = np.array([[1, 2, 2], [2, 1, -2], [2, -2, 1]], dtype=object)  # orthogonal, times 3
    a = q.dot(np.diag(np.array([8, 8, 2], dtype=object))).dot(q.T)
    v = whitening.null_space(a, 72 << whitening.PLACES, 2)
    assert np.abs(v @ v.T - np.eye(2)).max() < 1e-15 and np.abs(v @ a.astype(float) - 72 * v).max() < 1e-12
    u = whitening.null_space(a, 18 << whitening.PLACES, 1)
    assert np.abs(np.abs(u[0]) * 3 - np.array([2, 2, 1])).max() < 1e-15


def test_rank_below_the_components_and_huge_entries(spark):
    rows = [(k, [float(k % 5), 2.0 * (k % 5), 1.0, 3e9 * (k % 3)], 0, "", "") for k in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()
    n, deviation, want, explained = plain([r[1] for r in rows], 2)
    assert [int(q["deviation"]) for q in got] == deviation
    w = np.array([q["whitened"][:2] for q in got], dtype=float)
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6 and all(q["whitened"][2:] == [None, None] for q in got)
    assert got[0]["explained"][2:] == [0.0, 0.0] and got[0]["identity_error"] < 1e-9


def test_empty_tables_single_and_equal_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], ROWS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "", "")], ROWS)).count() == 0
    for k in (1, 4):
        got = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 1, "", "") for i in range(k)], ROWS)).collect()
        assert [(q["n"], int(q["deviation"]), q["whitened"], q["explained"], q["identity_error"]) for q in got] == [(k, 0, [None] * 2, [None] * 2, None)] * k


def test_query_returns_a_row_a_component(spark):
    folder = "/root/testdata/sf0.001"
    got = whitening.op11_whitening(spark, folder).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    n, deviation, want, explained = plain(list(vectors.values()))
    assert len(got) == 8 * n
    place = {v: k for k, v in enumerate(vectors)}
    w = np.zeros((n, 8))
    for r in got:
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[place[r["vec_id"]]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-8
