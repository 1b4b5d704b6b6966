from fractions import Fraction

import numpy as np
import pytest
from vellum.llm.whitening import primes, scatter, fit_list, whitened


def whole(v):
    return [int(np.floor(64 * float(x))) + 1_000_000 for x in v]


def brute(vectors, components):
    """By exact fractions up to the eigenvectors."""
    fit = sorted({tuple(whole(v)) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(cov))
    order = np.argsort(-e)[:components]
    trace = float(sum(Fraction(cov[i][i]) for i in range(d)))
    deviation = [sum((n * a - b) ** 2 for a, b in zip(whole(v), s)) for v in vectors]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(whole(v), s)] for v in vectors]) @ u[:, order] / np.sqrt(e[order])
    return n, deviation, y, e[order] / trace


def test_equals_exact_fractions(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 6)) * [40, 9, 5, 3, 1, 0.5] + 1000).astype(np.float32)
    vectors[50:80] = vectors[0]  # copies are fitted once
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(7)
    got = {(r["vec_id"], r["component"]): r for r in whitened(rows, 4).collect()}
    n, deviation, y, share = brute(vectors.astype(float), 4)
    assert len(got) == 1200 and n == 270
    flip = [np.sign(got[0, c + 1]["whitened"] * y[0, c]) for c in range(4)]
    for i in range(300):
        for c in range(4):
            r = got[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert r["whitened"] == pytest.approx(flip[c] * y[i, c], rel=1e-9, abs=1e-9)
            assert r["explained"] == pytest.approx(share[c], rel=1e-9) and r["identity_error"] < 1e-9


def test_scatter_is_exact_far_beyond_doubles(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-(2**40), 2**40, size=(40, 3)).astype(float)
    rows = spark.createDataFrame([(v.tolist(),) for v in vectors], "embedding array<double>").repartition(5)
    x = [whole(v) for v in vectors]
    got = scatter(fit_list(rows, "embedding", 3), 3, primes(2 * 40 * 2**94))
    assert [[got[i][j] for j in range(3)] for i in range(3)] == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    assert [got[i][3] for i in range(4)] == [sum(r[i] for r in x) for i in range(3)] + [40]


def test_primes_pass_the_bound():
    found = primes(10**30)
    assert np.prod([float(p) for p in found]) > 1e30 and all(p < 1 << 20 for p in found) and len(set(found)) == len(found)


def test_invalid_rows_go_and_odd_ones_stay(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, _id string")
    got = whitened(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((i, c) for i in ("1", "1", "None", "6", "7") for c in (1, 2))
    assert {r["n"] for r in got} == {4}  # the repeated vector counts once


def test_no_variance_and_no_rows(spark):
    one = whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitened(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_huge_entries_are_exact_or_null(spark):
    rows = [(1, [1e17, 0.0]), (2, [-1e17, 1.0]), (3, [1e300, 2.0])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got)
