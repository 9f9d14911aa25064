"""Local quadratic fits against a brute force of their own."""

from __future__ import annotations

import numpy as np
import pytest

from tallyscope.operators.local_fit import local_quadratic


def brute(x, y, span):
    n, k = len(x), int(np.ceil(len(x) * span))
    out = []
    for x0 in x:
        gap = np.abs(x - x0)
        h = max(np.sort(gap)[k - 1], 1e-9)
        w = np.where(gap <= h, (1 - np.minimum(gap / h, 1) ** 3) ** 3, 0.0)
        t = (x - x0) / h
        s = [np.sum(w * t**i) for i in range(5)]
        m = np.array([[s[i + j] for j in range(3)] for i in range(3)])
        r = np.array([np.sum(w * t**i * y) for i in range(3)])
        out.append(np.linalg.solve(m, r)[0] if np.linalg.det(m) > 1e-10 * s[0] ** 3 else r[0] / s[0])
    return np.array(out)


def fitted(spark, x, y, span):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "feature_id long, x double, y double")
    got = {r.feature_id: r.fitted for r in local_quadratic(df, span).collect()}
    return np.array([got[i] for i in range(len(x))])


@pytest.mark.parametrize("kind", ["uniform", "clusters", "ties", "far"])
def test_every_fit_is_that_of_all_points(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "uniform": rng.uniform(-3, 3, 403),
        "clusters": np.concatenate([rng.normal(0, 1e-4, 200), rng.normal(2, 0.5, 157)]),
        "ties": np.round(rng.normal(0, 1, 300), 1),
        "far": np.concatenate([rng.normal(0, 0.3, 150), [1e3, -1e3]]),
    }[kind]
    y = np.sin(x) + rng.normal(0, 0.2, len(x))
    assert np.allclose(fitted(spark, x, y, 0.3), brute(x, y, 0.3), rtol=0, atol=1e-8)


def test_a_parabola_is_its_own_fit(spark):
    x = np.linspace(-2, 5, 97)
    assert np.allclose(fitted(spark, x, 2 - x + 0.5 * x**2, 0.2), 2 - x + 0.5 * x**2, atol=1e-9)


def test_few_equal_and_undefined_points(spark):
    assert np.allclose(fitted(spark, [1.0, 1.0, 1.0], [1.0, 2.0, 6.0], 1.0), [3.0, 3.0, 3.0])
    assert np.allclose(fitted(spark, [2.0], [7.0], 0.3), [7.0])
    rows = [(1, 1.0, 2.0), (2, float("nan"), 1.0), (3, None, 1.0), (4, 1.0, None), (5, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "feature_id long, x double, y double")
    assert [tuple(r) for r in local_quadratic(df).collect()] == [(1, 2.0)]
    assert local_quadratic(df.limit(0)).collect() == []
