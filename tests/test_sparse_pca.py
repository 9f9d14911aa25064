"""Sparse components against a dense singular value decomposition."""

import numpy as np
import pytest

from tallyscope.operators.sparse_pca import sparse_pca


def table(spark, x):
    cells = [(i, j, float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame([(int(i), int(j), v) for i, j, v in cells], "obs_id long, feature_id long, value double").repartition(5), spark.range(len(x)).withColumnRenamed("id", "obs_id")


def test_like_a_dense_decomposition(spark):
    rng = np.random.default_rng(41)
    x = rng.poisson(np.outer(rng.gamma(1, size=60), rng.gamma(1, size=25)) * 0.8 + rng.gamma(0.5, size=(60, 25)) * (rng.random((60, 25)) < 0.3)).astype(float)
    x[7] = 0
    x[:, 3] = 0
    got = sparse_pca(*table(spark, np.log1p(x)), 4, extra=6, rtol=1e-12, whole=0)
    assert got.rounds > 1
    c = np.log1p(x) - np.log1p(x).mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert got.variances == pytest.approx(s[:4] ** 2 / 59, rel=1e-8)
    assert got.total_variance == pytest.approx((s**2).sum() / 59, rel=1e-10)
    loadings = {r.feature_id: r.loading for r in got.loadings.collect()}
    assert set(loadings) == set(range(25)) - {3}
    scores = {r.obs_id: r.pc for r in got.scores.collect()}
    for i in range(2):
        lead = np.sign(vt[i][np.abs(vt[i]).argmax()])
        assert [scores[o][i] for o in range(60)] == pytest.approx(lead * u[:, i] * s[i], abs=1e-4)
    # every score's variance is the Rayleigh quotient of its loading
    for i in range(4):
        v = np.array([loadings.get(j, [0] * 4)[i] for j in range(25)])
        assert v @ v == pytest.approx(1, rel=1e-9) and (c @ v).var(ddof=1) == pytest.approx(got.variances[i], rel=1e-8)


def test_all_components_hold_all_variance(spark):
    rng = np.random.default_rng(42)
    x = rng.poisson(1.0, (30, 6)).astype(float)
    got = sparse_pca(*table(spark, x), 6)
    assert sum(got.variances) == pytest.approx(x.var(0, ddof=1).sum(), rel=1e-10) and got.rounds == 1


def test_smaller_rank_and_too_few_rows(spark):
    x = np.outer(np.arange(1.0, 9), [1.0, 2.0, 0.0, 3.0])
    got = sparse_pca(*table(spark, x), 3)
    assert got.variances[0] == pytest.approx(x.var(0, ddof=1).sum(), rel=1e-9) and max(got.variances[1:], default=0) < 1e-9
    cells, obs = table(spark, x)
    with pytest.raises(ValueError):
        sparse_pca(cells, obs.limit(1), 2)
    none = sparse_pca(cells.where("value < 0"), obs, 2)
    assert none.variances == [] and none.scores.count() == 8
