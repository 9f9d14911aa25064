"""Multiplicities by binomial splitting: exact sums, even shares, no row per draw."""

from __future__ import annotations

import numpy as np

from tallyscope.operators import resample
from tallyscope.operators.multinomial import SEGMENT, multiplicities


def test_sums_are_exact_and_shares_even(spark):
    groups = [("a", 5, 10**9), ("b", SEGMENT * 3 + 17, 10**15), (None, 2, 3), ("c", 10**9, 2000), ("d", 4, 0), ("e", 0, 4), ("f", None, 4)]
    g = spark.createDataFrame(groups, "k string, n_donors long, n_draws long")
    got = multiplicities(g, ["k"], seed=1).toPandas()
    sums = got.groupby("k", dropna=False)["times"].sum()
    # a NULL key is drawn for but joins on its hash, so it is there like the others
    assert {k if isinstance(k, str) else None: int(v) for k, v in sums.items()} == {"a": 10**9, "b": 10**15, None: 3, "c": 2000}
    assert got["times"].min() > 0
    for k, n, _ in groups[:2]:
        m = got[got["k"] == k].set_index("idx")["times"].reindex(range(n), fill_value=0).to_numpy()
        mean = m.sum() / n
        chi = np.sum((m - mean) ** 2) / mean
        assert abs(chi - (n - 1)) < 6 * np.sqrt(2 * (n - 1)) + 6
    few = got[got["k"] == "c"]
    assert few["idx"].between(0, 10**9 - 1).all() and len(few) > 1990
    assert abs(few["idx"].mean() / 1e9 - 0.5) < 0.05


def test_many_replicates_have_the_binomial_moments(spark):
    g = spark.range(2000).selectExpr("id as r", "10L as n_donors", "30L as n_draws")
    m = multiplicities(g, ["r"], seed=2).toPandas().pivot(index="r", columns="idx", values="times").fillna(0)
    assert np.allclose(m.mean(), 3.0, atol=0.2) and np.allclose(m.var(), 30 * 0.1 * 0.9, atol=0.4)
    assert abs(np.corrcoef(m[0], m[9])[0, 1] + 1 / 9) < 0.08


def test_partitions_and_order_do_not_matter(spark):
    g = spark.range(40).selectExpr("id as r", f"{SEGMENT * 2}L as n_donors", "500L as n_draws")
    one = {tuple(x) for x in multiplicities(g.coalesce(1), ["r"], seed=3).collect()}
    many = {tuple(x) for x in multiplicities(g.orderBy(g.r.desc()).repartition(13), ["r"], seed=3).collect()}
    assert one == many
    assert one != {tuple(x) for x in multiplicities(g, ["r"], seed=4).collect()}


def test_region_means_of_a_huge_blueprint(spark):
    source = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(6)], "obs_id long, label string")
    counts = spark.createDataFrame([(i, "g", i) for i in range(6)], "obs_id long, feature_id string, value long")
    blueprint = spark.createDataFrame([("a", 10**9), ("b", 10**9)], "label string, n_spots long")
    got = {r.label: r["mean"] for r in resample.bootstrap_region_mean(counts, source, blueprint, 1, 5).collect()}
    assert abs(got["a"] - 1.5) < 1e-3 and abs(got["b"] - 4.5) < 1e-3
