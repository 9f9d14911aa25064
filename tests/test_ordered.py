"""Ordered statistics: the plan for large keys gives what the plain window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.functions import ordered
from tallyscope.operators import correlation, distance, enrich


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    big = pd.DataFrame({"k": "hot", "v": np.round(rng.normal(size=700), 2)})
    rest = pd.DataFrame({"k": rng.choice(list("abcdefg"), 600), "v": np.round(rng.normal(size=600), 1)})
    return pd.concat([big, rest], ignore_index=True)


def expected_totals(pdf):
    c = pdf.groupby(["k", "v"]).size().rename("n").reset_index().sort_values(["k", "v"])
    c["cum"] = c.groupby("k")["n"].cumsum()
    c["next"] = c.groupby("k")["v"].shift(-1)
    return c


@pytest.mark.parametrize("split", [None, 5, 40])
@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, skewed, split, parts):
    df = ordered.compress(spark.createDataFrame(skewed).repartition(parts), ["k"], "v")
    got = ordered.running_totals(df, ["k"], "v", ["n"], split).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = expected_totals(skewed).reset_index(drop=True)
    assert (got["cum_n"] == want["cum"]).all()
    assert np.allclose(got["next_v"].astype(float), want["next"].astype(float), equal_nan=True)
    assert (got.groupby("k")["total_n"].first() == skewed.groupby("k").size()).all()


@pytest.mark.parametrize("split", [None, 10])
def test_quantiles_are_linear_interpolated(spark, skewed, split):
    df = spark.createDataFrame(skewed)
    got = ordered.exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, split_rows=split).toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        assert np.allclose(got.loc[k, ["a", "b", "c"]].astype(float), np.quantile(g["v"], [0.05, 0.5, 0.95]), rtol=1e-12)


@pytest.mark.parametrize("split", [None, 10])
def test_ungrouped_positions(spark, split):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("v"))
    got = ordered.positions(df, (), "v", "pos", split).toPandas().sort_values("v")
    assert got["pos"].tolist() == list(range(100))


def test_average_ranks_on_a_cut_key(spark, skewed):
    got = ordered.average_ranks(spark.createDataFrame(skewed), ["k"], "v", 7).toPandas()
    want = skewed.assign(r=skewed.groupby("k")["v"].rank()).drop_duplicates(["k", "v"])
    j = got.merge(want, on=["k", "v"])
    assert len(j) == len(got) and np.allclose(j["avg_rank"], j["r"])


@pytest.mark.parametrize("split", [None, 6])
def test_wasserstein_equals_sorted_difference(spark, split):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300), rng.normal(0.5, 2, size=300)
    frames = [spark.createDataFrame(pd.DataFrame({"v": x})) for x in (a, b)]
    got = distance.wasserstein(*frames, "v", split_rows=split).first()[0]
    assert got == pytest.approx(np.mean(np.abs(np.sort(a) - np.sort(b))), rel=1e-12)


def test_one_sided_group_is_undefined(spark):
    a = spark.createDataFrame([("x", 1.0)], "k string, v double")
    b = spark.createDataFrame([("y", 2.0)], "k string, v double")
    assert [r[1] for r in distance.wasserstein(a, b, "v", ["k"]).collect()] == [None, None]


@pytest.mark.parametrize("split", [None, 4])
def test_rank_features_plans_agree(spark, split):
    rng = np.random.default_rng(5)
    dense = rng.poisson(1.0, size=(40, 3)).astype(float)
    labels = np.repeat([0, 1], [15, 25])
    rows = [(int(i), int(j), float(dense[i, j])) for i in range(40) for j in range(3) if dense[i, j]]
    counts = spark.createDataFrame(rows, "obs_id long, feature_id long, value double")
    obs = spark.createDataFrame([(i, int(labels[i])) for i in range(40)], "obs_id long, label int")
    got = {(r.feature_id, r.label): r.score for r in enrich.rank_features(counts, obs, split_rows=split).collect()}
    for j in range(3):
        ranks = pd.Series(dense[:, j]).rank().to_numpy()
        ties = pd.Series(dense[:, j]).value_counts().to_numpy().astype(float)
        for lab in (0, 1):
            m = labels == lab
            n1, n = m.sum(), 40
            var = (1 - (ties**3 - ties).sum() / (n**3 - n)) * n1 * (n - n1) * (n + 1) / 12
            assert got[j, lab] == pytest.approx((ranks[m].sum() - n1 * (n + 1) / 2) / np.sqrt(var), rel=1e-9)


def test_spearman_on_cut_ranks(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.integers(0, 30, 200).astype(float), "y": rng.normal(size=200)})
    want = pdf["x"].rank().corr(pdf["y"].rank())
    got = correlation.spearman(spark.createDataFrame(pdf), "x", "y", split_rows=9).first()[0]
    assert got == pytest.approx(want, rel=1e-9)
