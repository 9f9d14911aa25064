"""Drawn pairs: the rule by ranges against the rule by rows, and how often a row travels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import neighbors


def plain(n, draws, seed):
    return sorted({tuple(sorted((i, (i + 1 + (i * 7919 + t * 104_729 + seed) % (n - 1)) % n))) for i in range(n) for t in range(draws)})


def expected(v, w, pairs):
    d = pd.DataFrame({c: [np.sqrt(((x[i] - x[j]) ** 2).sum()) for i, j in pairs] for c, x in (("v", v), ("w", w))})
    return d["v"].rank().corr(d["w"].rank())


@pytest.mark.parametrize("n,draws,seed", [(2, 5, 0), (3, 5, 1), (40, 50, 0), (301, 7, 3), (7920, 50, 0), (104_730, 3, 0)])
def test_pairs_by_range_are_those_of_the_rule(n, draws, seed):
    rule, got = neighbors.Draws(n, draws, seed), []
    held = np.random.default_rng(n).permutation(n)
    for part in np.array_split(held, 3):
        i, j = rule.pairs(np.arange(n), part)
        got += [tuple(sorted(p)) for p in zip(i.tolist(), part[j].tolist(), strict=True)]
    assert sorted(got) == plain(n, draws, seed)


def test_a_row_travels_to_few_ranges(spark):
    rule = neighbors.Draws(20_000, 50, block_rows=1000)
    sent = spark.range(20_000).select(F.size(rule.ranges(F.col("id"))).alias("k"))
    assert sent.agg(F.avg("k")).first()[0] < 2.2


@pytest.mark.parametrize("n", [1, 3, 90])
def test_distances_of_drawn_pairs(spark, n):
    rng = np.random.default_rng(n)
    v, w = rng.normal(size=(n, 5)), rng.normal(size=(n, 2))
    df = spark.createDataFrame([(100 - i, v[i].tolist(), w[i].tolist()) for i in range(n)], "obs_id long, vec array<double>, b array<double>")
    got = neighbors.distance_spearman(df, "vec", "b", draws=6).collect()
    got = got[0][0] if got else None
    pairs = plain(n, 6, 0) if n > 1 else []
    want = expected(v[::-1], w[::-1], pairs) if len(pairs) > 1 else None
    assert got is None if want is None else got == pytest.approx(want, rel=1e-12)


def test_a_missing_vector_takes_no_part(spark):
    rng = np.random.default_rng(5)
    v, w = rng.normal(size=(30, 4)), rng.normal(size=(30, 2))
    rows = [(i, None if i == 7 else (v[i][:3] if i == 8 else v[i]).tolist(), w[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "obs_id long, vec array<double>, b array<double>")
    pairs = [p for p in plain(30, 6, 0) if not {7, 8} & set(p)]
    assert neighbors.distance_spearman(df, "vec", "b", draws=6).first()[0] == pytest.approx(expected(v, w, pairs), rel=1e-12)
