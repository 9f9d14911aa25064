"""Coupling summaries: reduced in blocks, they equal those of the long table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import alignment
from tallyscope.operators.coupling import marginals, radius_marginals
from tallyscope.operators.neighbors import within_radius

COLS = "obs_id long, vec array<double>, x double, y double"


def sides(spark, n, seed, name=lambda i: i, kind="long"):
    rng = np.random.default_rng(seed)
    rows = [[(name(i), [float(v) for v in rng.integers(0, 4, 2)], float(rng.normal()), float(rng.normal())) for i in range(k)] for k in (n, n + 7)]
    return [spark.createDataFrame(r, COLS.replace("long", kind)) for r in rows]


def flat(df):
    return {(r.side, r.idx): (r.choice, *[None if v is None else round(v, 9) for v in (r.total, r.best, r.true_mass)]) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [5, 1000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_give_the_sums_of_all_pairs(spark, block_rows, kind):
    # few places on a grid, so that equal masses are common
    name = (lambda i: i + 2**60) if kind == "long" else (lambda i: f"spot{i}")
    mov, ref = sides(spark, 31, 4, name, kind)
    truth = mov.where(F.rand(1) < 0.7).select(F.col("obs_id").alias("mov_idx"), F.col("obs_id").alias("ref_idx"))
    truth = spark.createDataFrame(truth.collect(), truth.schema)
    got = radius_marginals(mov, ref, 1.5, lambda d: 1.0 / (1.0 + d), truth, block_rows=block_rows)
    pairs = within_radius(mov, ref, 1.5).select(F.col("dst").alias("ref_idx"), F.col("src").alias("mov_idx"), (1 / (1 + F.sqrt("d2"))).alias("mass"))
    assert flat(got) == flat(marginals(pairs, truth))
    a = alignment.transport_of_marginals(got, truth, ref.select(F.col("obs_id").alias("ref_idx"))).first()
    b = alignment.transport_metrics(pairs, truth, ref.select(F.col("obs_id").alias("ref_idx"))).first()
    assert a.asDict() == pytest.approx(b.asDict())
    a = {r.obs_id: (r.tx, r.ty) for r in alignment.procrustes_of_marginals(got, mov).collect()}
    for r in alignment.weighted_procrustes(pairs, ref, mov).collect():
        assert a[r.obs_id] == pytest.approx((r.tx, r.ty))


def test_odd_rows(spark):
    mov = spark.createDataFrame([(1, [0.0], 0.0, 0.0), (2, [9.0], 1.0, 0.0), (3, None, 1.0, 0.0)], COLS)
    ref = spark.createDataFrame([(5, [0.5], 0.0, 0.0), (4, [0.5], 0.0, 0.0), (6, None, 0.0, 0.0)], COLS)
    got = flat(radius_marginals(mov, ref, 1.0, lambda d: d))
    assert got == {("mov", 1): (4, 1.0, 0.5, 0.0), ("ref", 4): (1, 0.5, 0.5, None), ("ref", 5): (1, 0.5, 0.5, None)}
    assert flat(radius_marginals(mov.limit(0), ref, 1.0, lambda d: d)) == {}
    with pytest.raises(Exception, match="finite and non-negative"):
        radius_marginals(mov, ref, 1.0, lambda d: -d).collect()


def test_equal_vectors_of_many_dimensions_tie_to_the_lowest_index(spark):
    """Copies in different blocks and places: their masses must be equal to the last bit."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 64)) / 8
    own = lambda k, many: spark.createDataFrame([(i, [float(v) for v in base[i % k]], 0.0, 0.0) for i in range(many)], COLS)
    mov, ref = own(12, 60), own(11, 77)
    got = {(r.side, r.idx): r.choice for r in radius_marginals(mov, ref, 4.0, lambda d: np.exp(-d), block_rows=9).collect()}
    d = ((base[:, None] - base[None]) ** 2).sum(-1)
    for i in range(60):
        assert got["mov", i] == int(np.argmin(d[i % 12, :11]))
    for i in range(77):
        assert got["ref", i] == int(np.argmin(d[i % 11]))
