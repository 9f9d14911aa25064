"""The Morton search over many ranges, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import morton, neighbors


def layouts():
    rng = np.random.default_rng(21)
    uniform = rng.uniform(size=(400, 2))
    dense = np.vstack([rng.uniform(size=(40, 2)), 0.5 + 1e-6 * rng.uniform(size=(300, 2))])
    copies = np.vstack([rng.integers(0, 5, size=(300, 2)).astype(float), np.tile([[2.0, 2.0]], (60, 1))])
    line = np.column_stack([np.arange(200.0) ** 2, np.zeros(200)])
    far = np.vstack([rng.uniform(size=(150, 2)), 1e6 + rng.uniform(size=(150, 2))])
    return {"uniform": uniform, "dense": dense, "copies": copies, "line": line, "far": far}


def brute(points, ids, k, groups=None, refs=None, ref_ids=None, ref_groups=None):
    refs, ref_ids, ref_groups = (points, ids, groups) if refs is None else (refs, ref_ids, ref_groups)
    same, out = ref_ids is ids, set()
    for i, p in enumerate(points):
        d = np.zeros(len(refs))
        for j in range(points.shape[1]):
            d += (p[j] - refs[:, j]) * (p[j] - refs[:, j])
        order = sorted((d[j], ref_ids[j]) for j in range(len(refs)) if not (same and ref_ids[j] == ids[i]) and (groups is None or ref_groups[j] == groups[i]))
        out |= {(ids[i], dst, n + 1) for n, (_, dst) in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("name", list(layouts()))
def test_many_ranges_are_exact(spark, name):
    points = layouts()[name]
    ids = np.random.default_rng(1).permutation(len(points)).tolist()
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(obs_id=ids))
    got = morton.nearest(df, df, 5, same=True, chunk=25)
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == brute(points, ids, 5)


def test_groups_that_span_ranges_and_small_ones(spark):
    rng = np.random.default_rng(22)
    groups = ["big"] * 200 + ["one"] + [f"g{i // 7}" for i in range(140)]
    points = rng.normal(size=(len(groups), 2))
    ids = [f"id{i:04d}" for i in range(len(groups))]
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(obs_id=ids, g=groups))
    got = morton.nearest(df, df, 3, by=["g"], same=True, chunk=30).collect()
    assert {(r.src, r.dst, r["rank"]) for r in got} == brute(points, ids, 3, groups)
    assert {r.g for r in got} == set(groups) - {"one"}


def test_three_dimensions_and_two_sets(spark):
    rng = np.random.default_rng(23)
    q, r = rng.uniform(0, 2, size=(90, 3)), np.vstack([rng.uniform(0.5, 1, size=(120, 3)), np.tile([[0.7, 0.7, 0.7]], (30, 1))])
    qi, ri = list(range(90)), list(range(1000, 1150))
    a = spark.createDataFrame(pd.DataFrame(q, columns=list("xyz")).assign(obs_id=qi))
    b = spark.createDataFrame(pd.DataFrame(r, columns=list("xyz")).assign(obs_id=ri))
    got = morton.nearest(a, b, 4, ["x", "y", "z"], chunk=20)
    assert {(x.src, x.dst, x["rank"]) for x in got.collect()} == brute(q, qi, 4, refs=r, ref_ids=ri)


def test_only_rims_are_asked_again(spark, monkeypatch):
    """Of a filled square few locations leave their range, and little of a neighbour is sent along."""
    rng = np.random.default_rng(24)
    points = rng.uniform(size=(6000, 2))
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(obs_id=np.arange(6000)))
    sizes = {}
    visited = morton._Search.visited

    def counted(self, asks, halo):
        sizes.setdefault("asks", asks.count())
        sizes.setdefault("halo", halo.count())
        return visited(self, asks, halo)

    monkeypatch.setattr(morton._Search, "visited", counted)
    edges = morton.nearest(df, df, 4, same=True, chunk=1500)
    assert edges.count() == 24_000
    assert 0 < sizes["asks"] < 2000 and 0 < sizes["halo"] < 2000


def test_too_few_rows_are_refused(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, "a" if i else "b") for i in range(5)], "obs_id long, x double, y double, g string")
    with pytest.raises(ValueError, match="5 rows"):
        neighbors.knn(df, 5)
    assert neighbors.knn(df, 4).count() == 20
    with pytest.raises(ValueError):
        neighbors.knn(df, 1, by=["g"])
    assert neighbors.knn(df, 1, by=["g"], strict=False).count() == 4
    with pytest.raises(ValueError):
        neighbors.knn_transfer(df, df.limit(2), 3)
    assert neighbors.knn(df.where("obs_id < 0"), 3).count() == 0


def test_rows_without_coordinates_take_no_part(spark):
    rows = [(0, 0.0, 0.0), (1, None, 0.0), (2, 1.0, float("nan")), (3, 1.0, 0.0), (4, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "obs_id long, x double, y double")
    got = {(r.src, r.dst) for r in neighbors.knn(df, 1).collect()}
    assert got == {(0, 3), (3, 0), (4, 3)}


def test_a_third_of_all_rows_at_one_place(spark):
    spots = spark.range(3000).select(F.col("id").alias("obs_id"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"), F.lit(0.0).alias("y"))
    got = morton.nearest(spots, spots, 3, same=True, chunk=200)
    at = {r.src: r.dsts for r in got.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts")).where("src % 3 = 0").collect()}
    assert len(at) == 1000 and at[2997] == [0, 3, 6] and at[3] == [0, 6, 9]
