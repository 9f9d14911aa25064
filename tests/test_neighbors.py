"""Nearest neighbours against brute force, on the layouts that break fixed grids."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import graph, neighbors


def brute(q, r, k, same):
    out = set()
    for i, row in q.iterrows():
        d = ((r[["x", "y"]] - row[["x", "y"]].astype(float)) ** 2).sum(axis=1).to_numpy(dtype=float)
        order = sorted((d[j], int(r["obs_id"].iloc[j])) for j in range(len(r)) if not (same and r["obs_id"].iloc[j] == row["obs_id"]))
        out |= {(int(row["obs_id"]), b, n + 1) for n, (_, b) in enumerate(order[:k])}
    return out


def layouts():
    rng = np.random.default_rng(0)
    uniform = rng.uniform(size=(150, 2))
    cluster = np.vstack([rng.uniform(size=(60, 2)), 0.5 + 1e-7 * rng.uniform(size=(60, 2))])
    copies = np.vstack([rng.uniform(size=(60, 2)), np.tile([[0.3, 0.3]], (40, 1))])
    line = np.column_stack([np.arange(80.0) ** 2, np.zeros(80)])
    one_spot = np.ones((12, 2))
    few = rng.uniform(size=(4, 2))
    return {"uniform": uniform, "cluster": cluster, "copies": copies, "line": line, "one_spot": one_spot, "few": few}


@pytest.mark.parametrize("name", list(layouts()))
def test_grid_search_is_exact(spark, name):
    pdf = pd.DataFrame(layouts()[name], columns=["x", "y"]).assign(obs_id=lambda d: np.arange(len(d)))
    df = spark.createDataFrame(pdf)
    e = neighbors.nearest(df, df, 5, same=True)
    assert {(r.src, r.dst, r["rank"]) for r in e.collect()} == brute(pdf, pdf, 5, True)


def test_grid_and_block_search_agree_by_group(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"obs_id": np.arange(120), "g": np.arange(120) % 3, "x": rng.normal(size=120), "y": rng.normal(size=120)})
    df = spark.createDataFrame(pdf)
    b = neighbors.nearest(df, df, 4, by=["g"], same=True).select("g", "src", "dst", "rank")
    a = neighbors.knn_vectors(df.withColumn("vec", F.array("x", "y")), None, 4, ["g"]).select("g", "src", "dst", "rank")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert graph.graph_audit(b, ["g"]).where("n_self_edges > 0 or min_out_degree <> 4").count() == 0


def test_grid_search_between_two_sets(spark):
    rng = np.random.default_rng(4)
    q = pd.DataFrame(rng.uniform(0, 2, size=(50, 2)), columns=["x", "y"]).assign(obs_id=np.arange(50))
    r = pd.DataFrame(rng.uniform(0.5, 1, size=(70, 2)), columns=["x", "y"]).assign(obs_id=np.arange(70) + 1000)
    e = neighbors.nearest(spark.createDataFrame(q), spark.createDataFrame(r), 3)
    assert {(x.src, x.dst, x["rank"]) for x in e.collect()} == brute(q, r, 3, False)


@pytest.mark.parametrize("block", [7, 4096])
def test_vector_blocks_do_not_change_results(spark, block):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5))
    lab = np.arange(40) % 3
    df = spark.createDataFrame([(i, v[i].tolist(), int(lab[i])) for i in range(40)], "obs_id long, vec array<double>, label int")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    want = {(i, int(j)) for i in range(40) for j in np.argsort(np.where(np.arange(40) == i, np.inf, d[i]), kind="stable")[:4]}
    got = {(r.src, r.dst) for r in neighbors.knn_vectors(df, None, 4, block_rows=block).collect()}
    assert got == want
    s = {r.obs_id: r.silhouette for r in neighbors.silhouette_rows(df, "label", block_rows=block).collect()}
    for i in range(40):
        means = [d[i][lab == c].sum() / ((lab == c).sum() - (c == lab[i])) for c in range(3)]
        a, b = means[lab[i]], min(m for c, m in enumerate(means) if c != lab[i])
        assert s[i] == pytest.approx((b - a) / max(a, b), rel=1e-9)


def test_silhouette_of_a_singleton_is_zero(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 1), (2, [1.5], 1)], "obs_id long, vec array<double>, label int")
    assert {r.obs_id: r.silhouette for r in neighbors.silhouette_rows(df, "label").collect()}[0] == 0.0


def test_rotation_leaves_neighbour_scores_alone(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(30, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    df = spark.createDataFrame([(i, v[i].tolist(), (v @ q)[i].tolist()) for i in range(30)], "obs_id long, vec array<double>, turned array<double>")
    a, b = neighbors.knn_vectors(df, None, 5), neighbors.knn_vectors(df, None, 5, vec="turned")
    assert graph.knn_jaccard(a, b, 5).first()[0] == pytest.approx(1.0)
    assert neighbors.distance_spearman(df, "vec", "turned", 10).first()[0] == pytest.approx(1.0)


def test_drawn_pairs_are_repeatable(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, v[i].tolist(), (v[i] + rng.normal(size=3)).tolist()) for i in range(60)], "obs_id long, vec array<double>, b array<double>")
    a, b = (neighbors.distance_spearman(x, "vec", "b", draws=5).first()[0] for x in (df, df.repartition(5)))
    assert a == pytest.approx(b) and 0 < a < 1


def test_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "obs_id")
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 8), (10, 9)], "src long, dst long")
    got = {r.obs_id: r.component for r in graph.components(chain, nodes).collect()}
    assert [got[i] for i in range(12)] == [0] * 7 + [7, 8, 8, 8, 11]


def test_moran_without_densifying(spark):
    rng = np.random.default_rng(11)
    dense = rng.poisson(0.7, size=(20, 4)).astype(float)
    dense[:, 3] = 0
    xy = rng.uniform(size=(20, 2))
    lab = np.arange(20) % 2
    obs = spark.createDataFrame([(i, float(xy[i, 0]), float(xy[i, 1]), int(lab[i])) for i in range(20)], "obs_id long, x double, y double, label int")
    counts = spark.createDataFrame([(i, j, int(dense[i, j])) for i in range(20) for j in range(4) if dense[i, j]], "obs_id long, feature_id long, value long")
    edges = neighbors.knn(obs, 3)
    e = [(r.src, r.dst) for r in edges.collect()]
    resid = dense - np.array([dense[lab == x].mean(axis=0) for x in lab])

    def want(m, factor):
        z = m - m.mean(axis=0)
        return factor * sum(z[i] * z[j] for i, j in e) / np.maximum((z**2).sum(axis=0), 1e-300)

    row = {r.feature_id: r.moran for r in graph.moran(counts, graph.weighted(edges, 3), obs).collect()}
    unit = {r.feature_id: r.moran for r in graph.moran_unit(counts, edges, obs).collect()}
    res = {r.feature_id: r.residual_moran for r in graph.residual_moran(counts, edges, obs).collect()}
    for j in range(3):
        assert row[j] == pytest.approx(want(dense, 1 / 3)[j], rel=1e-9)
        assert unit[j] == pytest.approx(want(dense, 20 / len(e))[j], rel=1e-9)
        assert res[j] == pytest.approx(want(resid, 20 / len(e))[j], rel=1e-9)
    assert 3 not in row


def test_label_smoothing_ties_take_the_declared_order(spark):
    obs = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "a")], "obs_id long, label string")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "src long, dst long")
    one = graph.smooth_labels(obs, edges, ["b", "a"], 0.5).where("obs_id = 0").first()
    assert (one.smoothed_label, one.fraction) == ("b", 0.5)


def test_mmd_takes_every_row_at_any_block_size(spark):
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=(1100, 2)), rng.normal(0.4, 1.3, size=(60, 2)), np.zeros((5, 2))])
    first = np.arange(len(v)) < 1100
    df = spark.createDataFrame([(i, v[i].tolist(), int(not first[i])) for i in range(len(v))], "obs_id long, vec array<double>, batch int")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    width = np.median(d[d > 0])
    k = np.exp(-d**2 / (2 * width**2))
    want = k[first][:, first].mean() + k[~first][:, ~first].mean() - 2 * k[first][:, ~first].mean()
    for block in (300, 4096):
        got = neighbors.mmd2_rbf(df, "batch", 0, 1, block_rows=block).first()
        assert got.bandwidth == pytest.approx(width, rel=1e-12) and got.mmd2 == pytest.approx(want, rel=1e-9)
    one = neighbors.mmd2_rbf(df.where("batch = 0").limit(3), "batch", 0, 1).first()
    assert one.mmd2 is None
    same = neighbors.mmd2_rbf(df.where("obs_id >= 1160").withColumn("batch", (F.col("obs_id") % 2).cast("int")), "batch", 0, 1).first()
    assert same.bandwidth == 1.0 and same.mmd2 == 0.0
