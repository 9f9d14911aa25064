"""The fused pass over pairs and the mergeable summaries, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import distance, gram, neighbors, pairpass
from tallyscope.plans.scoring import embedding_metrics, paired_supports


def vectors(n, seed, dims=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    return np.vstack([v, np.tile(v[:1], (5, 1))])


def test_each_block_pair_meets_once(spark):
    v = vectors(115, 1)
    df = spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "id long, v array<double>, name string").withColumn("_k", F.lit(0))
    visits = spark.sparkContext.accumulator(0)
    got = pairpass.pair_pass(df, [pairpass.LabelSums("name")], ["_k"], block_rows=30, visits=visits).groupBy("_id", "_tag").agg(F.sum("_x").alias("x"), F.sum("_n").alias("n")).collect()
    assert visits.value == 4 * 5 // 2
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for r in got:
        own = np.arange(len(v)) % 2 == "ab".index(r._tag)
        assert r.n == own.sum() and r.x == pytest.approx(d[r._id][own].sum(), rel=1e-12)


@pytest.mark.parametrize("sample_rows", [2, 64, 1024])
def test_median_and_kernel_need_no_good_bracket(spark, sample_rows):
    v = np.vstack([vectors(150, 2), 5 + vectors(60, 3)])
    first = np.arange(len(v)) % 3 == 0
    df = spark.createDataFrame([(i, x.tolist(), int(f)) for i, (x, f) in enumerate(zip(v, first, strict=True))], "obs_id long, vec array<double>, batch int")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    width = np.median(d[d > 0])
    k = np.exp(-(d**2) / (2 * width**2))
    want = k[first][:, first].mean() + k[~first][:, ~first].mean() - 2 * k[first][:, ~first].mean()
    got = neighbors.mmd2_rbf(df, "batch", 1, 0, block_rows=50, sample_rows=sample_rows).first()
    assert got.bandwidth == pytest.approx(width, rel=1e-12) and got.mmd2 == pytest.approx(want, rel=1e-9)


def test_embedding_row_takes_two_passes_and_both_supports(spark):
    rng = np.random.default_rng(4)
    rows = []
    for pair in range(60):
        base = rng.normal(size=4)
        for b in (0, 1):
            rows.append((2 * pair + b, pair, b, "xyz"[pair % 3] if pair % 7 else None, (base + 0.3 * b + 0.1 * rng.normal(size=4)).tolist(), rng.poisson(2, 6).astype(float).tolist(), pair % 10 > 0 or b == 0))
    df = spark.createDataFrame(rows, "obs_id long, pair_id long, batch int, label string, vec array<double>, expression array<double>, marked boolean")
    visits = spark.sparkContext.accumulator(0)
    both = paired_supports(df, "marked")
    got = {r.support_variant: r for r in embedding_metrics(both, "batch", 0, 1, k=5, expression="expression", by=["support_variant"], block_rows=40, visits=visits).collect()}
    # 120 and 108 rows are three blocks each: six pairs, met twice
    assert set(got) == {"all_spots", "paired_nonzero"} and visits.value == 2 * 2 * 6
    kept = df.where("pair_id % 10 > 0")
    alone = embedding_metrics(kept, "batch", 0, 1, k=5, expression="expression").first()
    for c in alone.asDict():
        assert got["paired_nonzero"][c] == pytest.approx(alone[c], rel=1e-9), c
    x = {(r[1], r[2]): np.array(r[5]) for r in rows}
    want = np.nanmedian([np.corrcoef(x[p, 0], x[p, 1])[0, 1] for p in range(60)])
    assert got["all_spots"].paired_expression_correlation == pytest.approx(want, rel=1e-9)


def test_full_row_shares_its_passes_and_searches(spark, monkeypatch):
    from tallyscope.operators import graph, neighbors
    from tallyscope.operators.transform import standardize
    from tallyscope.plans import scoring

    rng = np.random.default_rng(6)
    rows = [(i, i % 2, "xyz"[i // 2 % 3], *rng.normal(size=2).tolist(), rng.normal(size=4).tolist(), rng.normal(size=3).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "obs_id long, batch int, label string, x double, y double, vec array<double>, base array<double>")
    calls = []
    counted = lambda module, name: monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: calls.append(name) or f(*a, **b))
    with monkeypatch.context():
        counted(pairpass, "pair_pass")
        counted(neighbors, "knn_vectors")
        got = scoring.full_metric_row(df, "base", "batch", 0, 1, k=8).first()
    assert calls.count("pair_pass") == 3 and calls.count("knn_vectors") == 5
    z = standardize(df, "vec")
    mean = lambda frame, c: frame.agg({c: "avg"}).first()[0]
    assert got.conditional_batch_asw_macro == pytest.approx(mean(neighbors.silhouette(z, "batch", ["label"]), "silhouette"), rel=1e-9)
    assert got.conditional_mmd2_macro == pytest.approx(mean(neighbors.mmd2_rbf(z, "batch", 0, 1, ["label"]), "mmd2"), rel=1e-9)
    alone = graph.knn_jaccard(neighbors.knn(df, 6, ("x", "y"), ["batch"]), neighbors.knn_vectors(z, None, 6, ["batch"]), 6, ["batch"])
    assert got.spatial_embedding_knn_overlap == pytest.approx(mean(alone, "knn_jaccard"), rel=1e-9)


def test_summaries_merge_to_numpy(spark, monkeypatch):
    monkeypatch.setattr(gram, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    v = 1e6 + rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    g = np.arange(300) % 3
    rows = [(int(k) if k else None, x.tolist()) for k, x in zip(g, v, strict=True)] + [(1, None)]
    got = {r.g: r for r in gram.gram_summaries(spark.createDataFrame(rows, "g int, vec array<double>").repartition(7), F.col("vec"), ["g"]).collect()}
    for k in range(3):
        r = got[k or None]
        part = v[g == k]
        assert r.n == len(part) and r.mean == pytest.approx(part.mean(0), rel=1e-14)
        assert np.array(r.comoment).reshape(4, 4) / (r.n - 1) == pytest.approx(np.cov(part, rowvar=False), rel=1e-8)


def test_no_vector_is_exploded(spark):
    df = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(6)], "batch int, vec array<double>")
    plan = distance.covariance_distance(df, "vec", "batch")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [4.0])], "batch int, vec array<double>")
    assert distance.covariance_distance(one, "vec", "batch").first()[0] is None
    assert distance.centroid_distance(one, "vec", "batch").first()[0] == 2.0


def test_distances_by_inner_products_are_exact_where_rows_are_equal_or_close():
    from tallyscope.operators.pairpass import distance_rows, differences

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    y = np.concatenate([x[:40], x[40:80] + np.float32(1e-4), rng.normal(size=(500, 64)).astype(np.float32), x[:40]]).astype(float)
    got = np.concatenate([d for _, d in distance_rows(x, y)])
    i, j = np.divmod(np.arange(got.size), len(y))
    want = differences(x.astype(float), y, i, j).reshape(got.shape)
    assert (got[np.arange(40), np.arange(40)] == 0).all() and (got[:40, :40] == got[:40, -40:])[np.eye(40, dtype=bool)].all()
    assert np.allclose(got, want, rtol=1e-12, atol=0)
    far = np.full((3, 64), np.inf)
    assert all(np.isinf(d).all() for _, d in distance_rows(far, y))


def test_distances_are_not_summed_dimension_by_dimension():
    """Four million pairs of 64 dimensions: differences alone took about 20 times as long as a plain product."""
    import time

    from tallyscope.operators.pairpass import distance_rows

    x = np.random.default_rng(6).normal(size=(2048, 64))

    def seconds(run):
        times = []
        for _ in range(3):
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        return min(times)

    def by_differences():
        for start in range(0, len(x), 256):
            d2 = np.zeros((256, len(x)))
            for j in range(x.shape[1]):
                gap = x[start : start + 256, j, None] - x[None, :, j]
                d2 += gap * gap

    assert seconds(lambda: [None for _ in distance_rows(x, x)]) < seconds(by_differences) / 2
