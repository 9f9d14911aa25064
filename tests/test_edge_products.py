"""Sums over edges and cells against brute force, and what travels for them."""

import numpy as np
import pandas as pd
import pytest

from tallyscope.operators import graph


def frames(spark, kind):
    rng = np.random.default_rng(21)
    name = (lambda j: f"g{j}") if kind == "string" else int
    cells = [(g, i, name(j), float(rng.integers(1, 9))) for g in "ab" for i in range(40) for j in rng.choice(30, rng.integers(0, 20), replace=False)]
    cells += cells[:5]
    edges = [(g, i, int(j), float(rng.random())) for g in "ab" for i in range(45) for j in [0, *rng.integers(0, 45, 4)]]
    return cells, edges, spark.createDataFrame(cells, f"g string, obs_id long, feature_id {kind}, x double"), spark.createDataFrame(edges, "g string, src long, dst long, weight double")


@pytest.mark.parametrize("kind,block,row", [("long", 50, 4), ("string", 1000, 1000)])
def test_products_of_edges(spark, kind, block, row):
    cells, edges, c, e = frames(spark, kind)
    got = {(r.g, r.feature_id): r.s for r in graph.edge_products(c, e, ["g"], block, row).groupBy("g", "feature_id").agg({"_cross": "sum"}).withColumnRenamed("sum(_cross)", "s").collect()}
    t, w = pd.DataFrame(cells, columns=["g", "src", "f", "x"]), pd.DataFrame(edges, columns=["g", "src", "dst", "w"])
    j = w.merge(t, on=["g", "src"]).merge(t.rename(columns={"src": "dst", "x": "y"}), on=["g", "dst", "f"])
    want = (j["w"] * j["x"] * j["y"]).groupby([j["g"], j["f"]]).sum()
    assert len(got) == len(want) and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_lookups_in_pieces(monkeypatch):
    monkeypatch.setattr(graph, "LOOKUPS", 3)
    a = pd.DataFrame({"obs_id": [1, 2], "f": [np.array([5, 6]), np.array([6, 6])], "x": [np.array([2.0, 3.0]), np.array([1.0, 4.0])]})
    b = pd.DataFrame({"srcs": [np.array([1, 2, 9, 1]), np.array([2])], "ws": [np.array([1.0, 10.0, 7.0, 0.5]), np.array([2.0])], "f": [np.array([6, 5, 8]), np.array([6])], "x": [np.array([1.0, 2.0, 9.0]), np.array([3.0])]})
    features, total = graph._products(a, b)
    assert dict(zip(features.tolist(), total.tolist(), strict=True)) == {5: 6.0, 6: 3.0 * 1.5 + 5.0 * 10 + 5.0 * 2 * 3}


def test_no_row_for_a_cell_and_an_edge(spark):
    _, _, c, e = frames(spark, "long")
    plan = graph.edge_products(c, e, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "collect_list(feature_id" in plan
    joins = [line for line in plan.splitlines() if "Join Inner, ((" in line or "Join Inner, (" in line]
    assert joins and all("feature_id" not in line for line in joins)
