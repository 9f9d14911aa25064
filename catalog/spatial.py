"""Nearest neighbours and graph statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import Tables, sql
from tallyscope.operators import graph, neighbors, stats, topk, transform


def knn_sql(k: int, where: str = "a.obs_id <> b.obs_id", points: str = "points") -> str:
    d = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
    return f"SELECT src, dst, rank, d2 FROM (SELECT a.obs_id AS src, b.obs_id AS dst, {d} AS d2, row_number() OVER (PARTITION BY a.obs_id ORDER BY {d}, b.obs_id) AS rank FROM {points} a JOIN {points} b ON {where}) WHERE rank <= {k}"


def _edges(t: Tables, k: int = 6):
    return neighbors.knn(t.points().select("obs_id", "x", "y"), k)


@query("nn1_knn", sql("SELECT src, dst, rank, d2 FROM knn6", "d2", "rank"))
def _(t: Tables):
    return _edges(t)


@query("nn1_knn_grid", sql("SELECT src, dst, rank, d2 FROM knn6", "d2", "rank"))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y")
    return neighbors.nearest(p, p, 6, same=True)


@query("nn1_knn_suppliers", sql(knn_sql(6, points="obs"), "d2", "rank"))
def _(t: Tables):
    return neighbors.knn(t.obs().select("obs_id", "x", "y"), 6)


@query("nn1_knn_vectors", sql("SELECT src, dst, rank, d * d AS d2 FROM vknn10", "d2", "rank"))
def _(t: Tables):
    return neighbors.knn_vectors(t.points().select("obs_id", "vec"), None, 10)


WITHIN = {"kw": knn_sql(6, "a.obs_id <> b.obs_id AND a.batch = b.batch")}


@query("nn2_knn_within", sql("SELECT p.batch, k.src, k.dst, k.rank, k.d2 FROM kw k JOIN points p ON p.obs_id = k.src", "d2", "rank", WITHIN))
def _(t: Tables):
    return neighbors.knn(t.points().select("obs_id", "batch", "x", "y"), 6, by=["batch"])


@query("nn2_graph_audit", sql(
    """SELECT batch, n_edges, n_self_edges, n_nodes, min_out_degree, max_out_degree, max_in_degree FROM (SELECT batch, count(*) AS n_edges, count(*) FILTER (WHERE src = dst) AS n_self_edges FROM kw JOIN points ON obs_id = src GROUP BY 1)
    JOIN (SELECT batch, count(*) AS n_nodes, min(o) AS min_out_degree, max(o) AS max_out_degree, max(i) AS max_in_degree FROM (SELECT p.batch, p.obs_id, (SELECT count(*) FROM kw WHERE src = p.obs_id) AS o, (SELECT count(*) FROM kw WHERE dst = p.obs_id) AS i FROM points p) GROUP BY 1) USING (batch)""", extra=WITHIN))
def _(t: Tables):
    return graph.graph_audit(neighbors.knn(t.points().select("obs_id", "batch", "x", "y"), 6, by=["batch"]), ["batch"])


COMPONENTS = """WITH RECURSIVE e AS (SELECT src AS u, dst AS v FROM k2 UNION SELECT dst, src FROM k2), reach(node, root) AS (SELECT obs_id, obs_id FROM pts UNION SELECT e.v, r.root FROM reach r JOIN e ON e.u = r.node)
SELECT node AS obs_id, min(root) AS component FROM reach GROUP BY 1"""
COMPONENTS_SQL = COMPONENTS.replace(
    "WITH RECURSIVE ", "WITH RECURSIVE pts AS (SELECT vec_id AS obs_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), k2 AS (" + knn_sql(2, points="pts") + "), "
)


@query("nn2_components", COMPONENTS_SQL)
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y")
    return graph.components(neighbors.knn(p, 2), p)


@query("nn3_knn_including_self", sql("SELECT src, dst, rank, d2 FROM knn5", "d2", "rank"))
def _(t: Tables):
    return neighbors.knn(t.points().select("obs_id", "x", "y"), 6, including_self=True)


def moran_sql(edges: str, dense: str = "dense_places", unit: bool = False, value: str = "value") -> str:
    factor = "max(n) / CAST(count(*) AS DOUBLE)" if unit else "1.0 / 6"
    return f"""SELECT feature_id, CASE WHEN max(den) > 0 THEN {factor} * sum((xi - m) * (xj - m)) / max(den) END AS moran FROM (SELECT i.feature_id, i.{value} AS xi, j.{value} AS xj, s.m, s.den, s.n FROM {edges} e
    JOIN {dense} i ON i.obs_id = e.src JOIN {dense} j ON j.obs_id = e.dst AND j.feature_id = i.feature_id JOIN (SELECT feature_id, avg({value}) AS m, var_pop({value}) * count(*) AS den, count(*) AS n FROM {dense} GROUP BY 1) s ON s.feature_id = i.feature_id) GROUP BY 1"""


@query("nn4_moran", sql(moran_sql("knn6"), "moran"))
def _(t: Tables):
    return graph.moran(t.place_counts(), graph.weighted(_edges(t), 6), t.points().select("obs_id"))


@query("nn5_moran_unit", sql(moran_sql("knn5", unit=True), "moran"))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y")
    return graph.moran_unit(t.place_counts(), neighbors.knn(p, 6, including_self=True), p)


SUPP = {"sk": knn_sql(6, points="obs"), "topg": "SELECT feature_id, row_number() OVER (ORDER BY avg(a) DESC, feature_id DESC) AS rank FROM cells_ab GROUP BY 1 QUALIFY rank <= 50",
        "pa": "SELECT d.* FROM dense_ref d JOIN topg USING (feature_id)", "pb": "SELECT d.* FROM dense_cand d JOIN topg USING (feature_id)"}


def _panel(t: Tables):
    o = t.obs().select("obs_id", "x", "y")
    top = topk.top_features(stats.gene_stats(t.ref(), o, (), t.features()), 50).select("feature_id", "rank")
    e = graph.weighted(neighbors.knn(o, 6), 6)
    return graph.moran_panel(t.ref(), t.cand(), e, e, o, o, top)


@query("nn6_moran_panel", sql(
    f"SELECT feature_id, rank, a.moran AS reference_moran, b.moran AS simulated_moran FROM topg LEFT JOIN ({moran_sql('sk', 'pa')}) a USING (feature_id) LEFT JOIN ({moran_sql('sk', 'pb')}) b USING (feature_id)",
    "reference_moran simulated_moran", "rank", SUPP))
def _(t: Tables):
    return _panel(t)


@query("nn6_moran_profile", sql(
    f"SELECT count(*) AS n_panel, count(a.moran + b.moran) AS n_valid, CASE WHEN count(a.moran + b.moran) >= 5 THEN corr(a.moran, b.moran) END AS moran_correlation FROM topg LEFT JOIN ({moran_sql('sk', 'pa')}) a USING (feature_id) LEFT JOIN ({moran_sql('sk', 'pb')}) b USING (feature_id)",
    "moran_correlation", "n_panel n_valid", SUPP))
def _(t: Tables):
    return graph.profile_corr(_panel(t))


@query("nn7_residual_moran", sql(
    moran_sql("knn5", "resid", True).replace(" AS moran FROM", " AS residual_moran FROM", 1), "residual_moran",
    extra={"resid": "SELECT obs_id, feature_id, value - avg(value) OVER (PARTITION BY label, feature_id) AS value FROM dense_places"}))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y", "label")
    return graph.residual_moran(t.place_counts(), neighbors.knn(p, 6, including_self=True), p)


LOOPS = {"loops": "SELECT src, dst FROM knn5 UNION ALL SELECT obs_id, obs_id FROM points"}


@query("nn8_smooth_values", sql("SELECT src AS obs_id, feature_id, avg(value) AS value FROM loops JOIN dense_places ON obs_id = dst GROUP BY 1, 2", "value", extra=LOOPS))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y")
    dense = transform.densify(t.place_counts(), p, t.dims())
    return graph.smooth_values(dense, neighbors.knn(p, 6, including_self=True), (), ["feature_id"])


@query("nn9_smooth_labels", sql(
    """SELECT obs_id, CASE WHEN v / 6.0 >= 0.34 THEN lead ELSE label END AS smoothed_label, v / 6.0 AS fraction FROM points JOIN (SELECT src, label AS lead, v FROM (SELECT src, label, count(*) AS v, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r FROM loops JOIN points ON obs_id = dst GROUP BY 1, 2) WHERE r = 1) ON src = obs_id""",
    "fraction", extra=LOOPS))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y", "label")
    return graph.smooth_labels(p, neighbors.knn(p, 6, including_self=True), list(range(10)), 0.34)


@query("nn10_knn_classify", sql(
    """SELECT src AS obs_id, lb AS predicted FROM (SELECT src, lb, count(*) AS v, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, lb) AS r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS k FROM vdist WHERE ba = 1 AND bb = 0) WHERE k <= 10 GROUP BY 1, 2) WHERE r = 1"""))
def _(t: Tables):
    p = t.points().select("obs_id", "vec", "label", "batch")
    ref, q = p.where("batch = 0"), p.where("batch = 1")
    return graph.vote(neighbors.knn_vectors(q, ref, 10), ref)


@query("nn11_label_purity", sql(
    "SELECT count(*) AS n_scored, avg(p) AS purity, 1.0 - avg(p) AS contamination FROM (SELECT src, avg(CASE WHEN la = lb THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM vknn10 WHERE la <> 0 GROUP BY 1)", "purity contamination", "n_scored"))
def _(t: Tables):
    p = t.points().select("obs_id", "vec", "label")
    return graph.label_purity(neighbors.knn_vectors(p, None, 10), p, unlabelled=["0"])


@query("nn12_batch_entropy", sql(
    "SELECT avg(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END) AS batch_entropy FROM (SELECT src, avg(CASE WHEN bb = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM vknn10 GROUP BY 1)", "batch_entropy"))
def _(t: Tables):
    p = t.points().select("obs_id", "vec", "batch")
    return graph.batch_entropy(neighbors.knn_vectors(p, None, 10), p, "batch", 1)


@query("nn13_knn_jaccard", sql(
    """SELECT batch, avg(c / (20.0 - c)) AS knn_jaccard FROM (SELECT p.batch, p.obs_id, CAST(count(v.dst) AS DOUBLE) AS c FROM points p LEFT JOIN s10 s ON s.src = p.obs_id LEFT JOIN v10 v ON v.src = s.src AND v.dst = s.dst GROUP BY 1, 2) GROUP BY 1""",
    "knn_jaccard", extra={"s10": knn_sql(10, "a.obs_id <> b.obs_id AND a.batch = b.batch"), "v10": "SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM vdist WHERE src <> dst AND ba = bb) WHERE rank <= 10"}))
def _(t: Tables):
    p = t.points().select("obs_id", "batch", "x", "y", "vec")
    return graph.knn_jaccard(neighbors.knn(p, 10, by=["batch"]), neighbors.knn_vectors(p, None, 10, ["batch"]), 10, ["batch"])


PAIRED = {
    "pd": "SELECT q.pair_id AS q, r.pair_id AS r, list_distance(q.vec, r.vec) AS d FROM points q CROSS JOIN points r WHERE q.batch = 1 AND r.batch = 0",
    "pm": "SELECT q, min(d) AS m, 1e-12 + 1e-9 * greatest(1.0, min(d)) AS tol, max(CASE WHEN q = r THEN d END) AS paired FROM pd GROUP BY 1",
    "pr": "SELECT pm.q AS pair_id, max(paired) AS paired_distance, max(paired) <= max(m) + max(tol) AS top1, 1 + count(*) FILTER (WHERE d < paired - tol) AS rank FROM pm JOIN pd ON pd.q = pm.q GROUP BY 1",
}


def _retrieval(t: Tables):
    p = t.points().select("pair_id", "vec", "batch")
    return neighbors.paired_retrieval(p.where("batch = 0"), p.where("batch = 1"), id_col="pair_id")


@query("nn14_paired_retrieval", sql("SELECT * FROM pr", "paired_distance", "rank", PAIRED))
def _(t: Tables):
    return _retrieval(t)


@query("nn14_retrieval_summary", sql(
    "SELECT count(*) AS n_queries, avg(CASE WHEN top1 THEN 1.0::DOUBLE ELSE 0.0 END) AS top1_rate, quantile_cont(CAST(rank AS DOUBLE), 0.5::DOUBLE) AS median_rank FROM pr", "top1_rate median_rank", "n_queries", PAIRED))
def _(t: Tables):
    return neighbors.retrieval_summary(_retrieval(t))


SIL = {
    "lab_d": "SELECT src, la, lb, sum(d) AS t, count(*) AS n FROM vdist GROUP BY 1, 2, 3",
    "sil": "SELECT src AS obs_id, la AS label, CASE WHEN max(CASE WHEN la = lb THEN n END) = 1 THEN 0.0 ELSE (min(CASE WHEN la <> lb THEN t / n END) - max(CASE WHEN la = lb THEN t / (n - 1) END)) / greatest(min(CASE WHEN la <> lb THEN t / n END), max(CASE WHEN la = lb THEN t / (n - 1) END)) END AS silhouette FROM lab_d GROUP BY 1, 2",
}


@query("nn15_silhouette_rows", sql("SELECT * FROM sil", "silhouette", extra=SIL))
def _(t: Tables):
    return neighbors.silhouette_rows(t.points().select("obs_id", "vec", "label"), "label")


@query("nn15_silhouette", sql("SELECT avg(silhouette) AS silhouette FROM sil", "silhouette", extra=SIL))
def _(t: Tables):
    return neighbors.silhouette(t.points().select("obs_id", "vec", "label"), "label")


ZS = {
    "zp": "SELECT obs_id, label, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM points",
    "z1": knn_sql(1, "a.obs_id <> b.obs_id AND a.label = b.label", "zp"),
}


@query("nn16_chaos", sql("SELECT sum(sqrt(d2)) / (SELECT count(*) FROM points) AS chaos FROM z1", "chaos", extra=ZS))
def _(t: Tables):
    p = transform.standardize_columns(t.points().select("obs_id", "label", "x", "y"), ["x", "y"])
    return graph.chaos(neighbors.knn(p, 1, by=["label"], strict=False).drop("label"), stats.n_obs(p))


@query("nn17_pas", sql(
    "SELECT avg(CASE WHEN f > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) AS pas FROM (SELECT e.src, avg(CASE WHEN a.label <> b.label THEN 1.0::DOUBLE ELSE 0.0 END) AS f FROM e10 e JOIN pq a ON a.obs_id = e.src JOIN pq b ON b.obs_id = e.dst GROUP BY 1)",
    "pas", extra={"e10": knn_sql(10), "pq": "SELECT obs_id, CAST(x > 0 AS INTEGER) AS label FROM points"}))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y", (F.col("x") > 0).cast("int").alias("label"))
    return graph.pas(neighbors.knn(p, 10), p)


@query("nn18_spot_spacing", sql("SELECT quantile_cont(sqrt(d2), 0.5::DOUBLE) AS spacing FROM knn6 WHERE rank = 1", "spacing"))
def _(t: Tables):
    from tallyscope.functions.ordered import exact_quantiles

    e = neighbors.knn(t.points().select("obs_id", "x", "y"), 1).withColumn("d", F.sqrt("d2"))
    return exact_quantiles(e, (), "d", {"spacing": 0.5})


@query("nn19_nn_transfer", sql(
    """SELECT avg(CASE WHEN qp = rp THEN 1.0::DOUBLE ELSE 0.0 END) AS identity_accuracy, avg(CASE WHEN ql = rl THEN 1.0::DOUBLE ELSE 0.0 END) AS region_accuracy, avg(sqrt(d2)) AS mean_distance FROM (SELECT a.pair_id AS qp, b.pair_id AS rp, a.label AS ql, b.label AS rl, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
    row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.obs_id) AS k FROM points a JOIN points b ON a.batch = 1 AND b.batch = 0) WHERE k = 1""", "identity_accuracy region_accuracy mean_distance"))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y", "label", "pair_id", "batch")
    q, r = p.where("batch = 1"), p.where("batch = 0")
    return graph.nn_transfer(neighbors.knn_transfer(q, r), q, r, "pair_id")


@query("nn20_modularity", sql(
    """SELECT sum(i / m2 - (g / m2) * (g / m2)) AS modularity FROM (SELECT c, sum(w) FILTER (WHERE s) AS i, sum(w) AS g FROM (SELECT a.label AS c, a.label = b.label AS s, CASE WHEN a.label = b.label THEN 1.0 ELSE 1.0 END AS w FROM knn6 JOIN points a ON a.obs_id = src JOIN points b ON b.obs_id = dst
    UNION ALL SELECT b.label, a.label = b.label, 1.0 FROM knn6 JOIN points a ON a.obs_id = src JOIN points b ON b.obs_id = dst) GROUP BY 1) CROSS JOIN (SELECT 2.0 * count(*) AS m2 FROM knn6)""", "modularity"))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y", F.col("label").alias("cluster"))
    return graph.modularity(neighbors.knn(p, 6), p)


MODS = " UNION ALL ".join(
    f"""SELECT {r} AS resolution, sum(i / m2 - (g / m2) * (g / m2)) AS modularity FROM (SELECT c, sum(w) FILTER (WHERE s) AS i, sum(w) AS g FROM (SELECT a.label % {r} AS c, a.label % {r} = b.label % {r} AS s, 1.0 AS w FROM knn6 JOIN points a ON a.obs_id = src JOIN points b ON b.obs_id = dst
    UNION ALL SELECT b.label % {r}, a.label % {r} = b.label % {r}, 1.0 FROM knn6 JOIN points a ON a.obs_id = src JOIN points b ON b.obs_id = dst) GROUP BY 1) CROSS JOIN (SELECT 2.0 * count(*) AS m2 FROM knn6)""" for r in (2, 3, 5))


@query("nn20_select_resolution", sql(f"SELECT CAST(resolution AS INTEGER) AS resolution, modularity FROM ({MODS}) ORDER BY modularity DESC, resolution LIMIT 1", "modularity"))
def _(t: Tables):
    p = t.points().select("obs_id", "x", "y", "label")
    levels = F.array(F.lit(2), F.lit(3), F.lit(5))
    runs = p.withColumn("resolution", F.explode(levels)).withColumn("cluster", F.col("label") % F.col("resolution"))
    e = neighbors.knn(p, 6).withColumn("resolution", F.explode(levels))
    return graph.select_resolution(graph.modularity(e, runs, ["resolution"]))


CENTROID = {
    "marks": "SELECT obs_id, label, feature_id, CAST(value AS DOUBLE) AS value FROM dense_places",
    "cent": "SELECT label, feature_id, avg(value) AS c FROM marks GROUP BY 1, 2",
    "sims": "SELECT m.obs_id, m.label AS truth, c.label, CASE WHEN sqrt(sum(m.value * m.value)) > 0 THEN greatest(least(sum(m.value * c.c) / greatest(sqrt(sum(m.value * m.value)), 1e-8) / greatest(sqrt(sum(c.c * c.c)), 1e-8), 1.0), 0.0) ELSE 0.0 END AS s FROM marks m JOIN cent c USING (feature_id) GROUP BY 1, 2, 3",
}


@query("nn21_centroid_classify", sql(
    """SELECT obs_id, CASE WHEN s < 0.35 THEN 'Other' ELSE CAST(label AS VARCHAR) END AS predicted, s AS best_score, s - s2 AS confidence FROM (SELECT obs_id, label, s, lead(s) OVER (PARTITION BY obs_id ORDER BY round(s, 9) DESC, label) AS s2, row_number() OVER (PARTITION BY obs_id ORDER BY round(s, 9) DESC, label) AS r FROM sims) WHERE r = 1""",
    "best_score confidence", extra=CENTROID))
def _(t: Tables):
    p = t.points().select("obs_id", "label")
    return graph.centroid_classify(t.place_counts(), graph.centroids(t.place_counts(), p), p, 0.35)


@query("nn22_rule_scores", sql(
    """SELECT obs_id, region, score FROM (SELECT obs_id, greatest(m0, m1, m2) AS top, sqrt(greatest(m3, 0.0) * greatest(greatest(m0, m4), 0.0)) AS mixed, greatest(m5 - 0.35::DOUBLE * m4, 0.0) AS clipped FROM (SELECT obs_id, """
    + ", ".join(f"CAST(coalesce(max(value) FILTER (WHERE feature_id = {i}), 0) AS DOUBLE) AS m{i}" for i in range(6)) + " FROM dense_places GROUP BY 1)) UNPIVOT (score FOR region IN (top, mixed, clipped))", "score"))
def _(t: Tables):
    wide = transform.densify(t.place_counts(), t.points().select("obs_id"), t.dims()).groupBy("obs_id").pivot("feature_id", list(range(6))).agg(F.max("value"))
    m = [F.col(f"`{i}`").cast("double") for i in range(6)]
    rules = {
        "top": graph.rule_max(m[0], m[1], m[2]), "mixed": graph.rule_product(m[3], F.greatest(m[0], m[4])), "clipped": graph.rule_difference(m[5], m[4], 0.35),
    }
    return graph.rule_scores(wide, rules, ["obs_id"])


@query("nn23_tune_grid", sql(
    """SELECT p, n, accuracy, macro_f1 FROM (SELECT p, max(n) AS n, max(acc) AS accuracy, avg(f1) AS macro_f1 FROM (SELECT p, l, sum(CASE WHEN truth = l AND label = l THEN 1 ELSE 0 END) AS tp, count(*) AS n, avg(CASE WHEN truth = label THEN 1.0::DOUBLE ELSE 0.0 END) AS acc,
    CASE WHEN sum(CASE WHEN truth = l OR label = l THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN truth = l THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN label = l THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN truth = l AND label = l THEN 1 ELSE 0 END) > 0 THEN 2.0 * sum(CASE WHEN truth = l AND label = l THEN 1 ELSE 0 END) / (sum(CASE WHEN truth = l THEN 1 ELSE 0 END) + sum(CASE WHEN label = l THEN 1 ELSE 0 END)) END AS f1
    FROM (SELECT p, obs_id, truth, label FROM (SELECT p, obs_id, truth, label, row_number() OVER (PARTITION BY p, obs_id ORDER BY round(s, 9) DESC, label) AS r FROM gs) WHERE r = 1) CROSS JOIN (SELECT DISTINCT label AS l FROM points) GROUP BY 1, 2) GROUP BY 1) ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, n DESC, p LIMIT 1""",
    "accuracy macro_f1", "p n", {
        "qs": " UNION ALL ".join(f"SELECT batch, feature_id, {p} AS p, quantile_cont(CAST(value AS DOUBLE), {p / 100.0}::DOUBLE) AS q FROM (SELECT d.*, o.batch FROM dense_places d JOIN points o USING (obs_id)) GROUP BY 1, 2" for p in (80, 95)),
        "sc": "SELECT d.obs_id, o.batch, d.label, d.feature_id, q.p, greatest(least(d.value / CASE WHEN q.q > 0 THEN q.q ELSE 1.0 END, 1.0), 0.0) AS value FROM dense_places d JOIN points o USING (obs_id) JOIN qs q ON q.batch = o.batch AND q.feature_id = d.feature_id",
        "ce": "SELECT p, 1 - batch AS batch, label, feature_id, avg(value) AS c FROM sc GROUP BY 1, 2, 3, 4",
        "gs": "SELECT m.p, m.obs_id, m.label AS truth, c.label, CASE WHEN sqrt(sum(m.value * m.value)) > 0 THEN greatest(least(sum(m.value * c.c) / greatest(sqrt(sum(m.value * m.value)), 1e-8) / greatest(sqrt(sum(c.c * c.c)), 1e-8), 1.0), 0.0) ELSE 0.0 END AS s FROM sc m JOIN ce c ON c.p = m.p AND c.batch = m.batch AND c.feature_id = m.feature_id GROUP BY 1, 2, 3, 4",
    }))
def _(t: Tables):
    obs = t.points().select("obs_id", "batch", "label")
    dense = transform.densify(t.place_counts(), obs, t.dims()).join(obs, "obs_id")
    grid = dense.withColumn("p", F.explode(F.array(F.lit(80), F.lit(95))))
    scaled = None
    for p in (80, 95):
        part = transform.robust_scale(grid.where(F.col("p") == p), p, ["p", "batch", "feature_id"])
        scaled = part if scaled is None else scaled.unionByName(part)
    return graph.tune_grid(scaled, ["p"], "batch").withColumn("p", F.col("p").cast("long"))
