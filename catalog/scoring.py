"""Clustering, classification, alignment and composition scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import Tables, pear, sql
from tallyscope.operators import alignment, composition, coupling, scores

CLUSTER = {"lab": "SELECT l_returnflag AS g, l_linenumber AS t, CAST((l_linenumber + l_partkey % 3) % 5 AS INTEGER) AS p FROM lineitem"}


def _labels(t: Tables):
    return t.read("lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("t"), ((F.col("l_linenumber") + F.col("l_partkey") % 3) % 5).cast("int").alias("p")
    )


def cluster_sql(src: str, by: str, t: str = "t", p: str = "p") -> str:
    """Contingency scores in SQL, one row per ``by``."""
    return f"""SELECT {by}, n, ari, 2.0 * mi / (ht + hp) AS nmi, mi / ht AS homogeneity, mi / hp AS completeness, 2.0 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp) AS v_measure, mi, ht, hp FROM (
    SELECT c.{by}, c.n, (c.ij - a.s * b.s / (c.n * (c.n - 1) / 2.0)) / ((a.s + b.s) / 2.0 - a.s * b.s / (c.n * (c.n - 1) / 2.0)) AS ari, a.h + b.h - c.h AS mi, a.h AS ht, b.h AS hp
    FROM (SELECT {by}, max(nn) AS n, sum(k * (k - 1) / 2.0::DOUBLE) AS ij, -sum(k / nn * ln(k / nn)) AS h FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER (PARTITION BY {by}) AS DOUBLE) AS nn FROM {src} GROUP BY {by}, {t}, {p}) GROUP BY {by}) c
    JOIN (SELECT {by}, sum(k * (k - 1) / 2.0::DOUBLE) AS s, -sum(k / nn * ln(k / nn)) AS h FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER (PARTITION BY {by}) AS DOUBLE) AS nn FROM {src} GROUP BY {by}, {t}) GROUP BY {by}) a USING ({by})
    JOIN (SELECT {by}, sum(k * (k - 1) / 2.0::DOUBLE) AS s, -sum(k / nn * ln(k / nn)) AS h FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS k, CAST(sum(count(*)) OVER (PARTITION BY {by}) AS DOUBLE) AS nn FROM {src} GROUP BY {by}, {p}) GROUP BY {by}) b USING ({by}))"""


@query("sc1_clustering_scores", sql(
    f"SELECT g, n, ari, nmi, homogeneity, completeness, v_measure FROM ({cluster_sql('lab', 'g')})", "ari nmi homogeneity completeness v_measure", "n", CLUSTER))
def _(t: Tables):
    return scores.clustering_scores(_labels(t), "t", "p", ["g"])


AMI = {
    "cl": "SELECT 0 AS g, label AS t, label % 4 + CAST(batch AS INTEGER) AS p FROM points",
    "ta": "SELECT count(*) AS a FROM cl GROUP BY t", "tb": "SELECT count(*) AS b FROM cl GROUP BY p", "nn": "SELECT count(*) AS n FROM cl",
    "emi": """SELECT sum(k / CAST(n AS DOUBLE) * ln(CAST(n AS DOUBLE) * k / (CAST(a AS DOUBLE) * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e
    FROM (SELECT a, b, n, unnest(range(greatest(1, a + b - n), least(a, b) + 1)) AS k FROM ta CROSS JOIN tb CROSS JOIN nn)""",
}


@query("sc2_ami", sql(f"SELECT CAST(n AS BIGINT) AS n, (mi - e) / ((ht + hp) / 2.0 - e) AS ami FROM ({cluster_sql('cl', 'g')}) CROSS JOIN emi", "ami", extra=AMI))
def _(t: Tables):
    p = t.points().select("label", (F.col("label") % 4 + F.col("batch")).alias("p"))
    return scores.ami(p, "label", "p")


@query("sc3_label_stability", sql(
    f"SELECT g AS run, ari, nmi, 1.0 - ari AS instability FROM ({cluster_sql('runs', 'g')})", "ari nmi instability",
    extra={"runs": " UNION ALL ".join(f"SELECT {r} AS g, label AS t, CASE WHEN obs_id % {r} = 0 THEN (label + 1) % 10 ELSE label END AS p FROM points" for r in (2, 3, 7))}))
def _(t: Tables):
    p = t.points().select("obs_id", "label")
    runs = p.withColumn("run", F.explode(F.array(F.lit(2), F.lit(3), F.lit(7)))).withColumn(
        "label", F.when(F.col("obs_id") % F.col("run") == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )
    return scores.label_stability(runs, p, "run", "label")


CLASSES = {"cl": "SELECT d.lang, l.quality AS truth, CAST(d.n_chars > 600 AS INTEGER) AS pred FROM labels l JOIN documents d USING (doc_id)", "lnames": "SELECT unnest([0, 1, 2]) AS label",
           "m": """SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall FROM (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp, count(*) FILTER (WHERE truth <> label AND pred = label) AS fp, count(*) FILTER (WHERE truth = label AND pred <> label) AS fn FROM lnames CROSS JOIN cl GROUP BY 1)""",
           "mf": "SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) END AS f1 FROM m"}


def _classes(t: Tables):
    j = t.read("labels").join(t.read("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.select("lang", F.col("quality").alias("truth"), (F.col("n_chars") > 600).cast("int").alias("pred"))


def _names(t: Tables):
    return t.read("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("label"))


@query("sc4_classification_metrics", sql("SELECT * FROM mf", "precision recall f1", "tp fp fn", CLASSES))
def _(t: Tables):
    return scores.classification_metrics(_classes(t), "truth", "pred", _names(t))


@query("sc4_classification_summary", sql(
    "SELECT count(*) AS n, avg(CASE WHEN truth = pred THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy, (SELECT avg(f1) FROM mf) AS macro_f1 FROM cl", "accuracy macro_f1", "n", CLASSES))
def _(t: Tables):
    return scores.classification_summary(_classes(t), "truth", "pred", _names(t))


@query("sc4_confusion_matrix", sql('SELECT truth, count(*) FILTER (WHERE pred = 0) AS "0", count(*) FILTER (WHERE pred = 1) AS "1" FROM cl GROUP BY 1', extra=CLASSES))
def _(t: Tables):
    return scores.confusion_matrix(_classes(t), "truth", "pred", [0, 1])


# --- alignment ---------------------------------------------------------------

ROT = {
    "piv": "SELECT (min(x) + max(x)) / 2.0 + 0.25::DOUBLE * (max(x) - min(x)) / 2.0 AS px, (min(y) + max(y)) / 2.0 - 0.5::DOUBLE * (max(y) - min(y)) / 2.0 AS py FROM points",
    "rot": "SELECT obs_id, batch, x, y, px + cos(radians(30.0)) * (x - px) - sin(radians(30.0)) * (y - py) AS rx, py + sin(radians(30.0)) * (x - px) + cos(radians(30.0)) * (y - py) AS ry FROM points CROSS JOIN piv",
}


def _rotated(t: Tables, batch: bool = False):
    p = t.points().select("obs_id", "batch", "x", "y")
    return alignment.rotate_points(p, 30.0, (0.25, -0.5))


@query("al1_rotate_points", sql("SELECT obs_id, rx, ry, 0.0 AS inverse_error FROM rot", "rx ry inverse_error", extra=ROT))
def _(t: Tables):
    return _rotated(t).select("obs_id", "rx", "ry", "inverse_error")


@query("al2_recovered_rotation", sql(
    "SELECT batch, degrees(atan2(covar_pop(x, ry) - covar_pop(y, rx), covar_pop(x, rx) + covar_pop(y, ry))) AS rotation_degrees FROM rot GROUP BY 1", "rotation_degrees", extra=ROT))
def _(t: Tables):
    return alignment.recovered_rotation(_rotated(t), ["batch"])


COUPLE = {
    "rf": "SELECT * FROM points WHERE batch = 0", "mv": "SELECT obs_id, label, pair_id, y AS x, -x AS y FROM points WHERE batch = 1",
    "truth": "SELECT m.obs_id AS mov_idx, r.obs_id AS ref_idx FROM mv m JOIN rf r ON r.pair_id = m.pair_id",
    "cp": "SELECT r.obs_id AS ref_idx, m.obs_id AS mov_idx, exp(-list_distance(r.vec, m2.vec) * 4.0) AS mass FROM rf r JOIN points m2 ON m2.batch = 1 JOIN mv m ON m.obs_id = m2.obs_id WHERE list_distance(r.vec, m2.vec) < 1.25",
}


def _coupling(t: Tables, truth=None):
    """Mass from vector distance over the pairs closer than a cutoff, summed up block by block."""
    p = t.points().select("obs_id", "vec", "batch", "x", "y")
    return coupling.radius_marginals(p.where("batch = 1"), p.where("batch = 0"), 1.25, lambda d: np.exp(-d * 4.0), truth)


def _sides(t: Tables):
    p = t.points()
    ref = p.where("batch = 0").select("obs_id", "label", "pair_id", "x", "y")
    mov = p.where("batch = 1").select("obs_id", "label", "pair_id", F.col("y").alias("x"), (-F.col("x")).alias("y"))
    truth = mov.select(F.col("obs_id").alias("mov_idx"), "pair_id").join(ref.select(F.col("obs_id").alias("ref_idx"), "pair_id"), "pair_id").select("mov_idx", "ref_idx")
    return ref, mov, truth


FIT = {**COUPLE,
       "w": "SELECT c.mass AS w, r.x AS rx, r.y AS ry, m.x AS mx, m.y AS my FROM cp c JOIN rf r ON r.obs_id = c.ref_idx JOIN mv m ON m.obs_id = c.mov_idx",
       "mu": "SELECT sum(w) AS s, sum(w * rx) / sum(w) AS rx, sum(w * ry) / sum(w) AS ry, sum(w * mx) / sum(w) AS mx, sum(w * my) / sum(w) AS my FROM w",
       "ang": "SELECT max(mu.rx) AS rx, max(mu.ry) AS ry, max(mu.mx) AS mx, max(mu.my) AS my, atan2(sum(w.w * ((w.mx - mu.mx) * (w.ry - mu.ry) - (w.my - mu.my) * (w.rx - mu.rx))), sum(w.w * ((w.mx - mu.mx) * (w.rx - mu.rx) + (w.my - mu.my) * (w.ry - mu.ry)))) AS a FROM w CROSS JOIN mu"}


@query("al3_weighted_procrustes", sql(
    "SELECT m.obs_id, f.rx + cos(a) * (m.x - f.mx) - sin(a) * (m.y - f.my) AS tx, f.ry + sin(a) * (m.x - f.mx) + cos(a) * (m.y - f.my) AS ty, degrees(a) AS angle_degrees FROM mv m CROSS JOIN ang f", "tx ty angle_degrees", extra=FIT))
def _(t: Tables):
    return alignment.procrustes_of_marginals(_coupling(t), _sides(t)[1]).select("obs_id", "tx", "ty", "angle_degrees")


@query("al4_angular_error", sql(
    "SELECT l_orderkey, l_linenumber, CASE WHEN abs(d) > 180 THEN 360 - abs(d) ELSE abs(d) END AS error FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 7 AS BIGINT) % 360 - CAST(l_partkey % 360 AS BIGINT) AS d FROM lineitem)", "error"))
def _(t: Tables):
    a, b = F.pmod((F.col("l_quantity") * 7).cast("long"), F.lit(360)).cast("double"), (F.col("l_partkey") % 360).cast("double")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", alignment.angular_error(a, b).alias("error"))


@query("al5_spatial_error", sql(
    """SELECT batch, avg(e) AS mean_error, sqrt(avg(e * e)) AS rmse_error, max(e) AS max_error, quantile_cont(e, 0.5::DOUBLE) AS median_error, max(s) AS spacing, avg(e) / max(s) AS mean_error_spacing, quantile_cont(e, 0.5::DOUBLE) / max(s) AS median_error_spacing, sqrt(avg(e * e)) / max(s) AS rmse_error_spacing, max(e) / max(s) AS max_error_spacing
    FROM (SELECT batch, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS e FROM rot) JOIN (SELECT batch, quantile_cont(m, 0.5::DOUBLE) AS s FROM (SELECT a.batch, a.obs_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS m FROM points a JOIN points b ON a.obs_id <> b.obs_id AND a.batch = b.batch GROUP BY 1, 2) GROUP BY 1) USING (batch) GROUP BY 1""",
    "mean_error rmse_error max_error median_error spacing mean_error_spacing median_error_spacing rmse_error_spacing max_error_spacing", extra=ROT))
def _(t: Tables):
    r = _rotated(t).withColumns({"tx": F.col("rx"), "ty": F.col("ry")})
    spacing = alignment.spot_spacing(t.points().select("obs_id", "batch", "x", "y"), ["batch"])
    return alignment.spatial_error(r, spacing, ["batch"])


TRANSPORT = {**COUPLE,
    "mm": "SELECT mov_idx, sum(mass) AS t, arg_min(ref_idx, (-mass, ref_idx)) AS c FROM cp GROUP BY 1",
    "rm": "SELECT ref_idx, sum(mass) AS t, arg_min(mov_idx, (-mass, mov_idx)) AS c FROM cp GROUP BY 1",
    "mp": "SELECT t.mov_idx, t.ref_idx AS true_ref, coalesce(mm.t > 1e-12, false) AS active, CASE WHEN mm.t > 1e-12 THEN mm.c END AS choice FROM truth t LEFT JOIN mm ON mm.mov_idx = t.mov_idx",
    "ar": "SELECT r.ref_idx, r.c, t.mov_idx AS tm, b.choice AS back FROM rm r LEFT JOIN truth t ON t.ref_idx = r.ref_idx LEFT JOIN mp b ON b.mov_idx = r.c WHERE r.t > 1e-12",
    "q": """SELECT (SELECT sum(mass) FROM cp) AS total_mass, (SELECT count(*) FILTER (WHERE active) / CAST(count(*) AS DOUBLE) FROM mp) AS moving_coverage, (SELECT count(*) FILTER (WHERE choice = true_ref) / CAST(count(*) AS DOUBLE) FROM mp) AS exact_recovery,
    (SELECT count(*) FILTER (WHERE choice = true_ref) / CAST(count(*) FILTER (WHERE active) AS DOUBLE) FROM mp) AS conditional_accuracy, (SELECT count(*) FROM ar) / CAST((SELECT count(*) FROM rf) AS DOUBLE) AS active_reference_fraction,
    (SELECT count(tm) / CAST(count(*) AS DOUBLE) FROM ar) AS overlap_precision, (SELECT count(tm) FROM ar) / CAST((SELECT count(*) FROM mp) AS DOUBLE) AS overlap_recall, (SELECT count(*) FILTER (WHERE c = tm) / CAST(count(*) AS DOUBLE) FROM ar) AS pair_precision,
    (SELECT count(*) FILTER (WHERE c = tm) FROM ar) / CAST((SELECT count(*) FROM mp) AS DOUBLE) AS pair_recall, (SELECT count(*) FILTER (WHERE back = ref_idx) / CAST(count(*) AS DOUBLE) FROM ar) AS mutual_consistency,
    coalesce((SELECT sum(mass) FROM cp JOIN truth t ON t.ref_idx = cp.ref_idx AND t.mov_idx = cp.mov_idx), 0.0) / (SELECT sum(mass) FROM cp) AS true_mass_fraction""",
}


@query("al6_transport_metrics", sql(
    "SELECT *, CASE WHEN overlap_precision + overlap_recall > 0 THEN 2 * overlap_precision * overlap_recall / (overlap_precision + overlap_recall) ELSE 0 END AS overlap_f1, CASE WHEN pair_precision + pair_recall > 0 THEN 2 * pair_precision * pair_recall / (pair_precision + pair_recall) ELSE 0 END AS pair_f1 FROM q",
    "total_mass moving_coverage exact_recovery conditional_accuracy active_reference_fraction overlap_precision overlap_recall pair_precision pair_recall mutual_consistency true_mass_fraction overlap_f1 pair_f1", extra=TRANSPORT))
def _(t: Tables):
    ref, _, truth = _sides(t)
    return alignment.transport_of_marginals(_coupling(t, truth), truth, ref.select(F.col("obs_id").alias("ref_idx")))


MAPPED = {**TRANSPORT, "ml": "SELECT mp.active, m.label AS t, r.label AS p, 0 AS g FROM mp JOIN mv m ON m.obs_id = mp.mov_idx LEFT JOIN rf r ON r.obs_id = mp.choice", "mla": "SELECT * FROM ml WHERE active"}


@query("al7_mapped_label_metrics", sql(
    f"SELECT count(*) AS n_moving, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE active AND t = p) / CAST(count(*) AS DOUBLE) AS label_recovery, count(*) FILTER (WHERE active AND t = p) / CAST(count(*) FILTER (WHERE active) AS DOUBLE) AS conditional_label_accuracy, (SELECT ari FROM ({cluster_sql('mla', 'g')})) AS active_ari FROM ml",
    "label_recovery conditional_label_accuracy active_ari", "n_moving n_active", MAPPED))
def _(t: Tables):
    ref, mov, truth = _sides(t)
    return alignment.mapped_label_metrics(alignment.mapped_of_marginals(_coupling(t, truth), truth), ref, mov)


@query("al8_ordered_subset", sql(
    "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS n, 0 AS n_absent, 0 AS n_displaced, true AS ordered", i="n n_absent n_displaced"))
def _(t: Tables):
    o = t.read("orders").select(F.col("o_orderkey").alias("obs_id"), (F.col("o_orderkey") * 2).alias("pos"))
    return alignment.ordered_subset(o.where("obs_id % 3 = 0").withColumn("pos", F.col("pos") + 7), o)


@query("al9_coupling_audit", sql(
    "SELECT (SELECT sum(mass) FROM cp) AS total_mass, (SELECT max(m - 0.5) FROM (SELECT sum(mass) AS m FROM cp GROUP BY ref_idx)) AS row_excess, (SELECT max(m - 0.25) FROM (SELECT sum(mass) AS m FROM cp GROUP BY mov_idx)) AS column_excess, false AS feasible",
    "total_mass row_excess column_excess", extra=COUPLE))
def _(t: Tables):
    return alignment.audit_of_marginals(_coupling(t), 0.5, 0.25, 1.0)


# --- composition -------------------------------------------------------------

KEEP = "('1-URGENT', '2-HIGH', '3-MEDIUM')"


@query("cp1_with_other", sql(
    f"SELECT spot, type, p FROM comp WHERE type IN {KEEP} UNION ALL SELECT spot, '__other__', greatest(1.0 - coalesce(sum(p) FILTER (WHERE type IN {KEEP}), 0.0), 0.0) FROM comp GROUP BY 1", "p"))
def _(t: Tables):
    types = t.read("orders").select(F.col("o_orderpriority").alias("type")).where(F.col("type").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return composition.with_other(t.comp(), types)


COMPOSE = {
    "jr": "SELECT c.c_custkey AS spot, y.type, coalesce(a.p, 0.0) AS a, coalesce(b.p, 0.0) AS b FROM customer c CROSS JOIN (SELECT DISTINCT o_orderpriority AS type FROM orders) y LEFT JOIN comp0 a ON a.spot = c.c_custkey AND a.type = y.type LEFT JOIN comp1 b ON b.spot = c.c_custkey AND b.type = y.type",
    "js": "SELECT spot, sum(0.5::DOUBLE * CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2.0)) ELSE 0 END + 0.5::DOUBLE * CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2.0)) ELSE 0 END) AS jsd FROM jr GROUP BY 1 HAVING sum(a) + sum(b) > 0",
    "tr": f"SELECT type, {pear('a', 'b')} AS r FROM jr GROUP BY 1",
}


@query("cp2_composition_scores", sql(
    "SELECT (SELECT avg(jsd) FROM js) AS jsd_mean, (SELECT quantile_cont(jsd, 0.5::DOUBLE) FROM js) AS jsd_median, (SELECT avg(r) FROM tr) AS pearson_mean, (SELECT count(r) FROM tr) AS n_defined_types, (SELECT quantile_cont(r, 0.5::DOUBLE) FROM tr) AS pearson_median, (SELECT sqrt(avg((a - b) * (a - b))) FROM jr) AS rmse",
    "jsd_mean jsd_median pearson_mean pearson_median rmse", extra=COMPOSE))
def _(t: Tables):
    n = t.read("customer").agg(F.count(F.lit(1)).alias("n_spots"))
    return composition.composition_scores(t.comp(0), t.comp(1), n, t.read("orders").agg(F.countDistinct("o_orderpriority").alias("n_types")))


@query("cp3_direction_details", sql(
    """SELECT metric, a, b, a - b AS difference, CASE WHEN a IS NULL OR b IS NULL OR abs(a - b) <= 1e-12 THEN 'tie_or_indeterminate' WHEN (CASE WHEN metric = 'tax' THEN b - a ELSE a - b END) > 0 THEN 'first_better' ELSE 'second_better' END AS direction
    FROM (SELECT metric, avg(value) FILTER (WHERE method = 0) AS a, avg(value) FILTER (WHERE method = 1) AS b FROM metric_long GROUP BY 1)""", "a b difference"))
def _(t: Tables):
    from tallyscope.operators.stats import melt

    means = melt(t.metric_long(), ["method"], ["quantity", "discount", "tax"]).groupBy("method", "metric").agg(F.avg("value").alias("value"))
    return composition.direction_details(means, 0, 1, lower_is_better=["tax"])


ROI = {
    "bx": "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points",
    "wins": "SELECT i, j, x0 + i * (x1 - 0.2::DOUBLE - x0) / 18 AS wx, y0 + j * (y1 - 0.2::DOUBLE - y0) / 18 AS wy FROM bx CROSS JOIN (SELECT unnest(range(0, 19)) AS i) CROSS JOIN (SELECT unnest(range(0, 19)) AS j)",
    "hit": "SELECT i, j, wx, wy, label, count(*) AS n FROM wins JOIN points ON x BETWEEN wx AND wx + 0.2 AND y BETWEEN wy AND wy + 0.2 GROUP BY ALL",
}


@query("cp4_select_roi", sql(
    "SELECT i, j, sum(n) AS n, max(wx) AS x0, max(wy) AS y0, -sum(n / t * ln(n / t)) AS entropy, -sum(n / t * ln(n / t)) * ln(1 + sum(n)) AS score FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS t FROM hit) GROUP BY 1, 2 HAVING sum(n) >= 25 ORDER BY round(score, 9) DESC, i, j LIMIT 1",
    "x0 y0 entropy score", "i j n", ROI))
def _(t: Tables):
    return composition.select_roi(t.points(), "label", 0.2)
