"""Quality control, normalisation and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from catalog.tables import Tables, sql
from tallyscope.operators import qc, stats, transform

RULES = {"min_counts": 12000, "min_genes": 400, "min_cells": 28, "max_pct_mt": 43.0}
QC_EXTRA = {
    "obs_qc": "SELECT o.obs_id, CAST(coalesce(t, 0) AS BIGINT) AS total_counts, coalesce(g, 0) AS n_genes_by_counts, CASE WHEN coalesce(t, 0) > 0 THEN m / CAST(t AS DOUBLE) * 100.0 ELSE 0.0 END AS pct_counts_mt FROM obs o LEFT JOIN (SELECT obs_id, sum(value) AS t, count(*) FILTER (WHERE value > 0) AS g, coalesce(sum(value) FILTER (WHERE mt), 0) AS m FROM counts JOIN features USING (feature_id) GROUP BY 1) s ON s.obs_id = o.obs_id",
    "kept_obs": "SELECT obs_id FROM obs_qc WHERE total_counts >= 12000 AND n_genes_by_counts >= 400 AND (pct_counts_mt IS NULL OR pct_counts_mt <= 43.0)",
    "kept_features": "SELECT feature_id FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 28",
}


@query("qc1_check_counts", sql(
    """SELECT l_returnflag AS dataset, count(*) AS n_values, count(*) FILTER (WHERE NOT isfinite(l_discount)) AS n_nonfinite,
    count(*) FILTER (WHERE abs(l_discount - round_even(l_discount, 0)) > 1e-6) AS n_fractional, count(*) FILTER (WHERE l_discount < 0) AS n_negative,
    count(*) FILTER (WHERE l_discount = 0) AS n_explicit_zero,
    count(*) FILTER (WHERE NOT isfinite(l_discount) OR abs(l_discount - round_even(l_discount, 0)) > 1e-6 OR l_discount < 0) = 0 AS is_count_table
    FROM lineitem GROUP BY 1"""))
def _(t: Tables):
    rows = t.read("lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_discount").alias("value"))
    return qc.check_counts(rows, ["dataset"])


@query("qc2_obs_qc", sql("SELECT * FROM obs_qc", "pct_counts_mt", "total_counts n_genes_by_counts", QC_EXTRA))
def _(t: Tables):
    return qc.obs_qc(t.counts(), t.obs(), t.features())


@query("qc3_apply_qc", sql(
    "SELECT c.obs_id, c.feature_id, c.value FROM counts c JOIN kept_obs USING (obs_id) JOIN kept_features USING (feature_id)", extra=QC_EXTRA))
def _(t: Tables):
    return qc.apply_qc(t.counts(), t.obs(), t.features(), **RULES).select("obs_id", "feature_id", "value")


@query("qc4_qc_stats", sql(
    "SELECT (SELECT count(*) FROM obs) AS n_obs_before_qc, (SELECT count(*) FROM features) AS n_vars_before_qc, (SELECT count(*) FROM kept_obs) AS n_obs, (SELECT count(*) FROM kept_features) AS n_vars", extra=QC_EXTRA))
def _(t: Tables):
    return qc.qc_stats(t.counts(), t.obs(), t.features(), **RULES)


@query("qc5_unique_names", sql(
    "SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || k END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)"))
def _(t: Tables):
    return qc.unique_names(t.read("part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("qc6_drop_unlabelled", sql(
    "SELECT doc_id, label FROM (SELECT doc_id, CASE WHEN trim(lang) = '' OR upper(trim(lang)) IN ('NA', 'NAN') OR lang IS NULL OR lang = 'fr' THEN 'unknown' ELSE trim(lang) END AS label FROM documents) WHERE label <> 'unknown'"))
def _(t: Tables):
    lang = F.when(F.col("lang") == "fr", F.lit("NA")).otherwise(F.concat(F.lit(" "), F.col("lang"), F.lit(" ")))
    d = t.read("documents").select("doc_id", qc.normalize_label(lang).alias("label"))
    return qc.drop_unlabelled(d)


SAMPLE_ID_SQL = "SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'GSM' || l_orderkey || '_E' || (10 + l_linenumber) || 'M_' || l_linenumber WHEN 1 THEN 'GSM1_MIAF_' || l_linenumber WHEN 2 THEN 'AbxM_' || l_linenumber ELSE 'GSM1_odd' END AS sid FROM lineitem"


@query("qc7_parse_sample_id", sql(
    """SELECT stage, condition, sex, replicate, count(*) AS n FROM (SELECT
    CASE WHEN NOT ok THEN 'unknown' WHEN token LIKE 'E%' THEN token ELSE 'E14' END AS stage,
    CASE WHEN NOT ok THEN 'unknown' WHEN token LIKE 'E%' THEN 'PBS' ELSE token END AS condition,
    CASE WHEN ok THEN regexp_extract(lab, '^(E\\d+|MIA|Abx)([MF])_(\\d+)$', 2) ELSE 'unknown' END AS sex,
    CASE WHEN ok THEN regexp_extract(lab, '^(E\\d+|MIA|Abx)([MF])_(\\d+)$', 3) ELSE 'unknown' END AS replicate
    FROM (SELECT lab, regexp_matches(lab, '^(E\\d+|MIA|Abx)([MF])_(\\d+)$') AS ok, regexp_extract(lab, '^(E\\d+|MIA|Abx)([MF])_(\\d+)$', 1) AS token
    FROM (SELECT CASE WHEN strpos(sid, '_') > 0 THEN substr(sid, strpos(sid, '_') + 1) ELSE sid END AS lab FROM (""" + SAMPLE_ID_SQL + ")))) GROUP BY ALL"))
def _(t: Tables):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    sid = (
        F.when(o % 4 == 0, F.format_string("GSM%d_E%dM_%d", o, n + 10, n)).when(o % 4 == 1, F.format_string("GSM1_MIAF_%d", n))
        .when(o % 4 == 2, F.format_string("AbxM_%d", n)).otherwise("GSM1_odd")
    )
    df = qc.parse_sample_id(t.read("lineitem").select(sid.alias("sid")), "sid")
    return df.groupBy("stage", "condition", "sex", "replicate").agg(F.count(F.lit(1)).alias("n"))


@query("qc7_section_id", sql(
    """SELECT stage, embryo, section, count(*) AS n FROM (SELECT CASE WHEN ok THEN regexp_extract(sid, '^(E\\d+(?:\\.\\d+)?)_(E\\d+)S(\\d+)$', 1) ELSE 'unknown' END AS stage,
    CASE WHEN ok THEN regexp_extract(sid, '^(E\\d+(?:\\.\\d+)?)_(E\\d+)S(\\d+)$', 2) ELSE 'unknown' END AS embryo,
    CASE WHEN ok THEN 'S' || regexp_extract(sid, '^(E\\d+(?:\\.\\d+)?)_(E\\d+)S(\\d+)$', 3) ELSE sid END AS section
    FROM (SELECT sid, regexp_matches(sid, '^(E\\d+(?:\\.\\d+)?)_(E\\d+)S(\\d+)$') AS ok FROM (SELECT CASE l_orderkey % 3 WHEN 0 THEN 'E' || (9 + l_linenumber) || '.5_E' || (1 + l_orderkey % 4) || 'S' || l_linenumber WHEN 1 THEN 'E9_E1S' || (l_orderkey % 5) ELSE 'E9.x_E1S' || l_linenumber END AS sid FROM lineitem))) GROUP BY ALL"""))
def _(t: Tables):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    sid = F.when(o % 3 == 0, F.format_string("E%d.5_E%dS%d", n + 9, o % 4 + 1, n)).when(o % 3 == 1, F.format_string("E9_E1S%d", o % 5)).otherwise(
        F.format_string("E9.x_E1S%d", n)
    )
    return qc.parse_section_id(t.read("lineitem").select(sid.alias("sid")), "sid").groupBy("stage", "embryo", "section").agg(F.count(F.lit(1)).alias("n"))


@query("qc7_donor_id", sql(
    """SELECT CASE WHEN donor LIKE 'MBM%' THEN 'MBM' WHEN donor LIKE 'ECM%' THEN 'ECM' ELSE 'unknown' END AS condition, donor, CASE WHEN second LIKE 'rep%' THEN second ELSE 'rep1' END AS replicate, count(*) AS n
    FROM (SELECT split_part(lab, '_', 1) AS donor, split_part(lab, '_', 2) AS second FROM (SELECT CASE l_orderkey % 4 WHEN 0 THEN 'MBM' || l_suppkey || '_rep' || l_linenumber WHEN 1 THEN 'ECM' || l_suppkey WHEN 2 THEN 'ECM' || l_suppkey || '_left_rep2' ELSE 'X' || l_linenumber END AS lab FROM lineitem)) GROUP BY ALL"""))
def _(t: Tables):
    n, o, d = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")
    sid = (
        F.when(o % 4 == 0, F.format_string("GSM%d_MBM%d_rep%d", o, d, n)).when(o % 4 == 1, F.format_string("GSM%d_ECM%d", o, d))
        .when(o % 4 == 2, F.format_string("GSM%d_ECM%d_left_rep2", o, d)).otherwise(F.format_string("X%d", n))
    )
    return qc.parse_donor_id(t.read("lineitem").select(sid.alias("sid")), "sid").groupBy("condition", "donor", "replicate").agg(F.count(F.lit(1)).alias("n"))


@query("qc8_collapse_region", sql(
    """SELECT region, count(*) AS n FROM (SELECT CASE p_partkey % 9 WHEN 0 THEN 'DorsalVZ' WHEN 1 THEN 'VentralVZ' WHEN 2 THEN 'SeptalVZ' WHEN 3 THEN 'CP' WHEN 4 THEN 'GE' WHEN 5 THEN 'BT' WHEN 6 THEN '' WHEN 7 THEN 'Septum' ELSE '' END AS region FROM part) GROUP BY 1"""))
def _(t: Tables):
    texts = ["L_dorsal VZ", "right-Vent_VZ", " septal__vz", "l_Cortical Plate", "MGE", "Basal lateral", "nan", "R-Septum", "thalamus"]
    raw = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t.read("part").select(qc.collapse_region(raw).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


CROSS_RULES = [
    ("exact", ["ECONOMY", "PROMO"], 3, "CP", "exact_first"), ("prefix", ["ST", "SM"], 7, "Septum", "prefix_second"),
    ("prefix", ["E", "L"], 8, "BT", "prefix_third"),
]


@query("qc9_crosswalk", sql(
    """SELECT p_type, p_name, region_id, region_label, mapping_rule, CASE WHEN region_label = 'Other' THEN 'auto_review_required' ELSE 'auto_mapped' END AS review_status FROM (
    SELECT DISTINCT p_type, p_name, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 3 WHEN p_type LIKE 'ST%' OR p_type LIKE 'SM%' THEN 7 WHEN p_type LIKE 'E%' OR p_type LIKE 'L%' THEN 8 ELSE 9 END AS region_id,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'CP' WHEN p_type LIKE 'ST%' OR p_type LIKE 'SM%' THEN 'Septum' WHEN p_type LIKE 'E%' OR p_type LIKE 'L%' THEN 'BT' ELSE 'Other' END AS region_label,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'exact_first' WHEN p_type LIKE 'ST%' OR p_type LIKE 'SM%' THEN 'prefix_second' WHEN p_type LIKE 'E%' OR p_type LIKE 'L%' THEN 'prefix_third' ELSE 'qc_unresolved_or_non_target_region' END AS mapping_rule FROM part)"""))
def _(t: Tables):
    return qc.crosswalk(t.read("part").select("p_type", "p_name").distinct(), "p_type", "p_name", CROSS_RULES)


@query("qc10_filter_requested", sql(
    "SELECT obs_id, label FROM obs WHERE label IN (SELECT label FROM obs WHERE nation % 3 = 0)"))
def _(t: Tables):
    o = t.obs().select("obs_id", "label", "nation")
    return qc.filter_requested(o, o.where(F.col("nation") % 3 == 0).select("label"), "label").select("obs_id", "label")


@query("qc11_half_split", sql(
    "SELECT obs_id, CASE WHEN x <= (SELECT quantile_cont(x, 0.5::DOUBLE) FROM obs b WHERE b.label = obs.label) THEN 'observed' ELSE 'masked' END AS part FROM obs"))
def _(t: Tables):
    return qc.half_split(t.obs(), "x", 0.5, ["label"]).select("obs_id", "part")


SUPPORT_SQL = {
    "support": "SELECT t.nation, t.n AS n_target, coalesce(s.n, 0) AS n_source, coalesce(s.n, 0) >= 3 AS supported FROM (SELECT nation, count(*) AS n FROM obs GROUP BY 1) t LEFT JOIN (SELECT nation, count(*) AS n FROM obs WHERE y > 20 GROUP BY 1) s ON s.nation = t.nation",
}


@query("qc12_label_support", sql("SELECT * FROM support", extra=SUPPORT_SQL))
def _(t: Tables):
    return qc.label_support(t.obs().where(F.col("y") > 20), t.obs(), 3, label="nation")


@query("qc12_retained_support", sql(
    "SELECT count(*) FILTER (WHERE NOT supported) AS n_excluded_labels, coalesce(sum(n_target) FILTER (WHERE NOT supported), 0) AS n_excluded_rows, sum(CASE WHEN supported THEN n_target ELSE 0 END) / CAST(sum(n_target) AS DOUBLE) AS retained_fraction FROM support",
    "retained_fraction", "n_excluded_rows", SUPPORT_SQL))
def _(t: Tables):
    return qc.retained_support(qc.label_support(t.obs().where(F.col("y") > 20), t.obs(), 3, label="nation"))


@query("qc13_positive_support", sql(
    "SELECT c_custkey AS obs_id, coalesce(n, 0) AS total_counts, coalesce(n, 0) > 0 AS scored FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey",
    i="total_counts"))
def _(t: Tables):
    c = t.read("orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("obs_id"), F.lit(1).alias("value"))
    return qc.positive_support(c, t.read("customer").select(F.col("c_custkey").alias("obs_id")))


CROP = {"plate": "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points WHERE label < 3",
        "rot": "SELECT obs_id, px + cos(radians(20.0)) * (x - px) - sin(radians(20.0)) * (y - py) AS x, py + sin(radians(20.0)) * (x - px) + cos(radians(20.0)) * (y - py) AS y FROM points CROSS JOIN (SELECT (min(x) + max(x)) / 2.0 AS px, (min(y) + max(y)) / 2.0 AS py FROM points)"}


@query("qc14_crop_plate", sql(
    "SELECT count(*) FILTER (WHERE inside) AS n_kept, count(*) FILTER (WHERE NOT inside) AS n_dropped, count(*) FILTER (WHERE inside) / CAST(count(*) AS DOUBLE) AS kept_fraction FROM (SELECT x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inside FROM rot CROSS JOIN plate)",
    "kept_fraction", extra=CROP))
def _(t: Tables):
    from tallyscope.operators.alignment import rotate_points

    p = t.points().select("obs_id", "x", "y", "label")
    rotated = rotate_points(p, 20.0).select("obs_id", F.col("rx").alias("x"), F.col("ry").alias("y"))
    return qc.crop_report(qc.crop_plate(rotated, p.where(F.col("label") < 3)))


@query("qc15_roi_count", sql("SELECT label, count(*) AS n_points FROM points WHERE x >= -0.1 AND x < 0.1 AND y >= -0.1 AND y < 0.1 GROUP BY 1"))
def _(t: Tables):
    return qc.roi_count(t.points(), -0.1, -0.1, 0.1, 0.1, ["label"])


@query("qc16_normalize_columns", sql("SELECT r_regionkey AS regionkey, r_name AS name FROM region"))
def _(t: Tables):
    return qc.normalize_columns(t.read("region"), ["regionkey", "name"], "r_")


# --- transforms --------------------------------------------------------------

LOGN = {"logn": "SELECT obs_id, feature_id, ln(1 + value * (10000.0::DOUBLE / sum(value) OVER (PARTITION BY obs_id))) AS value FROM counts"}


@query("tr1_log_normalize", sql("SELECT * FROM logn", "value", extra=LOGN))
def _(t: Tables):
    return transform.log_normalize(t.counts())


@query("tr2_log_normalize_median", sql(
    "SELECT c.obs_id, c.feature_id, ln(1 + c.value / CAST(l.lib AS DOUBLE) * (SELECT quantile_cont(CAST(lib AS DOUBLE), 0.5::DOUBLE) FROM libs)) AS value FROM counts c JOIN libs l ON l.obs_id = c.obs_id",
    "value", extra={"libs": "SELECT obs_id, sum(value) AS lib FROM counts GROUP BY 1"}))
def _(t: Tables):
    return transform.log_normalize_median(t.counts())


LONG = {"vlong": "SELECT obs_id, batch, i - 1 AS dim, vec[i] AS v FROM (SELECT obs_id, batch, vec, unnest(range(1, len(vec) + 1)) AS i FROM points)"}


@query("tr3_standardize", sql(
    "SELECT obs_id, dim, (v - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END AS z FROM vlong JOIN (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM vlong GROUP BY 1) USING (dim)",
    "z", "dim", LONG))
def _(t: Tables):
    z = transform.standardize(t.points().select("obs_id", "vec"), "vec")
    return transform.explode_vector(z, "vec", ["obs_id"]).withColumn("dim", F.col("dim").cast("long")).withColumnRenamed("v", "z")


@query("tr4_center", sql(
    "SELECT obs_id, dim, v - avg(v) OVER (PARTITION BY batch, dim) AS z FROM vlong", "z", "dim", LONG))
def _(t: Tables):
    z = transform.center(t.points().select("obs_id", "batch", "vec"), "vec", ["batch"])
    return transform.explode_vector(z, "vec", ["obs_id"]).withColumn("dim", F.col("dim").cast("long")).withColumnRenamed("v", "z")


@query("tr5_residualize", sql(
    "SELECT obs_id, label, feature_id, value - avg(value) OVER (PARTITION BY label, feature_id) AS value FROM dense_places", "value"))
def _(t: Tables):
    return transform.residualize(t.place_counts(), t.points().select("obs_id", "label"), t.dims())


@query("tr6_robust_scale", sql(
    "SELECT obs_id, feature_id, greatest(least(value / CASE WHEN q > 0 THEN q ELSE 1.0 END, 1.0), 0.0) AS value FROM counts JOIN (SELECT feature_id, quantile_cont(CAST(value AS DOUBLE), 0.9::DOUBLE) AS q FROM counts GROUP BY 1) USING (feature_id)",
    "value"))
def _(t: Tables):
    return transform.robust_scale(t.counts(), 90.0, ["feature_id"])


@query("tr7_predict_label_means", sql(
    "SELECT o.obs_id, o.label, m.feature_id, m.prediction FROM obs o JOIN (SELECT label, feature_id, avg(value) AS prediction FROM dense_ref GROUP BY 1, 2 HAVING sum(value) > 0) m ON m.label = o.label",
    "prediction"), is_rounded=True)
def _(t: Tables):
    # a mean is rounded once, not in each of its rows
    return transform.predict(rounded(transform.fit_label_means(t.ref(), t.obs())), t.obs())


THETA = {
    "gstats": "SELECT feature_id, avg(value) AS mean, greatest(avg(value * value) - avg(value) * avg(value), 0.0) AS variance, avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zf FROM dense GROUP BY 1",
    "theta": "SELECT feature_id, ln(greatest(mean, 1e-10)) AS log_mu, ln(greatest(variance / greatest(mean, 1e-10), 1e-10)) AS omega, ln(p / (1.0 - p)) AS logit_pi0 FROM (SELECT *, least(greatest(zf, 1e-10), 1.0 - 1e-10) AS p FROM gstats)",
}


@query("tr8_gene_theta", sql("SELECT * FROM theta", "log_mu omega logit_pi0", extra=THETA))
def _(t: Tables):
    return transform.gene_theta(t.counts(), t.obs(), (), t.features())


@query("tr9_theta_axes", sql(
    "SELECT *, log_mu + omega AS log_variance, 1.0 / (1.0 + exp(-logit_pi0)) AS zero_proportion FROM theta",
    "log_mu omega logit_pi0 log_variance zero_proportion", extra=THETA))
def _(t: Tables):
    return transform.theta_axes(transform.gene_theta(t.counts(), t.obs(), (), t.features()))


DELTA = {"delta": "SELECT feature_id, ln(1.0 + a) - ln(1.0 + b) AS d, a, b FROM cells_ab"}


@query("tr10_delta_stats", sql(
    "SELECT feature_id, avg(d) AS mean_delta, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS fraction_over, avg(CASE WHEN d < 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS fraction_under FROM delta GROUP BY 1 HAVING sum(a) + sum(b) > 0",
    "mean_delta mae rmse fraction_over fraction_under", extra=DELTA))
def _(t: Tables):
    return transform.delta_stats(t.ref(), t.cand(), stats.n_obs(t.obs()))


@query("tr11_quantile_limits", sql(
    """SELECT label, quantile_cont(v, 0.02::DOUBLE) AS q02, quantile_cont(v, 0.98::DOUBLE) AS q98, quantile_cont(abs(v), 0.99::DOUBLE) AS abs_q99,
    quantile_cont(v, 0.99::DOUBLE) FILTER (WHERE v > 0) AS positive_q99 FROM (SELECT label, value - 5000.0::DOUBLE AS v FROM axis_obs) GROUP BY 1""",
    "q02 q98 abs_q99 positive_q99"))
def _(t: Tables):
    return transform.quantile_limits(t.axis_obs().withColumn("v", F.col("value") - 5000.0), "v", ["label"])


@query("tr12_densify", sql("SELECT obs_id, feature_id, value FROM dense_places"))
def _(t: Tables):
    return transform.densify(t.place_counts(), t.points().select("obs_id"), t.dims())
