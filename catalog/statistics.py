"""Feature, observation and label statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import METRICS, Tables, pear, sql
from tallyscope.operators import stats

GENE = "avg(value) AS mean, greatest(avg(value * value) - avg(value) * avg(value), 0.0) AS variance, avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zero_fraction"


@query("ag1_gene_stats", sql(f"SELECT feature_id, {GENE} FROM dense GROUP BY 1", "mean variance zero_fraction"))
def _(t: Tables):
    return stats.gene_stats(t.counts(), t.obs(), (), t.features())


@query("ag1_gene_stats_by_dataset", sql(
    f"SELECT dataset, feature_id, {GENE} FROM (SELECT o.dataset, f.feature_id, coalesce(c.value, 0) AS value FROM flagged_obs o CROSS JOIN features f LEFT JOIN flagged c ON c.dataset = o.dataset AND c.obs_id = o.obs_id AND c.feature_id = f.feature_id) GROUP BY 1, 2 HAVING sum(value) > 0",
    "mean variance zero_fraction"))
def _(t: Tables):
    return stats.gene_stats(t.flagged(), t.flagged_obs(), ["dataset"])


@query("ag2_row_stats", sql(
    "SELECT obs_id, sum(value) AS library_size, count(*) FILTER (WHERE value > 0) AS detected FROM dense GROUP BY 1", i="library_size detected"))
def _(t: Tables):
    return stats.row_stats(t.counts(), t.obs())


@query("ag3_class_means", sql(
    f"SELECT label, feature_id, count(*) AS n_obs, {GENE} FROM dense GROUP BY 1, 2 HAVING sum(value) > 0", "mean variance zero_fraction", "n_obs"))
def _(t: Tables):
    return stats.class_means(t.counts(), t.obs())


SLICE = {"srow": "SELECT o.dataset, o.obs_id, coalesce(sum(c.value), 0) AS lib, count(c.value) AS det FROM flagged_obs o LEFT JOIN flagged c ON c.dataset = o.dataset AND c.obs_id = o.obs_id GROUP BY 1, 2"}


@query("ag4_slice_summary", sql(
    """SELECT dataset, count(*) AS n_spots, avg(lib) AS mean_library, avg(det) AS mean_detected, quantile_cont(CAST(lib AS DOUBLE), 0.5::DOUBLE) AS median_library,
    quantile_cont(CAST(det AS DOUBLE), 0.5::DOUBLE) AS median_detected, 1.0 - sum(det) / CAST(count(*) * (SELECT count(*) FROM features) AS DOUBLE) AS zero_fraction FROM srow GROUP BY 1""",
    "mean_library mean_detected median_library median_detected zero_fraction", "n_spots", SLICE))
def _(t: Tables):
    return stats.slice_summary(t.flagged(), t.flagged_obs(), t.features(), ["dataset"])


@query("ag5_region_coverage", sql(
    "SELECT z, label, count(*) AS n_spots, count(*) / CAST(sum(count(*)) OVER (PARTITION BY z) AS DOUBLE) AS fraction FROM axis_obs GROUP BY 1, 2", "fraction", "n_spots z"))
def _(t: Tables):
    return stats.region_coverage(t.axis_obs().withColumn("z", F.col("z").cast("long")), ["z"])


@query("ag6_top_n_other", sql(
    """SELECT z, brand, sum(n) AS n FROM (SELECT z, CASE WHEN brand IN (SELECT brand FROM (SELECT brand, sum(n) AS s FROM per GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)) THEN brand ELSE 'Other' END AS brand, n FROM per) GROUP BY 1, 2""",
    i="n z", extra={"per": "SELECT p_size AS z, p_brand AS brand, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2"}))
def _(t: Tables):
    j = t.read("lineitem").select("l_partkey").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    per = j.groupBy(F.col("p_size").cast("long").alias("z"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return stats.top_n_other(per, "brand", "n", 8, ["z"])


@query("ag7_label_proportions", sql(
    "SELECT n_nationkey AS label, coalesce(n, 0) AS n, coalesce(n, 0) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS proportion FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
    "proportion", "n"))
def _(t: Tables):
    pred = t.read("customer").select(F.col("c_nationkey").alias("label"))
    return stats.label_proportions(pred, t.read("nation").select(F.col("n_nationkey").alias("label")))


@query("ag8_grouped_means", sql(
    """SELECT l_linestatus, "group", count(*) AS n, avg(l_discount) AS mean_l_discount, avg(l_tax) AS mean_l_tax FROM (
    SELECT l_linestatus, l_discount, l_tax, 'all' AS "group" FROM lineitem UNION ALL SELECT l_linestatus, l_discount, l_tax, 'altered' FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT l_linestatus, l_discount, l_tax, 'baseline' FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_linestatus, l_discount, l_tax, 'real' FROM lineitem WHERE l_quantity > 25) GROUP BY 1, 2""",
    "mean_l_discount mean_l_tax", "n"))
def _(t: Tables):
    flag = F.col("l_returnflag")
    groups = {"all": F.lit(True), "altered": flag == "R", "baseline": flag != "R", "real": F.col("l_quantity") > 25}
    return stats.grouped_means(t.read("lineitem"), groups, ["l_discount", "l_tax"], ["l_linestatus"])


@query("ag9_replicate_summary", sql(
    "SELECT method, metric, count(value) AS replicates, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.05::DOUBLE) AS p05, quantile_cont(value, 0.95::DOUBLE) AS p95 FROM metric_long GROUP BY 1, 2",
    "mean sd p05 p95", "replicates"))
def _(t: Tables):
    return stats.replicate_summary(t.metric_long(), ["method"], METRICS)


@query("ag10_seed_summary", sql(
    """SELECT segment, metric, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max, count(value) AS count FROM (
    SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, 'c_acctbal' AS metric, c_acctbal AS value FROM customer
    UNION ALL SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer) GROUP BY 1, 2""",
    "mean sd min max", "count"))
def _(t: Tables):
    c = t.read("customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return stats.seed_summary(c, ["segment"], ["c_acctbal", "c_nationkey"])


@query("ag11_finite_summary", sql(
    """SELECT l_returnflag, count(*) AS n_targets, count(v) AS n_defined, quantile_cont(v, 0.25::DOUBLE) AS q25, quantile_cont(v, 0.5::DOUBLE) AS median, quantile_cont(v, 0.75::DOUBLE) AS q75
    FROM (SELECT l_returnflag, CASE WHEN l_quantity <> 1 THEN l_extendedprice END AS v FROM lineitem) GROUP BY 1""", "q25 median q75", "n_targets n_defined"))
def _(t: Tables):
    v = F.when(F.col("l_quantity") == 1, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return stats.finite_summary(t.read("lineitem").select("l_returnflag", v.alias("v")), ["l_returnflag"], "v")


@query("ag12_level_summary", sql(
    "SELECT l_returnflag, l_linenumber, avg(l_discount) AS l_discount_mean, stddev_samp(l_discount) AS l_discount_sd, avg(l_tax) AS l_tax_mean, stddev_samp(l_tax) AS l_tax_sd FROM lineitem GROUP BY 1, 2",
    "l_discount_mean l_discount_sd l_tax_mean l_tax_sd"))
def _(t: Tables):
    return stats.level_summary(t.read("lineitem"), ["l_returnflag", "l_linenumber"], ["l_discount", "l_tax"])


@query("ag13_weighted_mean", sql(
    "SELECT l_returnflag, sum(l_quantity * l_discount) / sum(l_quantity) AS weighted_mean FROM lineitem GROUP BY 1", "weighted_mean"))
def _(t: Tables):
    return stats.weighted_mean(t.read("lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


@query("ag14_voxel_counts", sql(
    "SELECT l_linenumber % 3 AS age, l_partkey % 12 AS struct_id, count(*) AS n_voxels FROM lineitem GROUP BY 1, 2", i="age struct_id n_voxels"))
def _(t: Tables):
    v = t.read("lineitem").select((F.col("l_linenumber") % 3).cast("long").alias("age"), (F.col("l_partkey") % 12).alias("struct_id"))
    return stats.value_counts(v, ["age", "struct_id"])


@query("ag15_marker_means", sql(
    "SELECT label, count(DISTINCT obs_id) AS n_obs, " + ", ".join(f"ln(1 + coalesce(sum(value) FILTER (WHERE feature_id = {m}), 0) / CAST(count(DISTINCT obs_id) AS DOUBLE)) AS marker_{m}" for m in (1, 2, 3)) + " FROM dense GROUP BY 1",
    "marker_1 marker_2 marker_3", "n_obs"))
def _(t: Tables):
    return stats.marker_means(t.counts(), t.obs(), [1, 2, 3])


@query("ag16_select_markers", sql(
    """SELECT feature_id, count(DISTINCT direction) AS n_directions, min(moran) AS min_moran, avg(zf) AS mean_zero_fraction, quantile_cont(moran, 0.5::DOUBLE) AS median_moran
    FROM (SELECT l_partkey AS feature_id, l_returnflag AS direction, round(avg(l_discount), 9) AS moran, avg(l_tax) AS zf FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT direction) = 3 ORDER BY median_moran DESC, min_moran DESC, feature_id LIMIT 10""",
    "min_moran mean_zero_fraction median_moran", "n_directions"))
def _(t: Tables):
    rows = t.read("lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("direction")).agg(
        F.round(F.avg("l_discount"), 9).alias("moran"), F.avg("l_tax").alias("zero_fraction")
    )
    return stats.select_markers(rows, 3, 10)


HIST = {"binned": "SELECT CAST(floor(x / 0.05) AS BIGINT) AS bin_x, CAST(floor(y / 0.05) AS BIGINT) AS bin_y, label, obs_id FROM points"}


@query("ag17_grid_histogram", sql(
    """SELECT bin_x, bin_y, n, weight, winner FROM (SELECT bin_x, bin_y, sum(n) OVER w AS n, sum(wt) OVER w AS weight, label AS winner, row_number() OVER (PARTITION BY bin_x, bin_y ORDER BY n DESC, label) AS rk
    FROM (SELECT bin_x, bin_y, label, count(*) AS n, sum(obs_id) AS wt FROM binned GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY bin_x, bin_y)) WHERE rk = 1""", i="n weight", extra=HIST))
def _(t: Tables):
    return stats.grid_histogram(t.points(), 0.05, (), "obs_id", "label")


@query("ag17_smooth_grid", sql(
    """SELECT bin_x + i AS bin_x, bin_y + j AS bin_y, sum(n * exp(-(i * i + j * j) / 2.0) / (SELECT sum(exp(-(a * a + b * b) / 2.0)) FROM offs)) AS smoothed FROM (SELECT bin_x, bin_y, count(*) AS n FROM binned GROUP BY 1, 2) CROSS JOIN (SELECT a AS i, b AS j FROM offs) GROUP BY 1, 2""",
    "smoothed", "bin_x bin_y", {**HIST, "offs": "SELECT a, b FROM (SELECT unnest(range(-2, 3)) AS a) CROSS JOIN (SELECT unnest(range(-2, 3)) AS b)"}))
def _(t: Tables):
    return stats.smooth_grid(stats.grid_histogram(t.points(), 0.05), 1.0, 2)


@query("ag18_aggregate_to_grid", sql(
    "SELECT CAST(floor(x / 10.0) AS BIGINT) AS bin_x, CAST(floor(y / 10.0) AS BIGINT) AS bin_y, feature_id, sum(value) AS value FROM counts JOIN obs USING (obs_id) GROUP BY 1, 2, 3", i="value"))
def _(t: Tables):
    return stats.aggregate_to_grid(t.counts(), t.obs(), 10.0)


@query("ag18_grid_members", sql(
    "SELECT *, n_type / CAST(n_members AS DOUBLE) AS proportion FROM (SELECT bin_x, bin_y, label, n_type, CAST(sum(n_type) OVER (PARTITION BY bin_x, bin_y) AS BIGINT) AS n_members FROM (SELECT bin_x, bin_y, label, count(*) AS n_type FROM binned GROUP BY 1, 2, 3))",
    "proportion", extra=HIST))
def _(t: Tables):
    return stats.grid_members(t.points(), 0.05)


@query("ag19_rollup_types", sql(
    "SELECT spot, CASE WHEN type IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS class, sum(p) AS p FROM comp GROUP BY 1, 2", "p"))
def _(t: Tables):
    kinds = t.read("orders").select(F.col("o_orderpriority").alias("type")).distinct()
    mapping = kinds.withColumn("class", F.when(F.col("type").isin("1-URGENT", "2-HIGH"), "fast").otherwise("slow"))
    return stats.rollup_types(t.comp(), mapping)


@query("ag20_tie_fraction", sql(
    "SELECT l_returnflag, 1.0 - count(DISTINCT l_tax) / CAST(count(*) AS DOUBLE) AS tie_fraction, count(*) FILTER (WHERE l_tax = 0) / CAST(count(*) AS DOUBLE) AS zero_fraction FROM lineitem GROUP BY 1",
    "tie_fraction zero_fraction"))
def _(t: Tables):
    return stats.tie_fraction(t.read("lineitem").select("l_returnflag", "l_tax"), ["l_returnflag"], "l_tax")


AUDIT = {
    "fab": "SELECT feature_id, avg(a) AS bm, avg(b) AS cm, greatest(avg(a * a) - avg(a) * avg(a), 0.0) AS bv, greatest(avg(b * b) - avg(b) * avg(b), 0.0) AS cv, avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS bz, avg(CASE WHEN b = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS cz FROM cells_ab GROUP BY 1",
    "pau": "SELECT avg(cm) / avg(bm) AS global_mean_ratio, avg(cv) / avg(bv) AS global_variance_ratio, avg(cz) / avg(bz) AS zero_fraction_ratio, avg(cz) - avg(bz) AS zero_fraction_delta, count(CASE WHEN bm > 0 THEN 1 END) AS n_positive_genes, quantile_cont(CASE WHEN bm > 0 THEN cm / bm END, 0.5::DOUBLE) AS median_gene_ratio, quantile_cont(CASE WHEN bv > 0 THEN cv / bv END, 0.5::DOUBLE) AS median_variance_ratio FROM fab",
    "pad": "SELECT *, global_mean_ratio > 1 AS mean_increased, global_mean_ratio < 1 AS mean_decreased, zero_fraction_delta > 0 AS sparsity_increased, zero_fraction_delta < 0 AS sparsity_decreased, median_variance_ratio > 1 AS variance_increased FROM pau",
}
AUDIT_DOUBLES = "global_mean_ratio global_variance_ratio zero_fraction_ratio zero_fraction_delta median_gene_ratio median_variance_ratio"


def _audit(t: Tables):
    f = t.features()
    return stats.perturbation_audit(stats.gene_stats(t.ref(), t.obs(), (), f), stats.gene_stats(t.cand(), t.obs(), (), f))


@query("ag21_perturbation_audit", sql("SELECT * FROM pad", AUDIT_DOUBLES, "n_positive_genes", AUDIT))
def _(t: Tables):
    return _audit(t)


@query("ag21_perturbation_check", sql(
    """SELECT pad.*, TRUE AS finite, TRUE AS nonnegative, TRUE AS integer_counts, TRUE AS same_observations, (SELECT count(*) FROM features WHERE feature_id NOT IN (SELECT l_partkey FROM lineitem)) = 0 AS same_features,
    'mean_down;zeros_up' AS expected_directions, mean_decreased AND sparsity_increased AS direction_checks_passed, CASE WHEN mean_decreased AND sparsity_increased AND (SELECT count(*) FROM features WHERE feature_id NOT IN (SELECT l_partkey FROM lineitem)) = 0 THEN 'ok' ELSE 'failed' END AS status FROM pad""",
    AUDIT_DOUBLES, "n_positive_genes", AUDIT))
def _(t: Tables):
    seen = t.counts().select("feature_id").distinct()
    return stats.perturbation_check(_audit(t), stats.structural_checks(t.cand(), t.obs(), t.obs(), t.features(), seen), ["mean_down", "zeros_up"])


@query("ag22_group_diagnostics", sql(
    "SELECT label, count(*) AS n_features, " + ", ".join(f"{pear('a_' + c, 'b_' + c)} AS {c}_pearson" for c in ("mean", "variance", "zero_fraction")) +
    """ FROM (SELECT label, feature_id, avg(a) AS a_mean, avg(b) AS b_mean, greatest(avg(a * a) - avg(a) * avg(a), 0.0) AS a_variance, greatest(avg(b * b) - avg(b) * avg(b), 0.0) AS b_variance,
    avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS a_zero_fraction, avg(CASE WHEN b = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS b_zero_fraction FROM cells_ab GROUP BY 1, 2) GROUP BY 1""",
    "mean_pearson variance_pearson zero_fraction_pearson", "n_features"))
def _(t: Tables):
    f = t.features()
    return stats.group_diagnostics(stats.class_means(t.ref(), t.obs(), features=f), stats.class_means(t.cand(), t.obs(), features=f), ["label"])


@query("ag23_realised_diagnostics", sql(
    "SELECT l_orderkey, l_linenumber, l_quantity AS requested, l_quantity * (1 - l_discount) AS target, l_quantity * (1 - l_discount) * (1 + l_tax) AS realised FROM lineitem", "requested target realised"))
def _(t: Tables):
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    nested = F.struct(q.alias("requested"), (q * (1 - d)).alias("target"), (q * (1 - d) * (1 + x)).alias("realised"))
    runs = t.read("lineitem").select("l_orderkey", "l_linenumber", nested.alias("diagnostics"))
    return stats.realised_diagnostics(runs, "diagnostics", ["requested", "target", "realised"], ["l_orderkey", "l_linenumber"])


@query("ag24_level_curve", sql(
    "SELECT l_returnflag, l_linenumber, avg(l_discount) AS mean, min(l_discount) AS min, max(l_discount) AS max, count(l_discount) AS count FROM lineitem GROUP BY 1, 2", "mean min max", "count"))
def _(t: Tables):
    return stats.level_curve(t.read("lineitem"), ["l_returnflag", "l_linenumber"], "l_discount")
