"""Ordered axes, ranks, top-k, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import METRICS, Tables, pear, sql
from tallyscope.functions.session import checkpointed
from tallyscope.operators import axis, stats, topk


def _ranked(t: Tables):
    """Means per region and metric, one of them undefined."""
    m = stats.melt(t.metric_long(), ["method"], METRICS).groupBy("method", "metric").agg(F.avg("value").alias("value"))
    return m.withColumn("value", F.when(~((F.col("method") == 0) & (F.col("metric") == "tax")), F.round("value", 9)))


RANKED = {"mr": "SELECT method, metric, CASE WHEN NOT (method = 0 AND metric = 'tax') THEN round(avg(value), 9) END AS value FROM metric_long GROUP BY 1, 2"}


@query("wn1_metric_ranks", sql(
    "SELECT method, metric, value, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'tax' THEN value ELSE -value END NULLS LAST) END AS rank FROM mr", "value", "rank", RANKED))
def _(t: Tables):
    return axis.metric_ranks(_ranked(t), ["tax"]).select("method", "metric", "value", "rank")


@query("wn2_complete_case", sql(
    """SELECT *, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'tax' THEN mean ELSE -mean END) AS rank FROM (SELECT metric, method, round(avg(value), 9) AS mean, count(*) AS n_samples FROM (SELECT *, count(value) OVER (PARTITION BY metric, sample) AS c FROM (SELECT method, sample, metric, CASE WHEN NOT (sample = 3 AND method = 1) THEN value END AS value FROM metric_long)) WHERE c = 5 GROUP BY 1, 2)""", "mean", "n_samples rank"))
def _(t: Tables):
    long = stats.melt(t.metric_long(), ["method", "sample"], METRICS)
    long = long.withColumn("value", F.when(~((F.col("sample") == 3) & (F.col("method") == 1)), F.col("value")))
    return axis.complete_case(long, ["tax"])


# feature means per day and event type; user groups of the type present that day
AXIS = {
    "sz": "SELECT z, label, count(*) AS n FROM axis_obs GROUP BY 1, 2",
    "am": "SELECT sz.z, sz.label, f.feature_id, coalesce(sum(a.value), 0) / CAST(max(n) AS DOUBLE) AS mean FROM sz CROSS JOIN (SELECT DISTINCT feature_id FROM axis_obs) f LEFT JOIN axis_obs a ON sz.z = a.z AND sz.label = a.label AND f.feature_id = a.feature_id GROUP BY 1, 2, 3",
    "pairs": """SELECT z, label, feature_id, sum(a) AS a, sum(b) AS b FROM (SELECT z, label, feature_id, mean AS a, 0.0::DOUBLE AS b FROM am UNION ALL SELECT z - 1, label, feature_id, 0.0, mean FROM am) WHERE (z, label) IN (SELECT (z, label) FROM sz) AND (z + 1, label) IN (SELECT (z, label) FROM sz) GROUP BY 1, 2, 3""",
    "adj": f"SELECT z, count(DISTINCT label) AS shared_labels, {pear('a', 'b')} AS pearson, {pear('ln(1 + a)', 'ln(1 + b)')} AS log1p_pearson, avg(abs(ln(1 + b) - ln(1 + a))) AS mean_abs_log_change, avg(abs(b - a)) AS mean_abs_change FROM pairs GROUP BY 1",
}


def _axis_means(t: Tables):
    o = t.axis_obs()
    counts = o.groupBy("z", "obs_id", "feature_id").agg(F.sum("value").alias("value"))
    m = stats.class_means(counts, o.select("z", "obs_id", "label"), ["z"], features=o)
    return m.select("z", "label", "feature_id", "mean")


@query("wn3_adjacent_metrics", sql("SELECT * FROM adj", "pearson log1p_pearson mean_abs_log_change mean_abs_change", "z shared_labels", AXIS))
def _(t: Tables):
    return axis.adjacent_metrics(_axis_means(t), "z")


GENES = {
    "gm": "SELECT s.z, f.feature_id, coalesce(sum(a.value), 0) / CAST(max(s.n) AS DOUBLE) AS mean FROM (SELECT z, count(*) AS n FROM axis_obs GROUP BY 1) s CROSS JOIN (SELECT DISTINCT feature_id FROM axis_obs) f LEFT JOIN axis_obs a ON a.z = s.z AND a.feature_id = f.feature_id GROUP BY 1, 2",
    "gp": "SELECT p.z, p.mean AS a, q.mean AS b FROM gm p JOIN gm q ON q.z = p.z + 1 AND q.feature_id = p.feature_id",
}


@query("wn3_adjacent_gene_metrics", sql(
    f"SELECT z, {pear('a', 'b')} AS gene_mean_pearson, {pear('ln(1 + a)', 'ln(1 + b)')} AS log1p_gene_mean_pearson, avg(abs(ln(1 + b) - ln(1 + a))) AS mean_abs_log1p_gene_change FROM gp GROUP BY 1",
    "gene_mean_pearson log1p_gene_mean_pearson mean_abs_log1p_gene_change", "z", GENES))
def _(t: Tables):
    o = t.axis_obs()
    counts = o.groupBy("z", "obs_id", "feature_id").agg(F.sum("value").alias("value"))
    m = stats.gene_stats(counts, o.select("z", "obs_id"), ["z"], o.select("feature_id").distinct())
    return axis.adjacent_gene_metrics(m.select("z", "feature_id", "mean"), "z")


HALF = {
    "ho": "SELECT event_id AS obs_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS z, event_type AS label, user_id % 20 AS feature_id, CAST(round(value * 100) AS BIGINT) AS value FROM events",
    "hp": "SELECT *, row_number() OVER (PARTITION BY z, label ORDER BY (obs_id * 7919) % 1000003, obs_id) AS r, count(*) OVER (PARTITION BY z, label) AS n FROM ho",
    "hs": "SELECT z, label, max(n) AS n FROM hp GROUP BY 1, 2 HAVING max(n) >= 2",
    "hm": "SELECT s.z, s.label, f.feature_id, sum(CASE WHEN r <= s.n // 2 THEN value ELSE 0 END) / CAST(max(s.n) // 2 AS DOUBLE) AS lh, sum(CASE WHEN r > s.n // 2 THEN value ELSE 0 END) / CAST(max(s.n) - max(s.n) // 2 AS DOUBLE) AS rh FROM hs s CROSS JOIN (SELECT DISTINCT feature_id FROM ho) f LEFT JOIN hp ON hp.z = s.z AND hp.label = s.label AND hp.feature_id = f.feature_id GROUP BY 1, 2, 3",
    "co": f"SELECT label, feature_id, count(DISTINCT z) AS n_z_levels, min(z) AS z_min, max(z) AS z_max, {pear('lh', 'rh')} AS z_coherence FROM hm GROUP BY 1, 2",
}


def _halves(t: Tables):
    o = t.axis_obs().withColumn("z", F.floor(F.col("z") / 3).cast("long"))
    key = F.struct((F.col("obs_id") * 7919 % 1000003).alias("a"), F.col("obs_id").alias("b"))
    halves = axis.split_half(o.select("z", "obs_id", "label").withColumn("_o", key), ["z"], order="_o")
    return axis.split_half_means(o.select("z", "obs_id", "feature_id", "value"), halves, ["z"], features=o)


@query("wn4_z_coherence", sql("SELECT * FROM co WHERE n_z_levels >= 3 AND z_coherence IS NOT NULL", "z_coherence", "n_z_levels z_min z_max", HALF))
def _(t: Tables):
    return axis.z_coherence(_halves(t))


@query("wn5_split_half_means", sql('SELECT z, label, feature_id, lh AS "left", rh AS "right" FROM hm', '"left" "right"', "z", HALF))
def _(t: Tables):
    return _halves(t)


@query("wn6_continuity_summary", sql(
    """SELECT count(*) AS generated_n, avg(g) AS generated_mean, quantile_cont(g, 0.5::DOUBLE) AS generated_median, count(*) AS baseline_n, avg(z_coherence) AS baseline_mean, quantile_cont(z_coherence, 0.5::DOUBLE) AS baseline_median,
    quantile_cont(g, 0.5::DOUBLE) / quantile_cont(z_coherence, 0.5::DOUBLE) AS normalized_z_coherence FROM (SELECT *, z_coherence * abs(z_coherence) AS g FROM co WHERE n_z_levels >= 3 AND z_coherence IS NOT NULL)""",
    "generated_mean generated_median baseline_mean baseline_median normalized_z_coherence", extra=HALF))
def _(t: Tables):
    c = checkpointed(axis.z_coherence(_halves(t)))
    return axis.continuity_summary(c.withColumn("z_coherence", F.col("z_coherence") * F.abs("z_coherence")), c)


@query("wn7_age_summary", sql(
    "SELECT z % 3 AS age, min(pearson) AS min_value, max(mean_abs_change) AS max_error, min(z) AS z_min, max(z) AS z_max, count(*) AS n_pairs, arg_min(z, (pearson, z)) AS z_at_min, quantile_cont(pearson, 0.5::DOUBLE) AS median_value FROM adj GROUP BY 1",
    "min_value max_error median_value", "age z_min z_max n_pairs z_at_min", AXIS))
def _(t: Tables):
    a = axis.adjacent_metrics(_axis_means(t), "z").withColumn("age", F.col("z") % 3)
    return axis.age_summary(a, ["age"], "pearson", "z", "mean_abs_change")


DAYS = {"days": "SELECT DISTINCT label, z AS slice_id, CAST(z AS DOUBLE) * 1.5 AS z FROM axis_obs"}


def _days(t: Tables):
    return t.axis_obs().select("label", F.col("z").cast("long").alias("slice_id"), (F.col("z").cast("double") * 1.5).alias("z")).distinct()


REFS = {**DAYS, "pos": "SELECT *, row_number() OVER (PARTITION BY label ORDER BY z, slice_id) - 1 AS pos, max(slice_id) OVER (PARTITION BY label) AS last FROM days",
        "roles": "SELECT label, slice_id, z, pos, CASE WHEN pos % 5 = 0 OR slice_id = last OR slice_id IN (3, 11) THEN 'reference' ELSE 'target' END AS role FROM pos"}


@query("wn8_select_references", sql("SELECT * FROM roles", "z", "slice_id pos", REFS))
def _(t: Tables):
    return axis.select_references(_days(t), 5, [3, 11], ["label"])


@query("wn8_partition_audit", sql(
    "SELECT label, count(*) FILTER (WHERE role = 'reference') AS n_references, count(*) FILTER (WHERE role = 'target') AS n_targets, 0 AS n_overlap, count(*) AS n_slices, true AS exact_partition FROM roles GROUP BY 1", i="n_overlap", extra=REFS))
def _(t: Tables):
    return axis.partition_audit(axis.select_references(_days(t), 5, [3, 11], ["label"]), ["label"])


@query("wn9_representatives", sql(
    "SELECT label, slice_id, pos FROM (SELECT label, slice_id, pos, max(pos) OVER (PARTITION BY label) AS m FROM pos) WHERE pos IN (SELECT CAST(round_even(i * m / 6.0::DOUBLE, 0) AS BIGINT) FROM (SELECT unnest(range(0, 7)) AS i))", "", "slice_id pos", REFS))
def _(t: Tables):
    return axis.representatives(_days(t), 7, ["label"])


@query("wn10_discontinuity", sql(
    "SELECT age, count(d) AS replicates, quantile_cont(d, 0.5::DOUBLE) AS median, quantile_cont(d, 0.05::DOUBLE) AS p05, quantile_cont(d, 0.95::DOUBLE) AS p95 FROM (SELECT z % 3 AS age, greatest(1.0 - pearson, 1e-12) AS d FROM adj) GROUP BY 1", "median p05 p95", "age", AXIS))
def _(t: Tables):
    a = axis.adjacent_metrics(_axis_means(t), "z").withColumn("age", (F.col("z") % 3).cast("long"))
    return axis.discontinuity(a, ["age"], "pearson")


@query("wn11_z_index", sql("SELECT label, slice_id, z, dense_rank() OVER (PARTITION BY label ORDER BY z) - 1 AS z_index FROM days", "z", "slice_id z_index", DAYS))
def _(t: Tables):
    return axis.z_index(_days(t), "z", ["label"])


# --- top-k -------------------------------------------------------------------


@query("tk1_top_features", sql(
    "SELECT feature_id, mean, rank FROM (SELECT feature_id, avg(value) AS mean, row_number() OVER (ORDER BY avg(value) DESC, feature_id DESC) AS rank FROM dense GROUP BY 1) WHERE rank <= 25", "mean", "rank"))
def _(t: Tables):
    return topk.top_features(stats.gene_stats(t.counts(), t.obs(), (), t.features()).select("feature_id", "mean"), 25)


HVG = {
    "st": "SELECT feature_id, m, log10(m) AS x, log10(v) AS y FROM (SELECT feature_id, avg(value) AS m, avg(value * value) - avg(value) * avg(value) AS v FROM dense GROUP BY 1) WHERE v > 0",
    "nr": "SELECT k.feature_id, c.x - k.x AS d, c.y, row_number() OVER (PARTITION BY k.feature_id ORDER BY abs(c.x - k.x), c.feature_id) AS near FROM st k CROSS JOIN st c",
    "bw": "SELECT feature_id, greatest(max(abs(d)), 1e-9) AS h FROM nr WHERE near <= ceil((SELECT count(*) FROM st) * 0.3::DOUBLE) GROUP BY 1",
    "kn": "SELECT feature_id, pow(1 - pow(abs(d) / h, 3), 3) AS k, d / h AS t, y FROM nr JOIN bw USING (feature_id) WHERE abs(d) <= h",
    "su": "SELECT feature_id, sum(k) AS s0, sum(k * t) AS s1, sum(k * t ** 2) AS s2, sum(k * t ** 3) AS s3, sum(k * t ** 4) AS s4, sum(k * y) AS t0, sum(k * t * y) AS t1, sum(k * t ** 2 * y) AS t2 FROM kn GROUP BY 1",
    "de": "SELECT feature_id, s0, t0 / s0 AS flat, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS dw, t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) AS d0 FROM su",
    "ft": "SELECT feature_id, m, sqrt(pow(10.0, CASE WHEN dw > 1e-10 * s0 ** 3 THEN d0 / dw ELSE flat END)) AS sd FROM st JOIN de USING (feature_id)",
    "vn": "SELECT d.feature_id, var_samp(least((d.value - f.m) / f.sd, sqrt(CAST((SELECT count(*) FROM obs) AS DOUBLE)))) AS variance_norm FROM dense d JOIN ft f ON f.feature_id = d.feature_id GROUP BY 1",
}


@query("tk2_select_panel", sql(
    "SELECT feature_id, variance_norm, row_number() OVER (ORDER BY variance_norm DESC, feature_id) AS rank FROM vn QUALIFY rank <= 50", "variance_norm", "rank", HVG))
def _(t: Tables):
    return topk.select_panel(t.counts(), t.obs(), 50)


TERMS = {"terms": "SELECT p_brand AS label, p_type AS term, p_size % 2 AS method, round(avg(p_retailprice) / 1000 - 0.9::DOUBLE, 9) AS nes, round(min(p_size) / 500.0::DOUBLE, 9) AS q FROM part GROUP BY 1, 2, 3"}


@query("tk3_select_terms", sql(
    "SELECT label, term, min(r) AS best_rank, count(DISTINCT method) AS n_methods FROM (SELECT *, row_number() OVER (PARTITION BY label, method ORDER BY q, nes DESC, term) AS r FROM terms WHERE nes > 0 AND q < 0.05) WHERE r <= 2 GROUP BY 1, 2", "", "best_rank n_methods", TERMS))
def _(t: Tables):
    r = t.read("part").groupBy(F.col("p_brand").alias("label"), F.col("p_type").alias("term"), (F.col("p_size") % 2).alias("method")).agg(
        F.round(F.avg("p_retailprice") / 1000 - 0.9, 9).alias("nes"), F.round(F.min("p_size") / 500.0, 9).alias("q")
    )
    return topk.select_terms(r, 2, ["label"])


@query("tk4_peak_slice", sql(
    "SELECT label, z, n FROM (SELECT label, z, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, z) AS r FROM axis_obs GROUP BY 1, 2) WHERE r = 1", "", "z n"))
def _(t: Tables):
    return topk.peak_slice(t.axis_obs().groupBy("label", "z").agg(F.count(F.lit(1)).alias("n")), ["label"], "z", "n").withColumn("z", F.col("z").cast("long"))


@query("tk5_capped_sample", sql(
    "SELECT obs_id, label FROM (SELECT obs_id, label, row_number() OVER (PARTITION BY label ORDER BY (obs_id * 7919) % 1000003, obs_id) AS r FROM axis_obs) WHERE r <= 120"))
def _(t: Tables):
    return topk.capped_sample_arithmetic(t.axis_obs().select("obs_id", "label"), ["label"], 120, "obs_id")


BEST = {
    "bc": "SELECT l_linenumber AS setting, l_returnflag AS direction, l_partkey AS gene, round(avg(l_discount), 9) AS v FROM lineitem GROUP BY 1, 2, 3",
    "s1": "SELECT setting FROM bc GROUP BY 1 ORDER BY avg(v) DESC, 1 LIMIT 1",
    "d1": "SELECT direction FROM bc WHERE setting = (SELECT setting FROM s1) GROUP BY 1 ORDER BY avg(v) DESC, 1 LIMIT 1",
    "b1": "SELECT * FROM bc WHERE setting = (SELECT setting FROM s1) AND direction = (SELECT direction FROM d1)",
}


@query("tk6_choose_best_case", sql(
    "SELECT setting, direction, gene, v, (SELECT quantile_cont(v, 0.95::DOUBLE) FROM b1) AS cut FROM b1 WHERE v >= (SELECT quantile_cont(v, 0.95::DOUBLE) FROM b1) ORDER BY v, gene LIMIT 1", "v cut", extra=BEST))
def _(t: Tables):
    rows = t.read("lineitem").groupBy(
        F.col("l_linenumber").alias("setting"), F.col("l_returnflag").alias("direction"), F.col("l_partkey").alias("gene")
    ).agg(F.round(F.avg("l_discount"), 9).alias("v"))
    return topk.choose_best_case(rows, "v", "setting", "direction", "gene")


@query("tk7_panel_order", sql(
    "SELECT method, metric, value AS median, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'tax' THEN value ELSE -value END NULLS LAST, method) AS position FROM mr", "median", "position", RANKED))
def _(t: Tables):
    return topk.panel_order(_ranked(t).withColumnRenamed("value", "median"), lower_is_better=["tax"])


# --- sets --------------------------------------------------------------------


@query("st1_union_tables", sql(
    "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region"))
def _(t: Tables):
    n = t.read("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return topk.union_tables(n, t.read("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("st2_common_rows", sql(
    "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'"))
def _(t: Tables):
    li = t.read("lineitem")
    return topk.common_rows(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"])


@query("st3_missing_and_extra", sql(
    """SELECT l_partkey, 'missing' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3) UNION ALL SELECT l_partkey, 'extra' FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48)"""))
def _(t: Tables):
    li = t.read("lineitem")
    return topk.missing_and_extra(li.where("l_quantity < 3"), li.where("l_quantity > 48"), ["l_partkey"])


@query("st4_distinct_overlap", sql(
    "SELECT count(*) FILTER (WHERE a) AS n_left, count(*) FILTER (WHERE b) AS n_right, count(*) FILTER (WHERE a AND b) AS n_common FROM (SELECT l_partkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)"))
def _(t: Tables):
    li = t.read("lineitem")
    return topk.distinct_overlap(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), ["l_partkey"])
