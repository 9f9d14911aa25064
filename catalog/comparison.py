"""Correlations and distances between two datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import Tables, pear, sql
from tallyscope.operators import correlation as corr
from tallyscope.operators import distance as dist
from tallyscope.operators import neighbors, stats, transform

PROFILE = {
    "prof": "SELECT feature_id, avg(a) AS rm, avg(b) AS sm, greatest(avg(a * a) - avg(a) * avg(a), 0.0) AS rv, greatest(avg(b * b) - avg(b) * avg(b), 0.0) AS sv, avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS rz, avg(CASE WHEN b = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS sz FROM cells_ab GROUP BY 1",
}


def _profiles(t: Tables):
    f = t.features()
    a = stats.gene_stats(t.ref(), t.obs(), (), f).select("feature_id", F.col("mean").alias("rm"), F.col("variance").alias("rv"), F.col("zero_fraction").alias("rz"))
    b = stats.gene_stats(t.cand(), t.obs(), (), f).select("feature_id", F.col("mean").alias("sm"), F.col("variance").alias("sv"), F.col("zero_fraction").alias("sz"))
    return a.join(b, "feature_id")


def w1(a: str, b: str, by: str = "") -> str:
    """SQL of W1 from two (by…, v) sources; ``by`` is a comma list."""
    p = f"PARTITION BY {by} " if by else ""
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {g}sum(abs(ca / CAST(na AS DOUBLE) - cb / CAST(nb AS DOUBLE)) * coalesce(nx - v, 0)) AS w FROM (
    SELECT {g}v, sum(a) OVER ({p}ORDER BY v) AS ca, sum(b) OVER ({p}ORDER BY v) AS cb, sum(a) OVER ({p}) AS na, sum(b) OVER ({p}) AS nb, lead(v) OVER ({p}ORDER BY v) AS nx FROM (
    SELECT {g}v, sum(a) AS a, sum(b) AS b FROM (SELECT {g}v, 1 AS a, 0 AS b FROM ({a}) UNION ALL SELECT {g}v, 0, 1 FROM ({b})) GROUP BY {g}v)){grp}"""


@query("cr1_safe_pearson", sql(
    f"SELECT l_returnflag, l_linenumber, {pear('q', 'e')} AS pearson FROM (SELECT l_returnflag, l_linenumber, CASE WHEN l_quantity > 1 THEN l_quantity END AS q, CASE WHEN l_quantity > 1 THEN l_extendedprice END AS e FROM lineitem WHERE l_quantity > 1) GROUP BY 1, 2 UNION ALL SELECT 'constant', 0, NULL", "pearson"))
def _(t: Tables):
    q = F.when(F.col("l_quantity") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = t.read("lineitem").select("l_returnflag", "l_linenumber", q.alias("q"), "l_extendedprice")
    flat = t.read("lineitem").select(F.lit("constant").alias("l_returnflag"), F.lit(0).alias("l_linenumber"), F.lit(3.0).alias("q"), "l_extendedprice")
    return corr.safe_pearson(rows.unionByName(flat), "q", "l_extendedprice", ["l_returnflag", "l_linenumber"])


@query("cr2_log_corr", sql(
    f"SELECT coalesce({pear('ln(1 + rm)', 'ln(1 + sm)', 'rm > 1e-10 AND sm > 1e-10')}, 0.0) AS mean_corr, coalesce({pear('ln(1 + rv)', 'ln(1 + sv)', 'rv > 1e-10 AND sv > 1e-10')}, 0.0) AS variance_corr FROM prof",
    "mean_corr variance_corr", extra=PROFILE))
def _(t: Tables):
    p = _profiles(t)
    from tallyscope.functions.exprs import attach

    return attach(corr.log_corr(p, "rm", "sm", (), "mean_corr"), corr.log_corr(p, "rv", "sv", (), "variance_corr"), ())


@query("cr3_column_pearson", sql(f"SELECT feature_id, {pear('a', 'b')} AS pearson FROM cells_ab GROUP BY 1 HAVING sum(a) + sum(b) > 0", "pearson"))
def _(t: Tables):
    return corr.column_pearson(t.ref(), t.cand(), t.obs())


RANKS = {"rk": "SELECT obs_id, feature_id, rank() OVER (PARTITION BY feature_id ORDER BY a) + (count(*) OVER (PARTITION BY feature_id, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY feature_id ORDER BY b) + (count(*) OVER (PARTITION BY feature_id, b) - 1) / 2.0::DOUBLE AS rb, a, b FROM cells_ab"}


@query("cr4_column_spearman", sql(f"SELECT feature_id, {pear('ra', 'rb')} AS spearman FROM rk GROUP BY 1 HAVING sum(a) + sum(b) > 0", "spearman", extra=RANKS))
def _(t: Tables):
    return corr.column_spearman(t.ref(), t.cand(), t.obs())


@query("cr5_row_pearson", sql(f"SELECT obs_id, {pear('a', 'b')} AS pearson FROM cells_ab GROUP BY 1 HAVING sum(a) + sum(b) > 0", "pearson"))
def _(t: Tables):
    return corr.row_pearson(t.ref(), t.cand(), t.features())


@query("cr6_profile_metrics", sql(
    f"""SELECT obs_id, log_pearson, CASE WHEN ta > 0 AND tb > 0 THEN sqrt(greatest(j, 0.0)) END AS js_distance FROM (SELECT obs_id, {pear('ln(1.0 + a)', 'ln(1.0 + b)')} AS log_pearson, max(ta) AS ta, max(tb) AS tb,
    sum(0.5::DOUBLE * CASE WHEN a > 0 THEN a / ta * log2((a / ta) / ((a / ta + b / tb) / 2.0)) ELSE 0 END + 0.5::DOUBLE * CASE WHEN b > 0 THEN b / tb * log2((b / tb) / ((a / ta + b / tb) / 2.0)) ELSE 0 END) AS j
    FROM (SELECT obs_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(sum(a) OVER (PARTITION BY obs_id) AS DOUBLE) AS ta, CAST(sum(b) OVER (PARTITION BY obs_id) AS DOUBLE) AS tb FROM cells_ab) GROUP BY 1)""",
    "log_pearson js_distance"))
def _(t: Tables):
    return corr.profile_metrics(t.ref(), t.cand(), t.features())


@query("cr7_spearman", sql(
    """SELECT l_returnflag, corr(r1, r2) AS spearman FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS r1,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS r2 FROM lineitem) GROUP BY 1""", "spearman"))
def _(t: Tables):
    return corr.spearman(t.read("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("cr8_pseudobulk_corr", sql(
    f"SELECT avg(r) AS pseudobulk_corr, count(r) AS n_labels FROM (SELECT label, {pear('a', 'b')} AS r FROM (SELECT label, feature_id, avg(a) AS a, avg(b) AS b FROM cells_ab GROUP BY 1, 2) GROUP BY 1)",
    "pseudobulk_corr", "n_labels"))
def _(t: Tables):
    f = t.features()
    return corr.pseudobulk_corr(stats.class_means(t.ref(), t.obs(), features=f), stats.class_means(t.cand(), t.obs(), features=f))


@query("ds1_wasserstein", sql(
    w1("SELECT l_linestatus, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'R'", "SELECT l_linestatus, l_extendedprice AS v FROM lineitem WHERE l_returnflag <> 'R'", "l_linestatus").replace(" AS w ", " AS wasserstein "),
    "wasserstein"))
def _(t: Tables):
    li = t.read("lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return dist.wasserstein(li.where(F.col("l_returnflag") == "R"), li.where(F.col("l_returnflag") != "R"), "l_extendedprice", ["l_linestatus"])


LOGN2 = {
    "na": "SELECT d.obs_id, d.label, d.feature_id, CASE WHEN s.t > 0 THEN ln(1.0 + d.value * (10000.0::DOUBLE / s.t)) ELSE 0.0 END AS value FROM dense_ref d LEFT JOIN (SELECT obs_id, sum(value) AS t FROM ref GROUP BY 1) s ON s.obs_id = d.obs_id",
    "nb": "SELECT d.obs_id, d.label, d.feature_id, CASE WHEN s.t > 0 THEN ln(1.0 + d.value * (10000.0::DOUBLE / s.t)) ELSE 0.0 END AS value FROM dense_cand d LEFT JOIN (SELECT obs_id, sum(value) AS t FROM cand GROUP BY 1) s ON s.obs_id = d.obs_id",
    "sorted_w1": "SELECT label, feature_id, avg(abs(a.value - b.value)) AS w1 FROM (SELECT label, feature_id, value, row_number() OVER (PARTITION BY label, feature_id ORDER BY value) AS r FROM na) a JOIN (SELECT label, feature_id, value, row_number() OVER (PARTITION BY label, feature_id ORDER BY value) AS r FROM nb) b USING (label, feature_id, r) GROUP BY 1, 2",
    "shares": "SELECT label, count(*) / CAST((SELECT count(*) FROM obs) AS DOUBLE) AS share FROM obs GROUP BY 1",
}


@query("ds2_conditional_expression_w1", sql(
    "SELECT quantile_cont(w, 0.5::DOUBLE) AS conditional_expression_w1 FROM (SELECT feature_id, sum(share * w1) AS w FROM sorted_w1 JOIN shares USING (label) GROUP BY 1)", "conditional_expression_w1", extra=LOGN2))
def _(t: Tables):
    o = t.obs()
    return dist.conditional_expression_w1(transform.log_normalize(t.ref()), o, transform.log_normalize(t.cand()), o, t.features())


@query("ds2_expression_w1_by_label", sql("SELECT s.label, s.feature_id, s.w1 FROM sorted_w1 s JOIN (SELECT label, feature_id FROM cells_ab GROUP BY 1, 2 HAVING sum(a) + sum(b) > 0) u ON u.label = s.label AND u.feature_id = s.feature_id", "w1", extra=LOGN2))
def _(t: Tables):
    o = t.obs()
    return dist.expression_w1(transform.log_normalize(t.ref()), o, transform.log_normalize(t.cand()), o)


ZERO_W1 = w1("SELECT label, avg(CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM cells_ab GROUP BY label, feature_id",
             "SELECT label, avg(CASE WHEN b = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM cells_ab GROUP BY label, feature_id", "label")


@query("ds3_conditional_zero_w1", sql(f"SELECT sum(share * w) AS conditional_zero_w1 FROM ({ZERO_W1}) JOIN shares USING (label)", "conditional_zero_w1", extra=LOGN2))
def _(t: Tables):
    return dist.conditional_zero_w1(t.ref(), t.obs(), t.cand(), t.obs(), t.features())


SUPPORT = {
    "ca": "SELECT nation AS label, count(*) / CAST((SELECT count(*) FROM obs WHERE y < 60) AS DOUBLE) AS s FROM obs WHERE y < 60 GROUP BY 1",
    "cb": "SELECT nation AS label, count(*) / CAST((SELECT count(*) FROM obs WHERE y > 40) AS DOUBLE) AS s FROM obs WHERE y > 40 GROUP BY 1",
    "cs": "SELECT coalesce(ca.label, cb.label) AS label, coalesce(ca.s, 0.0) AS ts, coalesce(cb.s, 0.0) AS cs, CASE WHEN cb.s IS NULL THEN 'missing_generated' WHEN ca.s IS NULL THEN 'extra_generated' ELSE 'shared' END AS support FROM ca FULL JOIN cb ON ca.label = cb.label",
}


def _support_sides(t: Tables):
    o = t.obs().withColumn("label", F.col("nation"))
    return o.where(F.col("y") < 60), o.where(F.col("y") > 40)


@query("ds4_class_support", sql("SELECT label, ts AS target_share, cs AS cand_share, support FROM cs", "target_share cand_share", extra=SUPPORT))
def _(t: Tables):
    return dist.class_support(*_support_sides(t))


@query("ds4_conditional_with_support", sql(
    """SELECT 'all' AS part, CASE WHEN sum(CASE WHEN support = 'missing_generated' THEN ts ELSE 0 END) = 0 THEN sum(ts * label) FILTER (WHERE support = 'shared') END AS score, sum(CASE WHEN support = 'missing_generated' THEN ts ELSE 0.0 END) AS missing_mass, sum(CASE WHEN support = 'extra_generated' THEN cs ELSE 0.0 END) AS extra_mass FROM cs
    UNION ALL SELECT 'same', sum(s * label), 0.0, 0.0 FROM ca""", "score missing_mass extra_mass", extra=SUPPORT))
def _(t: Tables):
    a, b = _support_sides(t)
    score = t.read("nation").select(F.col("n_nationkey").alias("label"), F.col("n_nationkey").cast("double").alias("score"))
    one = dist.conditional_with_support(score, a, b, "score").withColumn("part", F.lit("all"))
    return one.unionByName(dist.conditional_with_support(score, a, a, "score").withColumn("part", F.lit("same")))


@query("ds5_ks_stat", sql(
    """SELECT l_linestatus, max(abs(ca / CAST(na AS DOUBLE) - cb / CAST(nb AS DOUBLE))) AS ks FROM (SELECT l_linestatus, sum(a) OVER (PARTITION BY l_linestatus ORDER BY v) AS ca, sum(b) OVER (PARTITION BY l_linestatus ORDER BY v) AS cb, sum(a) OVER (PARTITION BY l_linestatus) AS na, sum(b) OVER (PARTITION BY l_linestatus) AS nb
    FROM (SELECT l_linestatus, l_extendedprice AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1, 2)) GROUP BY 1""", "ks"))
def _(t: Tables):
    li = t.read("lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return dist.ks_stat(li.where(F.col("l_returnflag") == "R"), li.where(F.col("l_returnflag") != "R"), "l_extendedprice", ["l_linestatus"])


JSD = {"jrows": "SELECT coalesce(a.spot, b.spot) AS spot, coalesce(a.type, b.type) AS type, coalesce(a.p, 0.0) AS a, coalesce(b.p, 0.0) AS b FROM comp0 a FULL JOIN comp1 b ON a.spot = b.spot AND a.type = b.type",
       "jd": "SELECT spot, sum(0.5::DOUBLE * CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2.0)) ELSE 0 END + 0.5::DOUBLE * CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2.0)) ELSE 0 END) AS jsd FROM jrows GROUP BY 1"}


@query("ds6_jsd", sql("SELECT * FROM jd", "jsd", extra=JSD))
def _(t: Tables):
    return dist.jsd(t.comp(0), t.comp(1))


@query("ds7_class_tv", sql(
    """SELECT 0.5::DOUBLE * sum(abs(ts - cs)) AS class_tv, sum(CASE WHEN support = 'missing_generated' THEN ts ELSE 0 END) AS missing_mass, sum(CASE WHEN support = 'extra_generated' THEN cs ELSE 0 END) AS extra_mass,
    abs((SELECT count(*) FROM obs WHERE y > 40) - (SELECT count(*) FROM obs WHERE y < 60)) / CAST((SELECT count(*) FROM obs WHERE y < 60) AS DOUBLE) AS count_relative_error FROM cs""",
    "class_tv missing_mass extra_mass count_relative_error", extra=SUPPORT))
def _(t: Tables):
    return dist.class_tv(*_support_sides(t))


def _total(t: Tables):
    return t.obs().agg(F.count(F.lit(1)).alias("n")).crossJoin(t.features().agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") * F.col("m")).alias("total"))


@query("ds8_zero_jaccard", sql("SELECT count(*) FILTER (WHERE a = 0 AND b = 0) / CAST(count(*) FILTER (WHERE a = 0 OR b = 0) AS DOUBLE) AS zero_jaccard FROM cells_ab", "zero_jaccard"))
def _(t: Tables):
    return dist.zero_jaccard(t.ref(), t.cand(), _total(t))


COSINE = "SELECT obs_id, 1.0 - sum(ln(1.0 + a) * ln(1.0 + b)) / greatest(sqrt(sum(ln(1.0 + a) * ln(1.0 + a))) * sqrt(sum(ln(1.0 + b) * ln(1.0 + b))), 1e-12) AS d FROM cells_ab GROUP BY 1"


@query("ds9_cosine_divergence", sql(f"SELECT quantile_cont(d, 0.5::DOUBLE) AS cosine_divergence FROM ({COSINE})", "cosine_divergence"))
def _(t: Tables):
    return dist.cosine_divergence(t.ref(), t.cand(), t.obs())


@query("ds10_relative_error_mean", sql("SELECT avg(abs(rm - sm) / (rm + 1e-10)) AS relative_error_mean, avg(abs(rm - sm) / greatest(abs(rm), 1e-8)) AS relative_error_floor FROM prof WHERE rm > 0", "relative_error_mean relative_error_floor", extra=PROFILE))
def _(t: Tables):
    return dist.relative_error_mean(_profiles(t).where(F.col("rm") > 0), "rm", "sm")


@query("ds11_rmse", sql(
    "SELECT sum((a - b) * (a - b)) AS squared_error, sqrt(sum((a - b) * (a - b)) / (SELECT count(*) FROM customer) / 5) AS rmse FROM jrows", "squared_error rmse", extra=JSD))
def _(t: Tables):
    total = t.read("customer").agg((F.count(F.lit(1)) * 5).alias("total"))
    return dist.rmse(t.comp(0), t.comp(1), ["spot", "type"], total)


MMD = {
    "pd": "SELECT a.batch AS ba, b.batch AS bb, list_distance(a.vec, b.vec) AS d FROM points a CROSS JOIN points b",
    "bw": "SELECT quantile_cont(d, 0.5::DOUBLE) AS w FROM pd WHERE d > 0",
}


@query("ds12_mmd2_rbf", sql(
    """SELECT greatest(avg(k) FILTER (WHERE ba = 0 AND bb = 0) + avg(k) FILTER (WHERE ba = 1 AND bb = 1) - 2.0 * avg(k) FILTER (WHERE ba = 0 AND bb = 1), 0.0) AS mmd2, max(w) AS bandwidth
    FROM (SELECT ba, bb, w, exp(-d * d / (2.0 * w * w)) AS k FROM pd CROSS JOIN bw)""", "mmd2 bandwidth", extra=MMD))
def _(t: Tables):
    return neighbors.mmd2_rbf(t.points().select("obs_id", "batch", "vec"), "batch", 0, 1)


VL = {"vlong": "SELECT obs_id, batch, i - 1 AS dim, vec[i] AS v FROM (SELECT obs_id, batch, vec, unnest(range(1, len(vec) + 1)) AS i FROM points)"}


@query("ds13_centroid_distance", sql(
    "SELECT sqrt(sum((a - b) * (a - b))) AS centroid_distance FROM (SELECT dim, avg(v) FILTER (WHERE batch = 0) AS a, avg(v) FILTER (WHERE batch = 1) AS b FROM vlong GROUP BY 1)", "centroid_distance", extra=VL))
def _(t: Tables):
    return dist.centroid_distance(t.points(), "vec", "batch")


@query("ds13_covariance_distance", sql(
    """SELECT sqrt(sum((a - b) * (a - b))) / (max(i) + 1) AS covariance_distance FROM (SELECT p.dim AS i, q.dim AS j, covar_samp(p.v, q.v) FILTER (WHERE p.batch = 0) AS a, covar_samp(p.v, q.v) FILTER (WHERE p.batch = 1) AS b
    FROM vlong p JOIN vlong q ON p.obs_id = q.obs_id GROUP BY 1, 2)""", "covariance_distance", extra=VL))
def _(t: Tables):
    return dist.covariance_distance(t.points().select("batch", "vec"), "vec", "batch")


CKA = {"m": "SELECT obs_id, i - 1 AS dim, vec[i] AS u, greatest(0.0, round(vec[i] * 20.0::DOUBLE)) AS v FROM (SELECT obs_id, vec, unnest(range(1, len(vec) + 1)) AS i FROM points)"}


@query("ds14_linear_cka", sql(
    """SELECT sum(xy * xy) / (sqrt(sum(xx * xx)) * sqrt(sum(yy * yy))) AS linear_cka FROM (SELECT p.dim AS i, q.dim AS j, covar_pop(p.u, q.v) AS xy, covar_pop(p.u, q.u) AS xx, covar_pop(p.v, q.v) AS yy FROM m p JOIN m q ON p.obs_id = q.obs_id GROUP BY 1, 2)""",
    "linear_cka", extra=CKA))
def _(t: Tables):
    p = t.points().select("vec", F.transform("vec", lambda e: F.greatest(F.lit(0.0), F.round(e.cast("double") * 20.0))).alias("other"))
    return dist.linear_cka(p, "vec", "other")


DRAWN = {
    "dpos": "SELECT *, row_number() OVER (ORDER BY obs_id) - 1 AS pos, count(*) OVER () AS n FROM points",
    "dpairs": "SELECT DISTINCT least(pos, q) AS i, greatest(pos, q) AS j FROM (SELECT pos, (pos + 1 + (pos * 7919 + t * 104729) % (n - 1)) % n AS q FROM dpos CROSS JOIN range(50) r(t))",
}


@query("ds15_distance_spearman", sql(
    """SELECT corr(ra, rb) AS distance_spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM (
    SELECT round(list_distance(p.vec, q.vec), 9) AS a, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS b FROM dpairs JOIN dpos p ON p.pos = i JOIN dpos q ON q.pos = j))""", "distance_spearman", extra=DRAWN))
def _(t: Tables):
    return neighbors.distance_spearman(t.points().withColumn("xy", F.array("x", "y")), "vec", "xy", draws=50)


@query("ds16_theta_rmse", sql(
    """SELECT l.label, sqrt(avg((l.log_mu - g.log_mu) ** 2)) AS rmse_log_mu, sqrt(avg((l.omega - g.omega) ** 2)) AS rmse_omega, sqrt(avg((l.logit_pi0 - g.logit_pi0) ** 2)) AS rmse_logit_pi0,
    sqrt(avg(((l.log_mu - g.log_mu) ** 2 + (l.omega - g.omega) ** 2 + (l.logit_pi0 - g.logit_pi0) ** 2) / 3.0)) AS rmse_theta FROM th l JOIN th2 g ON g.label = l.label AND g.feature_id = l.feature_id GROUP BY 1""",
    "rmse_log_mu rmse_omega rmse_logit_pi0 rmse_theta", extra={
        name: f"SELECT label, feature_id, ln(greatest(mean, 1e-10)) AS log_mu, ln(greatest(variance / greatest(mean, 1e-10), 1e-10)) AS omega, ln(p / (1.0 - p)) AS logit_pi0 FROM (SELECT *, least(greatest(zf, 1e-10), 1.0 - 1e-10) AS p FROM (SELECT label, feature_id, avg({c}) AS mean, greatest(avg({c} * {c}) - avg({c}) * avg({c}), 0.0) AS variance, avg(CASE WHEN {c} = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zf FROM cells_ab GROUP BY 1, 2))"
        for name, c in (("th", "a"), ("th2", "b"))}))
def _(t: Tables):
    lab = t.obs().select("obs_id", "label")

    def theta(c):
        return transform.gene_theta(c.join(lab, "obs_id"), lab, ["label"], t.features())

    return dist.theta_rmse(theta(t.ref()), theta(t.cand()), ["label"])
