"""Resampling baselines, rankings and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import METRICS, Tables, sql
from tallyscope.functions.session import checkpointed
from tallyscope.operators import enrich, resample, stats, transform
from tallyscope.operators.multinomial import multiplicities

DRAWS = {
    "src": "SELECT obs_id, label, row_number() OVER (PARTITION BY label ORDER BY obs_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n FROM obs WHERE nation % 2 = 0",
    "tgt": "SELECT o.obs_id AS target_id, o.label, r AS replicate FROM obs o CROSS JOIN (SELECT unnest(range(0, 3)) AS r) WHERE label IN (SELECT label FROM src)",
    "dn": "SELECT t.label, t.target_id, t.replicate, s.obs_id AS donor_id FROM tgt t JOIN src s ON s.label = t.label AND s.idx = (t.target_id * 2654435761 + t.replicate * 40503 + 11) % s.n",
}


def _sides(t: Tables):
    o = t.obs()
    src = o.where("nation % 2 = 0").select("obs_id", "label")
    return src, o.select("obs_id", "label").join(src.select("label").distinct(), "label", "left_semi")


def _donors(t: Tables):
    return resample.conditional_donors(*_sides(t), 3, 11, draw=resample.arithmetic_draw)


@query("rs1_conditional_donors", sql("SELECT * FROM dn", "", "replicate", DRAWS))
def _(t: Tables):
    return _donors(t).withColumn("replicate", F.col("replicate").cast("long"))


@query("rs1_resampled_counts", sql("SELECT replicate, target_id AS obs_id, feature_id, value FROM dn JOIN counts ON obs_id = donor_id", "", "replicate value", DRAWS))
def _(t: Tables):
    return resample.resampled_counts(t.counts(), _donors(t))


WEIGHTED = {
    "rfs": "SELECT nation AS slice_id, label, obs_id, row_number() OVER (PARTITION BY nation, label ORDER BY obs_id) - 1 AS idx, count(*) OVER (PARTITION BY nation, label) AS n FROM obs",
    "opt": "SELECT DISTINCT label, slice_id, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + slice_id % 3 END AS w, n FROM rfs",
    "tgs": "SELECT obs_id AS target_id, label, r AS replicate, ((obs_id * 48271 + r * 7919) % 1000003) / 1000003.0::DOUBLE AS u FROM obs CROSS JOIN (SELECT unnest(range(0, 2)) AS r) WHERE label IN (SELECT label FROM opt)",
    "cum": "SELECT *, sum(w) OVER (PARTITION BY label ORDER BY slice_id) AS hi, sum(w) OVER (PARTITION BY label ORDER BY slice_id) - w AS lo, sum(w) OVER (PARTITION BY label) AS tot FROM opt",
}


@query("rs2_weighted_slices", sql(
    "SELECT t.target_id, t.replicate, c.slice_id, t.label FROM tgs t JOIN cum c ON c.label = t.label AND t.u * c.tot >= c.lo AND t.u * c.tot < c.hi", "", "replicate", WEIGHTED))
def _(t: Tables):
    o = t.obs().select("obs_id", "label", F.col("nation").alias("slice_id"))
    # the slices of one class have no weights, so that its donors are the declared ones
    weights = o.where("label <> 0").select("slice_id").distinct().select(
        F.lit(0).alias("target_slice"), "slice_id", (1.0 + F.col("slice_id") % 3).alias("weight")
    )
    spare = o.where("label = 0").select(F.lit(0).alias("target_slice"), "label", "slice_id").distinct()
    target = o.select(F.lit(0).alias("target_slice"), "label", "obs_id")
    u = F.pmod(F.col("obs_id") * 48271 + F.col("replicate") * 7919, F.lit(1000003)) / 1000003.0
    d = resample.weighted_donors(o, weights, spare, target, 2, 5, uniform=u)
    return d.select("target_id", F.col("replicate").cast("long").alias("replicate"), "slice_id", "label")


BOOT = {**DRAWS,
    "bp": "SELECT label, count(*) * 2 AS n_spots FROM obs WHERE label IN (SELECT label FROM src) GROUP BY 1",
    "bd": "SELECT b.label, b.n_spots, r AS replicate, s.obs_id FROM (SELECT label, n_spots, unnest(range(0, n_spots)) AS d FROM bp) b CROSS JOIN (SELECT unnest(range(0, 2)) AS r) JOIN src s ON s.label = b.label AND s.idx = (b.d * 2654435761 + r * 40503 + 4) % s.n",
    "bm": "SELECT label, replicate, feature_id, max(n_spots) AS n_spots, sum(value) / CAST(max(n_spots) AS DOUBLE) AS mean FROM bd JOIN counts USING (obs_id) GROUP BY 1, 2, 3",
}


def _boot(t: Tables):
    src, tgt = _sides(t)
    bp = tgt.groupBy("label").agg((F.count(F.lit(1)) * 2).alias("n_spots"))
    return resample.bootstrap_region_mean(t.counts(), src, bp, 2, 4, draw=resample.arithmetic_draw), bp


@query("rs3_bootstrap_region_mean", sql("SELECT label, replicate, feature_id, n_spots, mean FROM bm", "mean", "replicate n_spots", BOOT))
def _(t: Tables):
    return _boot(t)[0].withColumn("replicate", F.col("replicate").cast("long"))


@query("rs3_split_multiplicities", sql(
    """SELECT b.label, r AS replicate, n_spots * 500000 AS drawn, n AS donors, TRUE AS inside, TRUE AS even FROM bp b JOIN (SELECT label, max(n) AS n FROM src GROUP BY 1) USING (label) CROSS JOIN (SELECT unnest(range(0, 2)) AS r)""",
    "", "replicate drawn donors", BOOT))
def _(t: Tables):
    """A million draws per target: their sum, the donors met, and whether chi-square is that of even draws."""
    src, tgt = _sides(t)
    n = src.groupBy("label").agg(F.count(F.lit(1)).alias("n_donors"))
    g = tgt.groupBy("label").agg((F.count(F.lit(1)) * 1_000_000).alias("n_draws")).join(n, "label")
    g = g.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    m = multiplicities(g, ["label", "replicate"], seed=4).join(g, ["label", "replicate"])
    mean = F.col("n_draws") / F.col("n_donors")
    square = F.sum(F.pow(F.col("times") - mean, F.lit(2)) / mean)
    free = F.max("n_donors") - 1
    return m.groupBy("label", "replicate").agg(
        F.sum("times").alias("drawn"), F.countDistinct("idx").alias("donors"), F.max((F.col("idx") >= 0) & (F.col("idx") < F.col("n_donors"))).alias("inside"),
        (F.abs(square - free) <= 6 * F.sqrt(2 * free) + 6).alias("even"),
    )


@query("rs3_sampled_state", sql("SELECT replicate, feature_id, sum(n_spots / CAST((SELECT sum(n_spots) FROM bp) AS DOUBLE) * mean) AS mean FROM bm GROUP BY 1, 2", "mean", "replicate", BOOT))
def _(t: Tables):
    return resample.sampled_state(*_boot(t)).withColumn("replicate", F.col("replicate").cast("long"))


@query("rs4_comparison_frame", sql(
    """SELECT b.sample, b.metric, b.m AS baseline_mean, b.s AS baseline_sd, b.p05 AS baseline_p05, b.p95 AS baseline_p95, v.value, v.value - b.m AS difference FROM (SELECT sample, metric, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.05::DOUBLE) AS p05, quantile_cont(value, 0.95::DOUBLE) AS p95 FROM metric_long WHERE method > 0 GROUP BY 1, 2) b
    JOIN metric_long v ON v.method = 0 AND v.sample = b.sample AND v.metric = b.metric""", "baseline_mean baseline_sd baseline_p05 baseline_p95 value difference"))
def _(t: Tables):
    w = t.metric_long()
    return resample.comparison_frame(w.where("method = 0"), stats.replicate_summary(w.where("method > 0"), ["sample"], METRICS), ["sample"], METRICS)


# --- rankings and gene sets --------------------------------------------------

# The number of sets grows with the parts, their size does not.
SETS = {"sets": "SELECT p_brand || '-' || CAST(p_partkey // 1000 AS VARCHAR) AS term, p_partkey AS feature_id FROM part UNION SELECT p_type || '-' || CAST(p_size % 7 AS VARCHAR) || '-' || CAST(p_partkey // 2000 AS VARCHAR), p_partkey FROM part"}


def _sets(t: Tables):
    p = t.read("part")
    part = lambda n: F.floor(F.col("p_partkey") / n).cast("string")
    rows = p.select(F.concat_ws("-", "p_brand", part(1000)).alias("term"), "p_partkey").unionByName(
        p.select(F.concat_ws("-", "p_type", (F.col("p_size") % 7).cast("string"), part(2000)).alias("term"), "p_partkey")
    )
    return rows.groupBy("term").agg(F.collect_set("p_partkey").alias("members"))


@query("gs1_gene_set_coverage", sql(
    "SELECT term, count(*) AS original_genes, count(u.l_partkey) AS matched_genes, count(u.l_partkey) / CAST(count(*) AS DOUBLE) AS panel_coverage, count(u.l_partkey) BETWEEN 15 AND 60 AS eligible FROM sets LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) u ON u.l_partkey = feature_id GROUP BY 1", "panel_coverage", extra=SETS))
def _(t: Tables):
    u = t.read("lineitem").select(F.col("l_partkey").alias("feature_id"))
    return enrich.gene_set_coverage(_sets(t), u, 15, 60)


RANK = {
    "rk": "SELECT obs_id, label, feature_id, value, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY feature_id, value) AS t FROM dense",
    "ties": "SELECT feature_id, sum(t * t - 1.0::DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM rk GROUP BY 1",
    "ws": "SELECT feature_id, label, sum(r) AS w, CAST(count(*) AS DOUBLE) AS n1 FROM rk GROUP BY 1, 2",
    "zs": "SELECT feature_id, label, CASE WHEN 1.0 - c / (n * n * n - n) > 0 THEN (w - n1 * (n + 1) / 2.0) / sqrt((1.0 - c / (n * n * n - n)) * n1 * (n - n1) * (n + 1) / 12.0) ELSE 0.0 END AS score FROM ws JOIN ties USING (feature_id)",
}


@query("gs2_rank_features", sql("SELECT feature_id, label, score FROM zs", "score", extra=RANK))
def _(t: Tables):
    return enrich.rank_features(t.counts(), t.obs())


@query("gs3_log_fold_change", sql(
    """SELECT feature_id, label, log2((exp(s / n) - 1 + 1e-9) / (exp((tot - s) / (nn - n)) - 1 + 1e-9)) AS log2_fold_change FROM (SELECT feature_id, label, sum(v) AS s, count(*) AS n, sum(sum(v)) OVER (PARTITION BY feature_id) AS tot, sum(count(*)) OVER (PARTITION BY feature_id) AS nn FROM ln GROUP BY 1, 2)""",
    "log2_fold_change", extra={"ln": "SELECT d.obs_id, d.label, d.feature_id, ln(1.0 + d.value * (10000.0::DOUBLE / s.t)) AS v FROM dense d JOIN (SELECT obs_id, sum(value) AS t FROM counts GROUP BY 1) s ON s.obs_id = d.obs_id"}))
def _(t: Tables):
    return enrich.log_fold_change(transform.log_normalize(t.counts()), t.obs())


ES = {**SETS,
    "rg": "SELECT l_returnflag AS label, l_partkey AS feature_id, round(avg(l_discount) - 0.05::DOUBLE, 9) AS score FROM lineitem GROUP BY 1, 2",
    "op": "SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, feature_id) AS pos, count(*) OVER (PARTITION BY label) AS ng FROM rg",
    "hit": "SELECT o.label, s.term, o.feature_id, o.pos, o.ng, abs(o.score) AS w, row_number() OVER (PARTITION BY o.label, s.term ORDER BY o.pos) AS k, count(*) OVER (PARTITION BY o.label, s.term) AS nh, sum(abs(o.score)) OVER (PARTITION BY o.label, s.term) AS tot, sum(abs(o.score)) OVER (PARTITION BY o.label, s.term ORDER BY o.pos) AS cw FROM op o JOIN sets s USING (feature_id)",
    "dv": "SELECT *, cw / tot - (pos - k) / CAST(ng - nh AS DOUBLE) AS af, (cw - w) / tot - (pos - k) / CAST(ng - nh AS DOUBLE) AS be FROM hit WHERE nh BETWEEN 15 AND 500",
    "pk": "SELECT label, term, max(nh) AS n_hits, max(ng) AS n_genes, max(af) AS up, min(be) AS dn, arg_min(pos, (-af, pos)) AS pu, arg_min(pos, (be, pos)) AS pd FROM dv GROUP BY 1, 2",
    "es": "SELECT *, CASE WHEN abs(up) >= abs(dn) THEN up ELSE dn END AS es, CASE WHEN abs(up) >= abs(dn) THEN pu ELSE pd END AS at FROM pk",
}


def _ranking(t: Tables):
    return t.read("lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("feature_id")).agg(
        F.round(F.avg("l_discount") - 0.05, 9).alias("score")
    )


@query("gs4_enrichment_scores", sql(
    """SELECT e.label, e.term, e.n_hits, e.n_genes, e.es, count(*) / CAST(max(e.n_hits) AS DOUBLE) AS tag_fraction, CASE WHEN abs(e.up) >= abs(e.dn) THEN e.at ELSE e.n_genes - e.at + 1 END / CAST(e.n_genes AS DOUBLE) AS gene_fraction, string_agg(CAST(d.feature_id AS VARCHAR), ',' ORDER BY d.pos) AS leading_edge
    FROM es e JOIN dv d ON d.label = e.label AND d.term = e.term AND (CASE WHEN abs(e.up) >= abs(e.dn) THEN d.pos <= e.at ELSE d.pos >= e.at END) GROUP BY ALL""", "es tag_fraction gene_fraction", extra=ES))
def _(t: Tables):
    e = enrich.enrichment_scores(_ranking(t), _sets(t), ["label"])
    return e.withColumn("leading_edge", F.concat_ws(",", F.transform("leading_edge", lambda g: g.cast("string"))))


PERMUTATIONS = 100


def _placed(walks: int = 6) -> str:
    """(label, m, n, p, pos): the keyed bijection at 0 … m - 1, round by round."""
    prime, mix, keyed, step = enrich.PRIME, enrich.MIX, enrich.KEYED, enrich.STEP
    key = f"(p * 7919 + m * 104729 + 2026) % {prime}"
    q = f"SELECT label, m, n, p, {key} AS key, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b, i AS x, true AS todo FROM (SELECT DISTINCT label, CAST(n_hits AS BIGINT) AS m, CAST(n_genes AS BIGINT) AS n FROM es) CROSS JOIN (SELECT unnest(range(0, {PERMUTATIONS})) AS p), LATERAL (SELECT unnest(range(0, m)) AS i)"
    for _ in range(walks):
        q = f"SELECT label, m, n, p, key, a, b, x, todo, x // b AS l, x % b AS r FROM ({q})"
        for j in range(enrich.ROUNDS):
            v, digit, size = ("r", "l", "a") if j % 2 == 0 else ("l", "r", "b")
            t = f"(({v} + 1) * {mix} + key * {keyed} + {j} * {step}) % {prime}"
            q = f"SELECT label, m, n, p, key, a, b, x, todo, l, r, (t * t % {prime} * {keyed} + {v}) % {prime} AS t FROM (SELECT *, {t} AS t FROM ({q}))"
            other = "r" if digit == "l" else "l"
            q = f"SELECT label, m, n, p, key, a, b, x, todo, ({digit} + t * t % {prime}) % {size} AS {digit}, {other} FROM ({q})"
        q = f"SELECT label, m, n, p, key, a, b, x, x >= n AS todo FROM (SELECT label, m, n, p, key, a, b, CASE WHEN todo THEN l * b + r ELSE x END AS x FROM ({q}))"
    return f"SELECT label, m, n, p, x + 1 AS pos FROM ({q})"


NULLS = {**ES,
    "nullhits": "SELECT d.label, d.m, d.n, d.p, d.pos, abs(o.score) AS w, row_number() OVER v AS k, sum(abs(o.score)) OVER v AS cw, sum(abs(o.score)) OVER (PARTITION BY d.label, d.m, d.p) AS tot FROM (" + _placed() + ") d JOIN op o ON o.label = d.label AND o.pos = d.pos WINDOW v AS (PARTITION BY d.label, d.m, d.p ORDER BY d.pos)",
    "nn": "SELECT label, m, p, CASE WHEN abs(up) >= abs(dn) THEN up ELSE dn END AS e FROM (SELECT label, m, p, max(cw / tot - (pos - k) / CAST(n - m AS DOUBLE)) AS up, min((cw - w) / tot - (pos - k) / CAST(n - m AS DOUBLE)) AS dn FROM nullhits GROUP BY 1, 2, 3)",
    "nm": "SELECT label, m, sign(e) AS s, count(*) AS c, avg(abs(e)) AS mean FROM nn GROUP BY ALL",
    "sc": "SELECT es.label, es.term, es.n_hits, es.es, sign(es.es) AS s, mean, CASE WHEN c >= 10 AND mean > 0 THEN es.es / mean END AS nes FROM es LEFT JOIN nm ON nm.label = es.label AND nm.m = es.n_hits AND nm.s = sign(es.es)",
    "np": "SELECT sc.label, sc.term, count(*) FILTER (WHERE abs(e) >= abs(es)) / CAST(count(*) AS DOUBLE) AS p FROM sc JOIN nn ON nn.label = sc.label AND nn.m = sc.n_hits AND sign(e) = sc.s WHERE nes IS NOT NULL GROUP BY 1, 2",
    "pool": "SELECT nn.label, sign(e) AS s, abs(e) / mean AS v, k AS c FROM nn JOIN nm ON nm.label = nn.label AND nm.m = nn.m AND nm.s = sign(e) JOIN (SELECT label, n_hits, count(*) AS k FROM sc WHERE nes IS NOT NULL GROUP BY 1, 2) t ON t.label = nn.label AND t.n_hits = nn.m WHERE mean > 0",
    "fq": "SELECT label, term, least(((SELECT coalesce(sum(c), 0) FROM pool WHERE pool.label = sc.label AND pool.s = sc.s AND pool.v >= abs(sc.nes)) / CAST((SELECT sum(c) FROM pool WHERE pool.label = sc.label AND pool.s = sc.s) AS DOUBLE)) / ((SELECT count(*) FROM sc d WHERE d.label = sc.label AND d.s = sc.s AND abs(d.nes) >= abs(sc.nes)) / CAST((SELECT count(*) FROM sc d WHERE d.label = sc.label AND d.s = sc.s AND d.nes IS NOT NULL) AS DOUBLE)), 1.0) AS q FROM sc WHERE nes IS NOT NULL",
}


def _null(t: Tables):
    r = _ranking(t)
    e = checkpointed(enrich.enrichment_scores(r, _sets(t), ["label"]))
    return e, enrich.permutation_null(r, e.select("label", "n_hits"), ["label"], PERMUTATIONS)


@query("gs5_permutation_null", sql("SELECT label, m AS n_hits, p AS permutation, e AS null_es FROM nn", "null_es", "n_hits permutation", NULLS))
def _(t: Tables):
    return _null(t)[1].withColumn("permutation", F.col("permutation").cast("long"))


@query("gs5_enrichment_significance", sql(
    "SELECT sc.label, sc.term, sc.n_hits, sc.es, sc.nes, np.p AS nominal_p, fq.q AS fdr_q FROM sc LEFT JOIN np USING (label, term) LEFT JOIN fq USING (label, term)", "es nes nominal_p fdr_q", "n_hits", NULLS))
def _(t: Tables):
    e, null = _null(t)
    return enrich.enrichment_significance(e.select("label", "term", "n_hits", "es"), null, ["label"])


ENR = {
    "er": "SELECT p_size % 5 AS label, p_brand AS term, p_retailprice % 2 AS rep, round(avg(p_retailprice) / 1000.0 - 0.95::DOUBLE, 9) AS nes, round(min(p_size) / 100.0::DOUBLE, 9) AS q FROM part GROUP BY 1, 2, 3",
    "e0": "SELECT p_size % 5 AS label, p_brand AS term, CASE WHEN p_brand <> 'Brand#3' THEN round(avg(p_partkey) % 7 - 3::DOUBLE, 9) END AS nes, round(min(p_size) / 100.0::DOUBLE, 9) AS q FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2",
    "e1": "SELECT p_size % 5 AS label, p_brand AS term, round(avg(p_partkey) % 5 - 2::DOUBLE, 9) AS nes, round(max(p_size % 13) / 100.0::DOUBLE, 9) AS q FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2",
    "eb": "SELECT p_size % 5 AS label, p_brand AS term, p_partkey % 4 AS replicate, round(avg(p_partkey) % 3 - 1::DOUBLE, 9) AS nes, round(min(p_size) / 100.0::DOUBLE, 9) AS q FROM part GROUP BY 1, 2, 3",
    "jj": "SELECT e0.label, e0.term, e0.nes AS rn, e0.q AS rq, e1.nes AS cn, e1.q AS cq FROM e0 JOIN e1 ON e0.label = e1.label AND e0.term = e1.term",
    "jo": "SELECT *, rn > 0 AND rq < 0.05 AS rp, cn > 0 AND cq < 0.05 AS cpos FROM jj WHERE rn IS NOT NULL AND cn IS NOT NULL",
    "jr": "SELECT label, rank() OVER (PARTITION BY label ORDER BY rn) + (count(*) OVER (PARTITION BY label, rn) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY label ORDER BY cn) + (count(*) OVER (PARTITION BY label, cn) - 1) / 2.0::DOUBLE AS b FROM jo",
}


def _enrichments(t: Tables):
    p = t.read("part")
    g = [(F.col("p_size") % 5).alias("label"), F.col("p_brand").alias("term")]
    q = F.round(F.min("p_size") / 100.0, 9).alias("q")
    a = p.where("p_partkey % 2 = 0").groupBy(*g).agg(F.round(F.avg("p_partkey") % 7 - 3, 9).alias("nes"), q)
    a = a.withColumn("nes", F.when(F.col("term") != "Brand#3", F.col("nes")))
    b = p.where("p_partkey % 2 = 1").groupBy(*g).agg(F.round(F.avg("p_partkey") % 5 - 2, 9).alias("nes"), F.round(F.max(F.col("p_size") % 13) / 100.0, 9).alias("q"))
    base = p.groupBy(*g, (F.col("p_partkey") % 4).alias("replicate")).agg(F.round(F.avg("p_partkey") % 3 - 1, 9).alias("nes"), q)
    return a, b, base


@query("gs6_recovery_metrics", sql(
    """SELECT label, n_terms, nes_mae, direction_agreement, real_positive, candidate_positive, recovered, CASE WHEN real_positive > 0 THEN recovered / CAST(real_positive AS DOUBLE) END AS recall, CASE WHEN candidate_positive > 0 THEN recovered / CAST(candidate_positive AS DOUBLE) END AS precision,
    CASE WHEN real_positive + candidate_positive > recovered THEN recovered / CAST(real_positive + candidate_positive - recovered AS DOUBLE) END AS jaccard, nes_spearman FROM (SELECT label, count(*) AS n_terms, avg(abs(rn - cn)) AS nes_mae, avg(CASE WHEN sign(rn) = sign(cn) THEN 1.0::DOUBLE ELSE 0.0 END) AS direction_agreement, count(*) FILTER (WHERE rp) AS real_positive, count(*) FILTER (WHERE cpos) AS candidate_positive, count(*) FILTER (WHERE rp AND cpos) AS recovered FROM jo GROUP BY 1)
    JOIN (SELECT label, corr(a, b) AS nes_spearman FROM jr GROUP BY 1) USING (label)""", "nes_mae direction_agreement recall precision jaccard nes_spearman", extra=ENR))
def _(t: Tables):
    a, b, _ = _enrichments(t)
    return enrich.recovery_metrics(a, b, ["label"])


@query("gs7_term_status", sql(
    """SELECT j.label, j.term, rn AS real_nes, cn AS method_nes, CASE WHEN rn IS NULL OR cn IS NULL THEN 'unavailable' WHEN rn > 0 AND rq < 0.05 AND cn > 0 AND cq < 0.05 THEN 'recovered' WHEN rn > 0 AND rq < 0.05 THEN 'real_only' WHEN cn > 0 AND cq < 0.05 THEN 'method_only' ELSE 'neither' END AS status, m AS baseline_mean, p05 AS baseline_p05, p95 AS baseline_p95, pf AS baseline_positive_fraction
    FROM jj j LEFT JOIN (SELECT label, term, avg(nes) AS m, quantile_cont(nes, 0.05::DOUBLE) AS p05, quantile_cont(nes, 0.95::DOUBLE) AS p95, avg(CASE WHEN nes > 0 AND q < 0.05 THEN 1.0::DOUBLE ELSE 0.0 END) AS pf FROM eb GROUP BY 1, 2) b ON b.label = j.label AND b.term = j.term""",
    "real_nes method_nes baseline_mean baseline_p05 baseline_p95 baseline_positive_fraction", extra=ENR))
def _(t: Tables):
    return enrich.term_status(*_enrichments(t), ["label"])


@query("gs8_group_summary", sql(
    """SELECT metric, count(*) AS n_pairs, count(value + bm) AS valid_pairs, count(*) FILTER (WHERE CASE WHEN metric = 'tax' THEN value < bm ELSE value > bm END) AS better_pairs, quantile_cont(value, 0.5::DOUBLE) AS method_median, quantile_cont(bm, 0.5::DOUBLE) AS baseline_median
    FROM (SELECT v.metric, v.value, b.m AS bm FROM (SELECT sample, metric, avg(value) AS m FROM metric_long WHERE method > 0 GROUP BY 1, 2) b JOIN metric_long v ON v.method = 0 AND v.sample = b.sample AND v.metric = b.metric) GROUP BY 1""", "method_median baseline_median"))
def _(t: Tables):
    w = t.metric_long()
    c = resample.comparison_frame(w.where("method = 0"), stats.replicate_summary(w.where("method > 0"), ["sample"], METRICS), ["sample"], METRICS)
    return enrich.group_summary(c, [], ("tax",))


@query("pc1_pca_spread")
def _(t: Tables):
    """Sample variance of each component's scores: free of the sign of the axes."""
    from tallyscope.operators import voxel

    scores, _ = voxel.pca(t.points(), "vec", 10)
    return transform.explode_vector(scores, "pc", ["obs_id"]).groupBy("dim").agg(F.var_samp("v").alias("variance"), F.count(F.lit(1)).alias("n"))


PCA = {
    "lp": "SELECT obs_id, CAST(sum(value) AS DOUBLE) AS lib FROM place_counts GROUP BY 1",
    "dp": "SELECT p.obs_id, d.feature_id, coalesce(ln(1 + c.value * (10000.0::DOUBLE / lib)), 0.0) AS v FROM points p CROSS JOIN dims d LEFT JOIN place_counts c ON c.obs_id = p.obs_id AND c.feature_id = d.feature_id LEFT JOIN lp ON lp.obs_id = p.obs_id",
}


@query("pc1_sparse_components", sql(
    "SELECT k AS components, k AS n_variances, total, 0.0 AS gap, CASE WHEN k = 64 THEN total END AS held FROM (SELECT unnest([10, 20, 50, 64]) AS k) CROSS JOIN (SELECT sum(v) AS total FROM (SELECT var_samp(v) AS v FROM dp GROUP BY feature_id))",
    "total gap held", "components n_variances", PCA))
def _(t: Tables):
    """Components of log-normalised sparse counts, by what must hold of them: the variance of the table, how far the
    variance of any score is from the Rayleigh quotient of its component, and that all components hold it all."""
    from tallyscope.operators.sparse_pca import sparse_pca

    cells, obs = checkpointed(transform.log_normalize(t.place_counts())), t.points().select("obs_id")
    out = None
    for k in (10, 20, 50, 64):
        found = sparse_pca(cells, obs, k, rtol=1e-6)
        # the score of each observation again, from the loadings and the stored cells
        again = cells.join(found.loadings, "feature_id").select("obs_id", F.posexplode(F.transform("loading", lambda v: v * F.col("value"))).alias("dim", "v")).groupBy("obs_id", "dim").agg(F.sum("v").alias("v"))
        n = obs.count()
        spread = again.groupBy("dim").agg(((F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v") / n) / (n - 1)).alias("rayleigh"))
        own = transform.explode_vector(found.scores, "pc", ["obs_id"]).groupBy("dim").agg(F.var_samp("v").alias("variance"))
        row = own.join(spread, "dim").agg(
            F.lit(k).cast("long").alias("components"), F.count(F.lit(1)).alias("n_variances"), F.lit(found.total_variance).alias("total"),
            F.max(F.abs(F.col("variance") - F.col("rayleigh"))).alias("gap"), (F.sum("variance") if k == 64 else F.lit(None).cast("double")).alias("held"),
        )
        out = row if out is None else out.unionByName(row)
    return out.select("components", "n_variances", *[(F.round(c, 6) + 0.0).alias(c) for c in ("total", "gap", "held")])
