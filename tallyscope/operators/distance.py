"""Distances between two distributions, tables or embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach
from tallyscope.functions.ordered import exact_quantiles, running_totals
from tallyscope.operators.correlation import paired_cells
from tallyscope.operators.gram import distance_of, gram_summaries
from tallyscope.operators.stats import class_means, label_sizes, n_obs


def two_sample(a: DataFrame, b: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their multiplicity in either sample."""
    rows = a.select(*by, F.col(value).cast("double").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionAll(
        b.select(*by, F.col(value).cast("double").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb"))
    )
    return rows.where(F.col("v").isNotNull()).groupBy(*by, "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def _cdf_gap(samples: DataFrame, by: Sequence[str], split_rows: int) -> DataFrame:
    t = running_totals(samples, by, "v", ["na", "nb"], split_rows)
    # totals are zero only for a one-sided group, whose gap must be NULL
    fa = F.when(F.col("total_na") > 0, F.col("cum_na") / F.col("total_na"))
    fb = F.when(F.col("total_nb") > 0, F.col("cum_nb") / F.col("total_nb"))
    return t.withColumn("gap", F.abs(fa - fb))


def wasserstein_from_samples(samples: DataFrame, by: Sequence[str] = (), name: str = "wasserstein", split_rows: int | None = None) -> DataFrame:
    """W1 = Σ |F − G| · (next value − value); needs both samples, else NULL."""
    g = _cdf_gap(samples, by, split_rows)
    step = F.col("gap") * F.coalesce(F.col("next_v") - F.col("v"), F.lit(0.0))
    agg = F.when(F.count("gap") > 0, F.sum(step)).alias(name)
    return g.groupBy(*by).agg(agg)


def wasserstein(a: DataFrame, b: DataFrame, value: str, by: Sequence[str] = (), name: str = "wasserstein", split_rows: int | None = None) -> DataFrame:
    return wasserstein_from_samples(two_sample(a, b, by, value), by, name, split_rows)


def ks_stat(a: DataFrame, b: DataFrame, value: str, by: Sequence[str] = (), name: str = "ks", split_rows: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov statistic."""
    g = _cdf_gap(two_sample(a, b, by, value), by, split_rows)
    return g.groupBy(*by).agg(F.max("gap").alias(name))


def _labelled(counts: DataFrame, obs: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    keys = [*by, "obs_id"]
    return counts.where(F.col("value") != 0).join(obs.select(*keys, label), keys)


def expression_w1(
    a: DataFrame, a_obs: DataFrame, b: DataFrame, b_obs: DataFrame, by: Sequence[str] = (), label: str = "label",
    split_rows: int | None = None,
) -> DataFrame:
    """W1 per (label, feature) between two sparse tables, absent cells as zeros.

    Values are compressed to (value, count) before ranking and the zeros enter
    as one more pair, so the cost follows the stored cells.
    """
    keys = [*by, label]
    g = [*keys, "feature_id"]
    sizes = label_sizes(a_obs, by, label).select(*keys, F.col("n_obs").alias("_sa")).join(
        label_sizes(b_obs, by, label).select(*keys, F.col("n_obs").alias("_sb")), keys
    )
    stored = two_sample(_labelled(a, a_obs, by, label), _labelled(b, b_obs, by, label), g, "value")
    nnz = stored.groupBy(*g).agg(F.sum("na").alias("_za"), F.sum("nb").alias("_zb")).join(sizes, keys)
    zeros = nnz.select(
        *g, F.lit(0.0).alias("v"), (F.col("_sa") - F.col("_za")).alias("na"), (F.col("_sb") - F.col("_zb")).alias("nb")
    ).where((F.col("na") > 0) | (F.col("nb") > 0))
    both = stored.join(sizes.select(*keys), keys, "left_semi").unionByName(zeros)
    return wasserstein_from_samples(both, g, "w1", split_rows)


def label_shares(obs: DataFrame, by: Sequence[str] = (), label: str = "label", name: str = "share") -> DataFrame:
    total = n_obs(obs, by, "_total")
    return attach(label_sizes(obs, by, label), total, by).select(
        *by, label, (F.col("n_obs") / F.col("_total")).alias(name)
    )


def conditional_expression_w1(
    target: DataFrame, target_obs: DataFrame, cand: DataFrame, cand_obs: DataFrame, features: DataFrame,
    by: Sequence[str] = (), label: str = "label", split_rows: int | None = None,
) -> DataFrame:
    """Median over the panel of the share-weighted per-label W1.

    Panel features without any stored cell have distance 0 and take part.
    """
    w = expression_w1(target, target_obs, cand, cand_obs, by, label, split_rows)
    per = w.join(label_shares(target_obs, by, label), [*by, label]).groupBy(*by, "feature_id").agg(
        F.sum(F.col("share") * F.col("w1")).alias("w1")
    )
    # empty panel features only matter as a count of zeros: one weighted row per group
    width = features.agg(F.countDistinct("feature_id").alias("_w"))
    present = per.groupBy(*by).agg(F.count(F.lit(1)).alias("_p"))
    pad = attach(present, width, ()).where(F.col("_w") > F.col("_p")).select(
        *by, F.lit(0.0).alias("w1"), (F.col("_w") - F.col("_p")).alias("_n")
    )
    rows = per.select(*by, "w1", F.lit(1).cast("long").alias("_n")).unionByName(pad)
    return exact_quantiles(rows, by, "w1", {"conditional_expression_w1": 0.5}, weight="_n", split_rows=split_rows)


def zero_fractions_by_label(counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(by, label, zero_fraction, n): distribution over the panel, compressed."""
    m = class_means(counts, obs, by, label)
    width = features.agg(F.countDistinct("feature_id").alias("_w"))
    keys = [*by, label]
    stored = m.groupBy(*keys, F.col("zero_fraction").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    seen = stored.groupBy(*keys).agg(F.sum("n").alias("_s"))
    rest = attach(label_sizes(obs, by, label).select(*keys).join(seen, keys, "left"), width, ()).select(
        *keys, F.lit(1.0).alias("v"), (F.col("_w") - F.coalesce("_s", F.lit(0))).alias("n")
    ).where(F.col("n") > 0)
    return stored.unionByName(rest).groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def zero_w1_by_label(
    target: DataFrame, target_obs: DataFrame, cand: DataFrame, cand_obs: DataFrame, features: DataFrame,
    by: Sequence[str] = (), label: str = "label",
) -> DataFrame:
    keys = [*by, label]
    a = zero_fractions_by_label(target, target_obs, features, by, label)
    b = zero_fractions_by_label(cand, cand_obs, features, by, label)
    both = a.select(*keys, "v", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")).unionByName(
        b.select(*keys, "v", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"))
    ).groupBy(*keys, "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return wasserstein_from_samples(both, keys, "zero_w1")


def conditional_zero_w1(
    target: DataFrame, target_obs: DataFrame, cand: DataFrame, cand_obs: DataFrame, features: DataFrame,
    by: Sequence[str] = (), label: str = "label",
) -> DataFrame:
    """Share-weighted sum over labels of W1 between per-feature zero fractions."""
    w = zero_w1_by_label(target, target_obs, cand, cand_obs, features, by, label)
    return w.join(label_shares(target_obs, by, label), [*by, label]).groupBy(*by).agg(
        F.sum(F.col("share") * F.col("zero_w1")).alias("conditional_zero_w1")
    )


def class_support(target_obs: DataFrame, cand_obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Both shares of each class and whether it is shared, missing or extra."""
    keys = [*by, label]
    t = label_shares(target_obs, by, label, "target_share")
    c = label_shares(cand_obs, by, label, "cand_share")
    j = t.join(c, keys, "full")
    return j.select(
        *keys, F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("cand_share", F.lit(0.0)).alias("cand_share"),
        F.when(F.col("cand_share").isNull(), "missing_generated")
        .when(F.col("target_share").isNull(), "extra_generated").otherwise("shared").alias("support"),
    )


def class_tv(target_obs: DataFrame, cand_obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Total variation of class shares, missing and extra mass, count error."""
    s = class_support(target_obs, cand_obs, by, label).groupBy(*by).agg(
        (0.5 * F.sum(F.abs(F.col("target_share") - F.col("cand_share")))).alias("class_tv"),
        F.sum(F.when(F.col("support") == "missing_generated", F.col("target_share")).otherwise(0.0)).alias("missing_mass"),
        F.sum(F.when(F.col("support") == "extra_generated", F.col("cand_share")).otherwise(0.0)).alias("extra_mass"),
    )
    n = attach(n_obs(target_obs, by, "_nt"), n_obs(cand_obs, by, "_nc"), by).select(
        *by, (F.abs(F.col("_nc") - F.col("_nt")) / F.col("_nt")).alias("count_relative_error")
    )
    return attach(s, n, by)


def conditional_with_support(
    score: DataFrame, target_obs: DataFrame, cand_obs: DataFrame, value: str, by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Share-weighted per-label score, NULL if any target class is missing.

    ``score`` is (by, label, value).
    """
    s = class_support(target_obs, cand_obs, by, label).join(score, [*by, label], "left")
    missing = F.sum(F.when(F.col("support") == "missing_generated", F.col("target_share")).otherwise(0.0))
    extra = F.sum(F.when(F.col("support") == "extra_generated", F.col("cand_share")).otherwise(0.0))
    total = F.sum(F.when(F.col("support") == "shared", F.col("target_share") * F.col(value)))
    return s.groupBy(*by).agg(
        F.when(missing == 0, total).alias(value), missing.alias("missing_mass"), extra.alias("extra_mass")
    )


def jsd_from_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base-2 Jensen–Shannon divergence of shares ``a`` and ``b`` per key."""
    m = (F.col("a") + F.col("b")) / 2.0

    def half(p: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    return cells.groupBy(*keys).agg(F.sum(0.5 * half(F.col("a")) + 0.5 * half(F.col("b"))).alias("jsd"))


def jsd(truth: DataFrame, pred: DataFrame, keys: Sequence[str] = ("spot",), item: str = "type", value: str = "p") -> DataFrame:
    """Divergence per row of two long composition tables."""
    g = [*keys, item]
    rows = truth.select(*g, F.col(value).alias("a"), F.lit(0.0).alias("b")).unionByName(
        pred.select(*g, F.lit(0.0).alias("a"), F.col(value).alias("b"))
    ).groupBy(*g).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return jsd_from_cells(rows, keys)


def zero_jaccard(a: DataFrame, b: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Jaccard of the zero masks over ``total`` dense cells (``cells`` = by…, total).

    Zeros are counted algebraically from the stored cells; no union gives 1.
    """
    c = paired_cells(a, b, by).groupBy(*by).agg(
        F.count_if((F.col("a") != 0) | (F.col("b") != 0)).alias("_or"),
        F.count_if((F.col("a") != 0) & (F.col("b") != 0)).alias("_and"),
    )
    u = F.col("total") - F.col("_and")
    return attach(c, cells, by).select(
        *by, F.when(u == 0, 1.0).otherwise((F.col("total") - F.col("_or")) / u).alias("zero_jaccard")
    )


def cosine_per_row(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    la, lb = F.log1p("a"), F.log1p("b")
    s = cells.groupBy(*keys).agg(
        F.sum(la * lb).alias("_d"), F.sqrt(F.sum(la * la)).alias("_na"), F.sqrt(F.sum(lb * lb)).alias("_nb")
    )
    return s.select(
        *keys, (1.0 - F.col("_d") / F.greatest(F.col("_na") * F.col("_nb"), F.lit(1e-12))).alias("divergence")
    )


def cosine_divergence(a: DataFrame, b: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median over the paired observations ``obs`` of 1 − cosine of log1p rows.

    A pair without any stored cell has divergence 1.
    """
    keys = [*by, "obs_id"]
    rows = obs.select(*keys).join(cosine_per_row(paired_cells(a, b, by), keys), keys, "left").fillna(1.0, ["divergence"])
    return exact_quantiles(rows, by, "divergence", {"cosine_divergence": 0.5})


def relative_error_mean(df: DataFrame, ref: str, sim: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean relative error under both guards: +1e-10 and max(|t|, 1e-8)."""
    d = F.abs(F.col(ref) - F.col(sim))
    return df.groupBy(*by).agg(
        F.avg(d / (F.col(ref) + 1e-10)).alias("relative_error_mean"),
        F.avg(d / F.greatest(F.abs(ref), F.lit(1e-8))).alias("relative_error_floor"),
    )


def rmse(truth: DataFrame, pred: DataFrame, keys: Sequence[str], cells: DataFrame, by: Sequence[str] = (), value: str = "p") -> DataFrame:
    """Root mean square over all dense cells (``cells`` = by…, total) and the plain sum."""
    rows = truth.select(*keys, F.col(value).alias("_a"), F.lit(0.0).alias("_b")).unionByName(
        pred.select(*keys, F.lit(0.0).alias("_a"), F.col(value).alias("_b"))
    ).groupBy(*keys).agg((F.sum("_a") - F.sum("_b")).alias("_d"))
    s = rows.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("squared_error"))
    return attach(s, cells, by).select(*by, "squared_error", F.sqrt(F.col("squared_error") / F.col("total")).alias("rmse"))


def _two_batches(df: DataFrame, vec: str, batch: str, by: Sequence[str], values: Column) -> DataFrame:
    """``_a`` and ``_b``: an array of the first and of the last batch of each group."""
    g = gram_summaries(df, F.col(vec), [*by, batch]).withColumn("_value", values)
    return g.groupBy(*by).agg(F.min_by("_value", batch).alias("_a"), F.max_by("_value", batch).alias("_b"), F.max(F.size("mean")).alias("_dims"))


def centroid_distance(df: DataFrame, vec: str, batch: str, by: Sequence[str] = ()) -> DataFrame:
    """Euclidean distance of the two batch centroids."""
    return _two_batches(df, vec, batch, by, F.col("mean")).select(*by, distance_of(F.col("_a"), F.col("_b")).alias("centroid_distance"))


def covariance_distance(df: DataFrame, vec: str, batch: str, by: Sequence[str] = ()) -> DataFrame:
    """Frobenius distance of the sample covariances of two batches, divided by the dimensions; NULL for a batch of one row."""
    covariance = F.when(F.col("n") > 1, F.transform("comoment", lambda c: c / (F.col("n") - 1)))
    two = _two_batches(df, vec, batch, by, covariance)
    return two.select(*by, (distance_of(F.col("_a"), F.col("_b")) / F.col("_dims")).alias("covariance_distance"))


def linear_cka(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Linear CKA of two array columns of the same rows.

    ‖XᵀY‖² / (‖XᵀX‖·‖YᵀY‖) of the centred columns: blocks of one comoment
    matrix of both columns side by side.
    """
    both = df.select(*by, F.concat(F.transform(x, lambda v: v.cast("double")), F.transform(y, lambda v: v.cast("double"))).alias("_xy"), F.size(x).alias("_left"))
    left = both.groupBy(*by).agg(F.max("_left").alias("_left"))
    g = attach(gram_summaries(both, F.col("_xy"), by), left, by)
    dims = F.size("mean")
    row, col = (lambda i: F.floor(i / dims) < F.col("_left")), (lambda i: F.pmod(i, dims) < F.col("_left"))

    def square(keep) -> Column:
        return F.aggregate(F.transform("comoment", lambda c, i: F.when(keep(i), c * c).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)

    parts = g.select(*by, square(lambda i: row(i) & ~col(i)).alias("xy"), square(lambda i: row(i) & col(i)).alias("xx"), square(lambda i: ~row(i) & ~col(i)).alias("yy"))
    den = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return parts.select(*by, F.when(den > 0, F.col("xy") / den).alias("linear_cka"))


def theta_rmse(truth: DataFrame, cand: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RMSE per parameter dimension over shared features, and over all three."""
    keys = [*by, "feature_id"]
    dims = ("log_mu", "omega", "logit_pi0")
    j = truth.select(*keys, *[F.col(d).alias(f"_t_{d}") for d in dims]).join(cand.select(*keys, *dims), keys)
    sq = {d: (F.col(d) - F.col(f"_t_{d}")) * (F.col(d) - F.col(f"_t_{d}")) for d in dims}
    return j.groupBy(*by).agg(
        *[F.sqrt(F.avg(sq[d])).alias(f"rmse_{d}") for d in dims],
        F.sqrt(F.avg((sq["log_mu"] + sq["omega"] + sq["logit_pi0"]) / 3.0)).alias("rmse_theta"),
    )
