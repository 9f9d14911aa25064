"""Normalisation and per-row feature engineering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach
from tallyscope.functions.ordered import exact_quantiles
from tallyscope.operators.stats import class_means, gene_stats


def library(counts: DataFrame, by: Sequence[str] = (), name: str = "library_size") -> DataFrame:
    return counts.groupBy(*by, "obs_id").agg(F.sum("value").alias(name))


def log_normalize(counts: DataFrame, by: Sequence[str] = (), target: float = 1e4) -> DataFrame:
    """log1p of counts scaled to ``target`` per observation; zeros stay absent.

    The totals come from a partial aggregate joined back, so one huge
    observation does not become one task.
    """
    keys = [*by, "obs_id"]
    lib = library(counts, by, "_lib")
    return counts.join(lib, keys).withColumn(
        "value", F.when(F.col("_lib") > 0, F.log1p(F.col("value") * (F.lit(target) / F.col("_lib")))).otherwise(0.0)
    ).drop("_lib")


def log_normalize_median(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As above with the median positive library of the group as the target."""
    lib = library(counts, by, "_lib")
    med = exact_quantiles(lib.where(F.col("_lib") > 0), by, "_lib", {"_target": 0.5})
    scaled = attach(counts.join(lib, [*by, "obs_id"]), med, by)
    return scaled.withColumn(
        "value",
        F.when(F.col("_lib") > 0, F.log1p(F.col("value") / F.col("_lib") * F.col("_target"))).otherwise(0.0),
    ).drop("_lib", "_target")


def explode_vector(df: DataFrame, vec: str, keys: Sequence[str]) -> DataFrame:
    """(keys, dim, v) rows of an array column."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def dimension_moments(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd of each dimension as two arrays per group."""
    d = explode_vector(df, vec, by).groupBy(*by, "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    s = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    return d.groupBy(*by).agg(s.alias("_d")).select(
        *by, F.transform("_d", lambda e: e["m"]).alias("_mean"), F.transform("_d", lambda e: e["s"]).alias("_sd")
    )


def standardize(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """z-score of each dimension with the population sd; sd 0 divides by 1."""
    z = attach(df, dimension_moments(df, vec, by), by)
    centred = F.zip_with(vec, "_mean", lambda a, m: a.cast("double") - m)
    return z.withColumn(
        vec, F.zip_with(centred, "_sd", lambda a, s: a / F.when(s == 0, F.lit(1.0)).otherwise(s))
    ).drop("_mean", "_sd")


def center(df: DataFrame, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Subtract the mean of each dimension."""
    z = attach(df, dimension_moments(df, vec, by), by)
    return z.withColumn(vec, F.zip_with(vec, "_mean", lambda a, m: a.cast("double") - m)).drop("_mean", "_sd")


def standardize_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """z-score of plain columns (coordinates)."""
    m = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    out = attach(df, m, by)
    for c in columns:
        out = out.withColumn(
            c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        )
    return out.drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def densify(counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every (observation, panel feature) cell, absent ones 0.

    The result is obs × panel by definition; the panel is laid out as an array
    on each observation and exploded, so nothing but the counts is shuffled.
    Only for panels of a few thousand features.
    """
    panel = features.agg(F.sort_array(F.collect_set("feature_id")).alias("_panel"))
    keys = [*by, "obs_id"]
    grid = attach(obs.select(*keys), panel, ()).select(*keys, F.explode("_panel").alias("feature_id"))
    return grid.join(counts.select(*keys, "feature_id", "value"), [*keys, "feature_id"], "left").fillna(0, ["value"])


def residualize(
    counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Dense cells minus the mean of their feature within the label."""
    keys = [*by, "obs_id"]
    means = class_means(counts, obs, by, label).select(*by, label, "feature_id", "mean")
    cells = densify(counts, obs, features, by).join(obs.select(*keys, label), keys)
    return cells.join(means, [*by, label, "feature_id"], "left").select(
        *keys, label, "feature_id", (F.col("value") - F.coalesce("mean", F.lit(0.0))).alias("value")
    )


def robust_scale(df: DataFrame, p: float, by: Sequence[str], value: str = "value") -> DataFrame:
    """Divide by the p-th percentile of the group (non-positive: 1), clip to [0, 1]."""
    q = exact_quantiles(df, by, value, {"_q": p / 100.0})
    denom = F.when(F.col("_q") > 0, F.col("_q")).otherwise(1.0)
    return attach(df, q, by, "left").withColumn(
        value, F.greatest(F.least(F.col(value) / denom, F.lit(1.0)), F.lit(0.0))
    ).drop("_q")


def fit_label_means(counts: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Per-label feature means: the least-squares fit on one-hot labels."""
    return class_means(counts, obs, by, label).select(*by, label, "feature_id", F.col("mean").alias("prediction"))


def predict(model: DataFrame, target: DataFrame, by: Sequence[str] = (), label: str = "label", list_rows: int = 128, shares: int = 64) -> DataFrame:
    """Predicted non-zero cells of every target observation, by its label.

    The result has a row per observation and feature of its label.  Observations
    come in lists of about ``list_rows``, copied to every share of the features, so that
    few labels still make many tasks, and the figures of a feature are computed
    before the join, not in each of its rows.  A list meets all features of a share one
    after the other; short lists that repeat are what a written result packs well.
    """
    keys, meet = [*by, label], [*by, label, "_share"]
    rows = target.select(*keys, F.struct("obs_id").alias("_o"))
    lists = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / list_rows).alias("_m"))
    ids = rows.join(lists, keys).groupBy(*keys, F.pmod(F.xxhash64("_o"), "_m").alias("_list")).agg(F.collect_list("_o").alias("_o"))
    ids = ids.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).drop("_list")
    dealt = model.withColumn("_share", F.pmod(F.xxhash64("feature_id"), F.lit(shares)).cast("int")).repartition(shares, *meet)
    j = ids.repartition(shares, *meet).join(dealt.hint("shuffle_hash"), meet).withColumn("_o", F.explode("_o"))
    return j.select(*keys, F.col("_o.obs_id").alias("obs_id"), *[c for c in model.columns if c not in keys])


THETA_FLOOR = 1e-10


def gene_theta(counts: DataFrame, obs: DataFrame, by: Sequence[str] = (), features: DataFrame | None = None) -> DataFrame:
    """log mean, log dispersion ratio and logit zero share of every feature (of the panel, if given)."""
    eps = F.lit(THETA_FLOOR)
    g = gene_stats(counts, obs, by, features)
    p = F.least(F.greatest("zero_fraction", eps), 1.0 - eps)
    m = F.greatest("mean", eps)
    return g.select(
        *by, "feature_id", F.log(m).alias("log_mu"),
        F.log(F.greatest(F.col("variance") / m, eps)).alias("omega"), F.log(p / (1.0 - p)).alias("logit_pi0"),
    )


def theta_axes(theta: DataFrame) -> DataFrame:
    """log variance = log μ + ω and the zero share behind the logit."""
    return theta.withColumns({
        "log_variance": F.col("log_mu") + F.col("omega"),
        "zero_proportion": 1.0 / (1.0 + F.exp(-F.col("logit_pi0"))),
    })


def delta_stats(a: DataFrame, b: DataFrame, n_cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Δ = log1p(a) − log1p(b) per feature over *all* paired cells.

    ``n_cells`` is (by…, n_obs): cells empty on both sides add Δ = 0.
    """
    keys = [*by, "obs_id", "feature_id"]
    d = a.select(*keys, F.col("value").alias("_a")).join(
        b.select(*keys, F.col("value").alias("_b")), keys, "full"
    ).withColumn("_d", F.log1p(F.coalesce("_a", F.lit(0))) - F.log1p(F.coalesce("_b", F.lit(0))))
    s = d.groupBy(*by, "feature_id").agg(
        F.sum("_d").alias("_s"), F.sum(F.abs("_d")).alias("_abs"), F.sum(F.col("_d") * F.col("_d")).alias("_sq"),
        F.count_if(F.col("_d") > 0).alias("_over"), F.count_if(F.col("_d") < 0).alias("_under"),
    )
    n = F.col("n_obs")
    return attach(s, n_cells, by).select(
        *by, "feature_id", (F.col("_s") / n).alias("mean_delta"), (F.col("_abs") / n).alias("mae"),
        F.sqrt(F.col("_sq") / n).alias("rmse"), (F.col("_over") / n).alias("fraction_over"),
        (F.col("_under") / n).alias("fraction_under"),
    )


def quantile_limits(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Colour limits: q99 of |v|, q99 of positive v, and the 2–98 % window."""
    v = df.select(*by, F.col(value).alias("_v"), F.abs(value).alias("_abs"),
                  F.when(F.col(value) > 0, F.col(value)).alias("_pos"))
    out = exact_quantiles(v, by, "_v", {"q02": 0.02, "q98": 0.98})
    for c, name in (("_abs", "abs_q99"), ("_pos", "positive_q99")):
        out = attach(out, exact_quantiles(v, by, c, {name: 0.99}), by, "left")
    return out
