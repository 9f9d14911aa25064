"""Continuity and selection along an ordered axis of slices.

Slices are metadata: windows here run over one row per slice, never over
observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, finite, pearson, ratio
from tallyscope.functions.ordered import exact_quantiles, positions, running_totals


def metric_ranks(long: DataFrame, lower_is_better: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Competition rank (ties take the lowest) per metric, NULL values unranked."""
    signed = F.when(F.col(metric).isin(*lower_is_better), F.col(value)).otherwise(-F.col(value))
    v = long.withColumn("_s", signed)
    # ranks from distinct values and running counts: no one-task sort per metric
    c = v.where(F.col("_s").isNotNull()).groupBy(metric, "_s").agg(F.count(F.lit(1)).alias("n"))
    r = running_totals(c, [metric], "_s", ["n"]).select(metric, "_s", (F.col("cum_n") - F.col("n") + 1).alias("rank"))
    return v.join(r, [metric, "_s"], "left").drop("_s")


def complete_case(long: DataFrame, lower_is_better: Sequence[str] = (), sample: str = "sample", method: str = "method", metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean per (metric, method) over samples where every method has a value, with its rank."""
    n = long.agg(F.countDistinct(method).alias("_k"))
    full = long.groupBy(metric, sample).agg(F.count(value).alias("_c"))
    keep = attach(full, n, ()).where(F.col("_c") == F.col("_k")).select(metric, sample)
    m = long.join(keep, [metric, sample]).groupBy(metric, method).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_samples")
    )
    place = Window.partitionBy(metric).orderBy("_signed")
    signed = F.when(F.col(metric).isin(*lower_is_better), F.col("mean")).otherwise(-F.col("mean"))
    # one row per metric and method
    return m.withColumn("_signed", signed).withColumn("rank", F.rank().over(place)).drop("_signed")


def adjacent_pairs(means: DataFrame, z: str = "z_index", by: Sequence[str] = ()) -> DataFrame:
    """Feature means of each slice next to those of the following slice.

    ``means`` is (by…, z, label, feature_id, mean); only shared labels pair up,
    a feature missing on one side of a shared label is 0 there.  Features that
    are nowhere in ``means`` do not count: give means over the whole panel.
    """
    labels = means.select(*by, z, "label").distinct()
    shared = labels.join(labels.withColumn(z, F.col(z) - 1).withColumn("_next", F.lit(True)), [*by, z, "label"])
    keys = [*by, z, "label", "feature_id"]
    here = means.join(shared.select(*by, z, "label"), [*by, z, "label"], "left_semi").select(*keys, F.col("mean").alias("a"), F.lit(0.0).alias("b"))
    after = means.withColumn(z, F.col(z) - 1).join(shared.select(*by, z, "label"), [*by, z, "label"], "left_semi").select(
        *keys, F.lit(0.0).alias("a"), F.col("mean").alias("b")
    )
    return here.unionByName(after).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def adjacent_metrics(means: DataFrame, z: str = "z_index", by: Sequence[str] = ()) -> DataFrame:
    """Correlation and mean absolute log change between neighbouring slices."""
    p = adjacent_pairs(means, z, by)
    return p.groupBy(*by, z).agg(
        F.countDistinct("label").alias("shared_labels"), pearson("a", "b").alias("pearson"),
        pearson(F.log1p("a"), F.log1p("b")).alias("log1p_pearson"),
        F.avg(F.abs(F.log1p("b") - F.log1p("a"))).alias("mean_abs_log_change"),
        F.avg(F.abs(F.col("b") - F.col("a"))).alias("mean_abs_change"),
    )


def adjacent_gene_metrics(means: DataFrame, z: str = "z_index", by: Sequence[str] = ()) -> DataFrame:
    """The same for whole slices: correlations and mean absolute log change of the feature means of neighbours.

    ``means`` is (by…, z, feature_id, mean) over the whole panel.  A feature
    missing in one slice of a pair is 0 there; a slice without a following one has no row.
    """
    p = adjacent_pairs(means.withColumn("label", F.lit("")), z, by)
    return p.groupBy(*by, z).agg(
        pearson("a", "b").alias("gene_mean_pearson"), pearson(F.log1p("a"), F.log1p("b")).alias("log1p_gene_mean_pearson"),
        F.avg(F.abs(F.log1p("b") - F.log1p("a"))).alias("mean_abs_log1p_gene_change"),
    )


def z_coherence(pairs: DataFrame, z: str = "z", minimum: int = 3, label: str = "label") -> DataFrame:
    """Pearson of two trajectories per class and feature over at least ``minimum`` levels.

    ``pairs`` is (z, label, feature_id, left, right) with both sides present.
    """
    g = pairs.groupBy(label, "feature_id").agg(
        F.countDistinct(z).alias("n_z_levels"), F.min(z).alias("z_min"), F.max(z).alias("z_max"),
        pearson("left", "right").alias("z_coherence"),
    )
    return g.where((F.col("n_z_levels") >= minimum) & F.col("z_coherence").isNotNull())


def split_half(obs: DataFrame, by: Sequence[str], id_col: str = "obs_id", label: str = "label", minimum: int = 2, order: str | None = None) -> DataFrame:
    """Repeatable halving within each class: first ⌊n/2⌋ rows in hash order are ``left``.

    Positions come from a keyed order that splits large classes, so a class may
    be of any size.  ``order`` names a unique order column in place of the hash.
    """
    keys = [*by, label]
    key = F.struct(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i")) if order is None else F.col(order)
    rows = obs.select(*keys, id_col, key.alias("_key"))
    placed = positions(rows, keys, "_key", "_pos")
    n = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(n, keys).where(F.col("_n") >= minimum).select(
        *keys, id_col, F.when(F.col("_pos") < F.floor(F.col("_n") / 2), "left").otherwise("right").alias("half")
    )


def split_half_means(counts: DataFrame, halves: DataFrame, by: Sequence[str], label: str = "label", features: DataFrame | None = None) -> DataFrame:
    """Feature means of both halves of every class, side by side; of every panel member, if a panel is given."""
    keys = [*by, label]
    sizes = halves.groupBy(*keys).agg(
        F.count_if(F.col("half") == "left").alias("_nl"), F.count_if(F.col("half") == "right").alias("_nr")
    )
    s = counts.join(halves, [*by, "obs_id"]).groupBy(*keys, "feature_id").agg(
        F.sum(F.when(F.col("half") == "left", F.col("value")).otherwise(0)).alias("_l"),
        F.sum(F.when(F.col("half") == "right", F.col("value")).otherwise(0)).alias("_r"),
    )
    if features is None:
        rows = s.join(sizes, keys)
    else:
        rows = features.select("feature_id").distinct().crossJoin(sizes).join(s, [*keys, "feature_id"], "left").fillna(0, ["_l", "_r"])
    return rows.select(
        *keys, "feature_id", (F.col("_l") / F.col("_nl")).alias("left"), (F.col("_r") / F.col("_nr")).alias("right")
    )


def continuity_summary(generated: DataFrame, baseline: DataFrame, value: str = "z_coherence") -> DataFrame:
    """Medians of both coherence tables and their ratio."""
    out = None
    for name, df in (("generated", generated), ("baseline", baseline)):
        v = df.withColumn("_v", finite(value))
        s = attach(
            v.agg(F.count("_v").alias(f"{name}_n"), F.avg("_v").alias(f"{name}_mean")),
            exact_quantiles(v, (), "_v", {f"{name}_median": 0.5}), (),
        )
        out = s if out is None else attach(out, s, ())
    return out.withColumn("normalized_z_coherence", ratio("generated_median", "baseline_median"))


def age_summary(adjacent: DataFrame, by: Sequence[str], value: str, z: str, error: str) -> DataFrame:
    """median, minimum and its position, largest error, covered range."""
    s = adjacent.groupBy(*by).agg(
        F.min(value).alias("min_value"), F.min(F.struct(value, z)).alias("_m"), F.max(error).alias("max_error"),
        F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.count(F.lit(1)).alias("n_pairs"),
    ).withColumn("z_at_min", F.col(f"_m.{z}")).drop("_m")
    return attach(s, exact_quantiles(adjacent, by, value, {"median_value": 0.5}), by)


def z_index(slices: DataFrame, z: str = "z", by: Sequence[str] = (), name: str = "z_index") -> DataFrame:
    """0-based order of the distinct z levels."""
    levels = positions(slices.select(*by, z).distinct(), by, z, name)
    return slices.join(levels, [*by, z])


def select_references(slices: DataFrame, gap: int, extras: Sequence = (), by: Sequence[str] = (), z: str = "z", id_col: str = "slice_id") -> DataFrame:
    """Every gap-th slice, both ends and the extras are references, the rest targets."""
    key = F.struct(F.col(z).alias("z"), F.col(id_col).alias("i"))
    placed = positions(slices.withColumn("_key", key), by, "_key", "pos").drop("_key")
    n = placed.groupBy(*by).agg(F.max("pos").alias("_last"))
    j = attach(placed, n, by)
    ref = (F.col("pos") % gap == 0) | (F.col("pos") == F.col("_last"))
    if extras:
        ref |= F.col(id_col).isin(*extras)
    return j.withColumn("role", F.when(ref, "reference").otherwise("target")).drop("_last")


def partition_audit(roles: DataFrame, by: Sequence[str] = (), id_col: str = "slice_id") -> DataFrame:
    """References and targets are disjoint and cover every slice exactly once."""
    per = roles.groupBy(*by, id_col).agg(F.count(F.lit(1)).alias("_c"))
    dup = per.groupBy(*by).agg(F.count_if(F.col("_c") > 1).alias("n_overlap"), F.count(F.lit(1)).alias("n_slices"))
    s = roles.groupBy(*by).agg(
        F.count_if(F.col("role") == "reference").alias("n_references"), F.count_if(F.col("role") == "target").alias("n_targets")
    )
    return attach(s, dup, by).withColumn(
        "exact_partition", (F.col("n_overlap") == 0) & (F.col("n_references") + F.col("n_targets") == F.col("n_slices"))
    )


def representatives(slices: DataFrame, count: int, by: Sequence[str] = (), id_col: str = "slice_id") -> DataFrame:
    """``count`` ids at evenly spaced positions of the sorted distinct ids."""
    placed = positions(slices.select(*by, id_col).distinct(), by, id_col, "pos")
    n = placed.groupBy(*by).agg((F.max("pos") + 1).alias("_n"))
    picks = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    at = F.when(F.col("_n") <= count, F.col("_i")).otherwise(
        F.bround(F.col("_i") * (F.col("_n") - 1) / F.lit(float(max(count - 1, 1))), 0)
    ).cast("long")
    wanted = picks.select(*by, at.alias("pos")).distinct()
    return placed.join(wanted, [*by, "pos"]).select(*by, id_col, "pos")


def discontinuity(df: DataFrame, keys: Sequence[str], r: str) -> DataFrame:
    """max(1 − r, 1e-12) with median, p05 and p95 over replicates."""
    d = df.withColumn("_d", F.greatest(1.0 - F.col(r), F.lit(1e-12)))
    n = d.groupBy(*keys).agg(F.count("_d").alias("replicates"))
    return attach(n, exact_quantiles(d, list(keys), "_d", {"median": 0.5, "p05": 0.05, "p95": 0.95}), keys)
