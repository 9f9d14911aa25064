"""Feature, observation and label statistics on sparse counts.

The long table stores no zeros, so every mean divides by the dense cardinality
(the rows of ``obs``), never by the number of stored cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, finite, pearson, ratio
from tallyscope.functions.ordered import exact_quantiles


def n_obs(obs: DataFrame, by: Sequence[str] = (), name: str = "n_obs") -> DataFrame:
    return obs.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def feature_sums(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σx, Σx², non-zero cells per feature: additive, so it also streams."""
    v = F.col("value").cast("double")
    return counts.groupBy(*by, "feature_id").agg(
        F.sum(v).alias("sum_x"), F.sum(v * v).alias("sum_xx"), F.count_if(v != 0).alias("nnz")
    )


def moments(sums: DataFrame) -> DataFrame:
    """Mean, population variance and zero fraction from sums and ``n_obs``."""
    n = F.col("n_obs")
    m = F.coalesce(F.col("sum_x"), F.lit(0.0)) / n
    return sums.withColumns({
        "mean": m,
        "variance": F.greatest(F.coalesce(F.col("sum_xx"), F.lit(0.0)) / n - m * m, F.lit(0.0)),
        "zero_fraction": 1.0 - F.coalesce(F.col("nnz"), F.lit(0)) / n,
    })


def gene_stats(counts: DataFrame, obs: DataFrame, by: Sequence[str] = (), features: DataFrame | None = None) -> DataFrame:
    """mean / variance / zero_fraction per feature.

    With ``features`` every panel member appears in every group, all-zero ones
    included; without it only features with a stored cell.
    """
    sums, n = feature_sums(counts, by), n_obs(obs, by)
    if features is None:
        base = attach(sums, n, by)
    else:
        panel = features.select("feature_id").distinct()
        # groups × panel is the size of the result itself
        grid = panel.crossJoin(n)
        base = grid.join(sums, [*by, "feature_id"], "left")
    return moments(base).select(*by, "feature_id", "mean", "variance", "zero_fraction")


def row_stats(counts: DataFrame, obs: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Library size and detected features per observation."""
    keys = [*by, "obs_id"]
    s = counts.groupBy(*keys).agg(
        F.sum("value").cast("long").alias("library_size"), F.count_if(F.col("value") > 0).alias("detected")
    )
    if obs is None:
        return s
    return obs.select(*keys).join(s, keys, "left").fillna(0, ["library_size", "detected"])


def label_sizes(obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    return obs.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_obs"))


def class_sums(counts: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    keys = [*by, "obs_id"]
    return feature_sums(counts.join(obs.select(*keys, label), keys), [*by, label])


def class_means(
    counts: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label", features: DataFrame | None = None,
) -> DataFrame:
    """Label × feature mean, variance, zero fraction.

    With ``features`` every panel member appears under every label; without it
    only features with a stored cell there.
    """
    sums, sizes = class_sums(counts, obs, by, label), label_sizes(obs, by, label)
    if features is None:
        base = sums.join(sizes, [*by, label])
    else:
        # labels × panel is the size of the result itself
        base = features.select("feature_id").distinct().crossJoin(sizes).join(sums, [*by, label, "feature_id"], "left")
    return moments(base).select(*by, label, "feature_id", "n_obs", "mean", "variance", "zero_fraction")


def slice_summary(counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_spots, mean and median library and detected features, zero fraction."""
    rows = row_stats(counts, obs, by)
    means = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_spots"), F.avg("library_size").alias("mean_library"),
        F.avg("detected").alias("mean_detected"), F.sum("detected").alias("_nnz"),
    )
    lib = exact_quantiles(rows, by, "library_size", {"median_library": 0.5})
    det = exact_quantiles(rows, by, "detected", {"median_detected": 0.5})
    width = features.agg(F.countDistinct("feature_id").alias("_w"))
    out = attach(attach(attach(means, lib, by), det, by), width, ())
    return out.withColumn("zero_fraction", 1.0 - F.col("_nnz") / (F.col("n_spots") * F.col("_w"))).drop("_nnz", "_w")


def region_coverage(obs: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Rows per label and their share of the slice (labels per slice are few)."""
    c = obs.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_spots"))
    return c.withColumn("fraction", F.col("n_spots") / F.sum("n_spots").over(Window.partitionBy(*by)))


def top_n_other(df: DataFrame, category: str, weight: str, n: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """The n heaviest categories overall, the rest summed as ``Other``."""
    totals = df.groupBy(category).agg(F.sum(weight).alias("_w"))
    top = totals.orderBy(F.col("_w").desc(), category).limit(n).select(category).withColumn("_top", F.lit(True))
    named = df.join(F.broadcast(top), category, "left").withColumn(
        category, F.when(F.col("_top"), F.col(category)).otherwise("Other")
    )
    return named.groupBy(*by, category).agg(F.sum(weight).alias(weight))


def label_proportions(predicted: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Counts and shares with a zero row for every declared label."""
    c = predicted.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = predicted.agg(F.count(F.lit(1)).alias("_total"))
    return attach(labels.select(label).distinct().join(c, label, "left"), total, ()).select(
        label, F.coalesce("_n", F.lit(0)).cast("long").alias("n"),
        F.coalesce(ratio(F.coalesce("_n", F.lit(0)), "_total"), F.lit(0.0)).alias("proportion"),
    )


def grouped_means(df: DataFrame, groups: Mapping[str, Column], metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Means with n over named, possibly overlapping row groups in one scan."""
    flags = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]), lambda g: g.isNotNull()
    )
    return df.withColumn("group", F.explode(flags)).groupBy(*by, "group").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics]
    )


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value)."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value"
    )


def replicate_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean, sample sd, p05 and p95 per metric over replicates, long form."""
    long = melt(df, keys, metrics)
    g = [*keys, "metric"]
    basic = long.groupBy(*g).agg(
        F.count("value").alias("replicates"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    q = exact_quantiles(long, g, "value", {"p05": 0.05, "p95": 0.95})
    return basic.join(q, g, "left")


def seed_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean / sd / min / max / count of each metric; NULL keys form a group."""
    return melt(df, keys, metrics).groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count("value").alias("count"),
    )


def finite_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """median / q25 / q75 over finite values, with target and defined counts."""
    v = df.withColumn("_v", finite(value))
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n_targets"), F.count("_v").alias("n_defined"))
    return attach(n, exact_quantiles(v, by, "_v", {"q25": 0.25, "median": 0.5, "q75": 0.75}), by, "left")


def level_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample sd of several metrics under flat column names."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    return df.groupBy(*by).agg(*aggs)


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str = "weighted_mean") -> DataFrame:
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(ratio(F.sum(w * F.col(value)), F.sum(w)).alias(name))


def value_counts(df: DataFrame, keys: Sequence[str], name: str = "n_voxels") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def marker_means(counts: DataFrame, obs: DataFrame, markers: Sequence, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Label × marker log1p(Σ counts ÷ Σ observations) over all slices, wide."""
    keys = [*by, "obs_id"]
    cells = counts.where(F.col("feature_id").isin(*markers)).join(obs.select(*keys, label), keys)
    sums = cells.groupBy(label).pivot("feature_id", list(markers)).agg(F.sum("value"))
    sizes = obs.groupBy(label).agg(F.count(F.lit(1)).alias("n_obs"))
    out = sizes.join(sums, label, "left")
    return out.select(
        label, "n_obs",
        *[F.log1p(F.coalesce(F.col(f"`{m}`"), F.lit(0)) / F.col("n_obs")).alias(f"marker_{m}") for m in markers],
    )


def select_markers(rows: DataFrame, n_directions: int, n: int, feature: str = "feature_id") -> DataFrame:
    """Features measured in all directions, first by median then minimum Moran's I.

    ``rows`` is (feature, direction, moran, zero_fraction).
    """
    g = rows.groupBy(feature).agg(
        F.countDistinct("direction").alias("n_directions"), F.min("moran").alias("min_moran"),
        F.avg("zero_fraction").alias("mean_zero_fraction"),
    ).where(F.col("n_directions") == n_directions)
    med = exact_quantiles(rows, [feature], "moran", {"median_moran": 0.5})
    return g.join(med, feature).orderBy(
        F.col("median_moran").desc_nulls_last(), F.col("min_moran").desc_nulls_last(), feature
    ).limit(n)


def grid_histogram(
    points: DataFrame, width: float, by: Sequence[str] = (), weight: str | None = None, category: str | None = None
) -> DataFrame:
    """2-D bins with counts, optional weight sums and the leading category."""
    b = points.withColumns({
        "bin_x": F.floor(F.col("x") / width).cast("long"), "bin_y": F.floor(F.col("y") / width).cast("long")
    })
    keys = [*by, "bin_x", "bin_y"]
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(weight).alias("weight")] if weight else [])
    if category is None:
        return b.groupBy(*keys).agg(*aggs)
    per = b.groupBy(*keys, category).agg(*aggs)
    first = F.min(F.struct((-F.col("n")).alias("_n"), F.col(category).alias("_c")))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("n"), *([F.sum("weight").alias("weight")] if weight else []), first.alias("_f")
    )
    return out.select(*[c for c in out.columns if c != "_f"], F.col("_f._c").alias("winner"))


def smooth_grid(grid: DataFrame, sigma: float, radius: int, by: Sequence[str] = (), value: str = "n") -> DataFrame:
    """Gaussian smoothing of a bin grid: each bin sends to (2r+1)² neighbours."""
    steps = [(i, j, 2.718281828459045 ** (-(i * i + j * j) / (2 * sigma * sigma)))
             for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    total = sum(w for *_, w in steps)
    offsets = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w / total).alias("w")) for i, j, w in steps
    ])
    spread = grid.withColumn("_o", F.explode(offsets))
    return spread.groupBy(
        *by, (F.col("bin_x") + F.col("_o.i")).alias("bin_x"), (F.col("bin_y") + F.col("_o.j")).alias("bin_y")
    ).agg(F.sum(F.col(value) * F.col("_o.w")).alias("smoothed"))


def aggregate_to_grid(counts: DataFrame, obs: DataFrame, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Sum the counts of all observations that fall into one square location."""
    keys = [*by, "obs_id"]
    place = obs.select(
        *keys, F.floor(F.col("x") / width).cast("long").alias("bin_x"),
        F.floor(F.col("y") / width).cast("long").alias("bin_y"),
    )
    return counts.join(place, keys).groupBy(*by, "bin_x", "bin_y", "feature_id").agg(F.sum("value").alias("value"))


def grid_members(obs: DataFrame, width: float, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Members and per-label proportions of each square location."""
    keys = [*by, "bin_x", "bin_y"]
    c = obs.groupBy(
        *by, F.floor(F.col("x") / width).cast("long").alias("bin_x"),
        F.floor(F.col("y") / width).cast("long").alias("bin_y"), label,
    ).agg(F.count(F.lit(1)).alias("n_type"))
    w = Window.partitionBy(*keys)
    return c.withColumn("n_members", F.sum("n_type").over(w)).withColumn(
        "proportion", F.col("n_type") / F.col("n_members")
    )


def rollup_types(comp: DataFrame, mapping: DataFrame, fine: str = "type", coarse: str = "class", by: Sequence[str] = ("spot",)) -> DataFrame:
    """Sum fine proportions by coarse class; a fine type with two classes fails."""
    single = mapping.groupBy(fine).agg(
        F.countDistinct(coarse).alias("_k"), F.min(coarse).alias(coarse)
    ).withColumn(
        coarse,
        F.when(F.col("_k") == 1, F.col(coarse)).otherwise(
            F.raise_error(F.concat(F.lit("type maps to several classes: "), F.col(fine).cast("string"))).cast("string")
        ),
    )
    return comp.join(single.select(fine, coarse), fine).groupBy(*by, coarse).agg(F.sum("p").alias("p"))


def tie_fraction(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Share of rows that repeat a score, and share of exact zeros."""
    per = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return per.groupBy(*by).agg(
        (1.0 - F.count(F.lit(1)) / n).alias("tie_fraction"),
        (F.sum(F.when(F.col(score) == 0, F.col("_n")).otherwise(0)) / n).alias("zero_fraction"),
    )


def perturbation_audit(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Compare two gene_stats tables of one panel: global ratios and directions.

    A feature's ratio needs a positive base only: one lost in the candidate has
    ratio 0 and counts.
    """
    j = base.select("feature_id", F.col("mean").alias("_bm"), F.col("variance").alias("_bv"), F.col("zero_fraction").alias("_bz")).join(
        cand.select("feature_id", F.col("mean").alias("_cm"), F.col("variance").alias("_cv"), F.col("zero_fraction").alias("_cz")), "feature_id"
    ).withColumns({
        "_r": F.when(F.col("_bm") > 0, F.col("_cm") / F.col("_bm")), "_v": F.when(F.col("_bv") > 0, F.col("_cv") / F.col("_bv")),
    })
    g = j.agg(
        ratio(F.avg("_cm"), F.avg("_bm")).alias("global_mean_ratio"),
        ratio(F.avg("_cv"), F.avg("_bv")).alias("global_variance_ratio"),
        ratio(F.avg("_cz"), F.avg("_bz")).alias("zero_fraction_ratio"),
        (F.avg("_cz") - F.avg("_bz")).alias("zero_fraction_delta"),
        F.count("_r").alias("n_positive_genes"),
    )
    q = exact_quantiles(j, (), "_r", {"median_gene_ratio": 0.5})
    v = exact_quantiles(j, (), "_v", {"median_variance_ratio": 0.5})
    mean, zeros = F.col("global_mean_ratio"), F.col("zero_fraction_delta")
    return attach(attach(g, q, ()), v, ()).withColumns({
        "mean_increased": mean > 1, "mean_decreased": mean < 1, "sparsity_increased": zeros > 0, "sparsity_decreased": zeros < 0,
        "variance_increased": F.col("median_variance_ratio") > 1,
    })


# The directions a perturbation may be expected to take.
DIRECTIONS = {
    "mean_up": "mean_increased", "mean_down": "mean_decreased", "zeros_up": "sparsity_increased", "zeros_down": "sparsity_decreased",
    "variance_up": "variance_increased",
}


def structural_checks(counts: DataFrame, base_obs: DataFrame, cand_obs: DataFrame, base_features: DataFrame, cand_features: DataFrame, order: str | None = None) -> DataFrame:
    """One row: are the stored counts finite, non-negative and whole, and are the supports those of the base?

    NULL counts are not finite.  ``order`` names a position column that
    must agree too.  Without counts the three checks of values hold.
    """
    v = F.col("value").cast("double")
    real = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    all_of = lambda c: F.coalesce(F.min(F.coalesce(c, F.lit(False)).cast("int")) == 1, F.lit(True))
    values = counts.agg(
        all_of(real).alias("finite"), all_of(real & (v >= 0)).alias("nonnegative"), all_of(real & (v == F.floor(v))).alias("integer_counts")
    )

    def same(base: DataFrame, cand: DataFrame, key: str, name: str) -> DataFrame:
        cols = [key, *([order] if order else [])]
        both = base.select(*cols, F.lit(1).alias("_d")).unionByName(cand.select(*cols, F.lit(-1).alias("_d"))).groupBy(*cols).agg(F.sum("_d").alias("_d"))
        return both.agg((F.count(F.when(F.col("_d") != 0, 1)) == 0).alias(name))

    return attach(attach(values, same(base_obs, cand_obs, "obs_id", "same_observations"), ()), same(base_features, cand_features, "feature_id", "same_features"), ())


def perturbation_check(audit: DataFrame, structure: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The audit with its structural checks, whether all ``expected`` directions hold, and ok or failed.

    A direction that is undefined does not hold.  Unknown directions are refused.
    """
    unknown = sorted(set(expected) - set(DIRECTIONS))
    if unknown:
        raise ValueError(f"unknown directions: {unknown}")
    holds = structural = F.lit(True)
    for d in expected:
        holds &= F.coalesce(F.col(DIRECTIONS[d]), F.lit(False))
    for c in structure.columns:
        structural &= F.col(c)
    return attach(audit, structure, ()).withColumns({
        "expected_directions": F.lit(";".join(expected)), "direction_checks_passed": holds,
        "status": F.when(structural & holds, "ok").otherwise("failed"),
    })


def realised_diagnostics(runs: DataFrame, record: str, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Requested, target and realised figures out of nested run records."""
    return runs.select(*keys, *[F.col(f"{record}.{f}").alias(f) for f in fields])


def level_curve(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("count"),
    )


def group_diagnostics(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlate two label × feature tables label by label.

    Give ``class_means`` over the whole panel: a feature that is in neither
    table does not count.  One absent from a single table is 0 there.
    """
    keys = [*by, "feature_id"]
    cols = ("mean", "variance", "zero_fraction")
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = a.join(b, keys, "full").fillna(0.0, ["a_mean", "b_mean", "a_variance", "b_variance"]).fillna(
        1.0, ["a_zero_fraction", "b_zero_fraction"]
    )
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_features"),
        *[pearson(f"a_{c}", f"b_{c}").alias(f"{c}_pearson") for c in cols],
    )
