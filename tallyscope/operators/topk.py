"""Top-k, deterministic samples, panels and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach
from tallyscope.functions.ordered import exact_quantiles
from tallyscope.functions.session import checkpointed
from tallyscope.operators.local_fit import local_quadratic
from tallyscope.operators.stats import gene_stats, n_obs


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows per group; Spark prunes each group before the shuffle.

    Without keys it is a global ordered limit.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    # n rows at most reach the one-partition numbering
    return df.orderBy(*order).limit(n).withColumn(
        name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    )


def top_features(stats: DataFrame, m: int, by: Sequence[str] = (), pos: str = "feature_id") -> DataFrame:
    """Top-M features by mean; among equal means the later position comes first."""
    return top_by(stats, by, [F.col("mean").desc(), F.col(pos).desc()], m)


def capped_sample(df: DataFrame, by: Sequence[str], n: int, id_col: str, seed: int = 0) -> DataFrame:
    """At most n rows per group in hash order, the same on any partitioning."""
    return top_by(df, by, [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)], n, "_r").drop("_r")


def capped_sample_arithmetic(df: DataFrame, by: Sequence[str], n: int, id_col: str, a: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """The same with an arithmetic order, which other engines can repeat."""
    key = F.pmod(F.col(id_col).cast("long") * a, F.lit(modulus))
    return top_by(df, by, [key, F.col(id_col)], n, "_r").drop("_r")


def select_terms(results: DataFrame, n: int, by: Sequence[str], method: str = "method", q_cut: float = 0.05) -> DataFrame:
    """Union over methods of each label's n best terms (q asc, NES desc, name asc).

    The rank reported is the best one any method gave.
    """
    good = results.where((F.col("nes") > 0) & (F.col("q") < q_cut))
    picks = top_by(good, [*by, method], [F.col("q"), F.col("nes").desc(), F.col("term")], n)
    return picks.groupBy(*by, "term").agg(F.min("rank").alias("best_rank"), F.countDistinct(method).alias("n_methods"))


def peak_slice(sizes: DataFrame, by: Sequence[str], slice_col: str, count: str) -> DataFrame:
    """The slice with most support per group, ties to the lowest slice."""
    best = F.min(F.struct((-F.col(count)).alias("n"), F.col(slice_col).alias("s")))
    return sizes.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.s").alias(slice_col), (-F.col("_b.n")).alias(count)
    )


def choose_best_case(rows: DataFrame, value: str, setting: str, direction: str, gene: str, cut: float = 0.95) -> DataFrame:
    """Best setting by mean, then its best direction, then the strongest gene at or above its quantile."""
    s = rows.groupBy(setting).agg(F.avg(value).alias("_m")).orderBy(F.col("_m").desc(), setting).limit(1)
    a = rows.join(F.broadcast(s.select(setting)), setting)
    d = a.groupBy(setting, direction).agg(F.avg(value).alias("_m")).orderBy(F.col("_m").desc(), direction).limit(1)
    b = a.join(F.broadcast(d.select(direction)), direction)
    q = exact_quantiles(b, (), value, {"cut": cut})
    return attach(b, q, ()).where(F.col(value) >= F.col("cut")).orderBy(F.col(value), gene).limit(1).select(
        setting, direction, gene, value, "cut"
    )


def panel_order(medians: DataFrame, metric: str = "metric", method: str = "method", value: str = "median", lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Order of the methods per metric: best first by direction, unavailable last."""
    signed = F.when(F.col(metric).isin(*lower_is_better), F.col(value)).otherwise(-F.col(value))
    w = Window.partitionBy(metric).orderBy(signed.asc_nulls_last(), method)
    return medians.withColumn("position", F.row_number().over(w))


def select_panel(counts: DataFrame, obs: DataFrame, n_top: int, span: float = 0.3, features: DataFrame | None = None) -> DataFrame:
    """Highly variable features by variance-stabilised counts.

    The panel is that of ``features``, by default of the features with counts.
    Constant features score 0 and come last, so a panel of at most ``n_top``
    features is returned whole.

    log10 variance is regressed on log10 mean by a local quadratic fit of every
    feature's own; counts are standardised with the fitted deviation and clipped
    at √n; the features with the largest standardised variance win.
    """
    stats = gene_stats(counts, obs).where(F.col("variance") > 0)
    xy = checkpointed(stats.select("feature_id", "mean", F.log10("mean").alias("x"), F.log10("variance").alias("y")))
    fitted = xy.join(local_quadratic(xy, span), "feature_id").select(
        "feature_id", "mean", F.sqrt(F.pow(F.lit(10.0), F.col("fitted"))).alias("_sd")
    )
    n = n_obs(obs)
    z = attach(counts.where(F.col("value") != 0).join(fitted, "feature_id"), n, ())
    cap = F.sqrt(F.col("n_obs").cast("double"))
    zc = F.least((F.col("value") - F.col("mean")) / F.col("_sd"), cap)
    z0 = F.least(-F.col("mean") / F.col("_sd"), cap)
    sums = z.groupBy("feature_id").agg(
        F.sum(zc).alias("_s"), F.sum(zc * zc).alias("_q"), F.count(F.lit(1)).alias("_nz"),
        F.max(z0).alias("_z0"), F.max("n_obs").alias("n_obs"),
    )
    zeros = F.col("n_obs") - F.col("_nz")
    total, square = F.col("_s") + zeros * F.col("_z0"), F.col("_q") + zeros * F.col("_z0") * F.col("_z0")
    scored = sums.select(
        "feature_id", ((square - total * total / F.col("n_obs")) / (F.col("n_obs") - 1)).alias("variance_norm")
    )
    panel = (counts if features is None else features).select("feature_id").distinct()
    whole = panel.join(scored, "feature_id", "left").fillna(0.0, ["variance_norm"])
    return top_by(whole, (), [F.col("variance_norm").desc(), F.col("feature_id")], n_top)


# --- set operations ----------------------------------------------------------

def union_tables(*tables: DataFrame) -> DataFrame:
    """Union by name, missing columns NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def common_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def missing_and_extra(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, named ``missing`` or ``extra``."""
    a, b = df.select(*keys).distinct(), expected.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(
        a.join(b, list(keys), "left_anti").withColumn("side", F.lit("extra"))
    )


def distinct_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of either side and how many both have."""
    rows = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    ).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return rows.agg(
        F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"), F.sum(F.col("_a") * F.col("_b")).alias("n_common")
    )
