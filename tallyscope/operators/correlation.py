"""Correlations with implicit zeros, undefined results as NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, finite, pearson, pearson_from_sums
from tallyscope.functions.ordered import running_totals
from tallyscope.functions.session import spread
from tallyscope.operators.stats import n_obs


def safe_pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), name: str = "pearson") -> DataFrame:
    return df.groupBy(*by).agg(pearson(x, y).alias(name))


def log_corr(df: DataFrame, x: str, y: str, by: Sequence[str] = (), name: str = "log_corr") -> DataFrame:
    """Pearson of log1p where both exceed 1e-10; 0.0 below ten such rows."""
    ok = (F.col(x) > 1e-10) & (F.col(y) > 1e-10)
    lx, ly = F.when(ok, F.log1p(x)), F.when(ok, F.log1p(y))
    r = F.when(F.count_if(ok) >= 10, F.coalesce(pearson(lx, ly), F.lit(0.0))).otherwise(0.0)
    return df.groupBy(*by).agg(r.alias(name))


def paired_cells(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both values of each cell stored on either side, as doubles (absent = 0)."""
    keys = [*by, "obs_id", "feature_id"]
    # one aggregation instead of a full outer join: a single shuffle of both sides
    rows = a.select(*keys, F.col("value").cast("double").alias("a"), F.lit(0.0).alias("b")).unionByName(
        b.select(*keys, F.lit(0.0).alias("a"), F.col("value").cast("double").alias("b"))
    )
    return spread(rows, *keys).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _pair_sums(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.sum("a").alias("sx"), F.sum("b").alias("sy"), F.sum(F.col("a") * F.col("a")).alias("sxx"),
        F.sum(F.col("b") * F.col("b")).alias("syy"), F.sum(F.col("a") * F.col("b")).alias("sxy"),
    )


def column_pearson(a: DataFrame, b: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per feature over the paired observations listed in ``obs``."""
    s = attach(_pair_sums(paired_cells(a, b, by), [*by, "feature_id"]), n_obs(obs, by), by)
    return s.select(*by, "feature_id", pearson_from_sums("n_obs", "sx", "sy", "sxx", "syy", "sxy").alias("pearson"))


def row_pearson(a: DataFrame, b: DataFrame, features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per observation across the panel ``features``."""
    n = features.agg(F.countDistinct("feature_id").alias("n_obs"))
    s = attach(_pair_sums(paired_cells(a, b, by), [*by, "obs_id"]), n, ())
    return s.select(*by, "obs_id", pearson_from_sums("n_obs", "sx", "sy", "sxx", "syy", "sxy").alias("pearson"))


def _zero_block_ranks(counts: DataFrame, n: DataFrame, by: Sequence[str], split_rows: int) -> DataFrame:
    """Average rank of each distinct value per feature, with all absent cells as one zero block."""
    keys = [*by, "feature_id"]
    c = counts.where(F.col("value") != 0).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    t = attach(running_totals(c, keys, "value", ["n"], split_rows), n, by)
    zeros = F.col("n_obs") - F.col("total_n")
    return t.select(
        *keys, "value", F.col("n").alias("tie"), zeros.alias("zeros"), "n_obs",
        (zeros + F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"),
    )


def column_spearman(
    a: DataFrame, b: DataFrame, obs: DataFrame, by: Sequence[str] = (), split_rows: int | None = None
) -> DataFrame:
    """Per feature, average ranks; a value's rank is looked up, zeros share one.

    Ranks are centred by the rank of the zero block, so that absent cells
    contribute nothing to the sums and the table never gets dense.
    """
    keys = [*by, "feature_id"]
    n = n_obs(obs, by)
    shifted = []
    for side in (a, b):
        r = _zero_block_ranks(side, n, by, split_rows)
        # rank of the zero block is (zeros + 1) / 2
        r = r.select(*keys, "value", (F.col("rank") - (F.col("zeros") + 1) / F.lit(2.0)).alias("r"))
        shifted.append(
            side.where(F.col("value") != 0).join(r, [*keys, "value"])
            .select(*by, "obs_id", "feature_id", F.col("r").alias("value"))
        )
    return column_pearson(*shifted, obs, by).withColumnRenamed("pearson", "spearman")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), name: str = "spearman", split_rows: int | None = None) -> DataFrame:
    """Rank correlation of two columns over rows where both are finite."""
    rows = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()
    )
    pairs = rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    for c in ("_x", "_y"):
        values = pairs.groupBy(*by, c).agg(F.sum("_w").alias("n"))
        t = running_totals(values, by, c, ["n"], split_rows)
        ranks = t.select(*by, c, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias(f"{c}r"))
        pairs = pairs.join(ranks, [*by, c])
    # weighted sums over distinct pairs, ranks centred on (n + 1) / 2 for stability
    n = F.sum("_w").alias("n")
    g = pairs.groupBy(*by).agg(
        n, F.sum(F.col("_w") * F.col("_xr")).alias("sx"), F.sum(F.col("_w") * F.col("_yr")).alias("sy"),
        F.sum(F.col("_w") * F.col("_xr") * F.col("_xr")).alias("sxx"),
        F.sum(F.col("_w") * F.col("_yr") * F.col("_yr")).alias("syy"),
        F.sum(F.col("_w") * F.col("_xr") * F.col("_yr")).alias("sxy"),
    )
    return g.select(*by, pearson_from_sums("n", "sx", "sy", "sxx", "syy", "sxy").alias(name))


def profile_metrics(a: DataFrame, b: DataFrame, features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per observation: Pearson of log1p profiles and Jensen–Shannon distance."""
    from tallyscope.operators.distance import jsd_from_cells

    cells = paired_cells(a, b, by)
    logs = cells.withColumns({"a": F.log1p("a"), "b": F.log1p("b")})
    keys = [*by, "obs_id"]
    n = features.agg(F.countDistinct("feature_id").alias("n_obs"))
    r = attach(_pair_sums(logs, keys), n, ()).select(
        *keys, pearson_from_sums("n_obs", "sx", "sy", "sxx", "syy", "sxy").alias("log_pearson")
    )
    totals = cells.groupBy(*keys).agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    shares = cells.join(totals, keys).where((F.col("_ta") > 0) & (F.col("_tb") > 0)).select(
        *keys, (F.col("a") / F.col("_ta")).alias("a"), (F.col("b") / F.col("_tb")).alias("b")
    )
    d = jsd_from_cells(shares, keys).select(*keys, F.sqrt(F.greatest("jsd", F.lit(0.0))).alias("js_distance"))
    return r.join(d, keys, "left")


def pseudobulk_corr(left: DataFrame, right: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Mean over labels of the correlation of per-label feature means.

    Inputs are ``class_means`` tables over the whole panel; a feature absent
    from one of them is 0 there.
    """
    keys = [*by, label, "feature_id"]
    j = left.select(*keys, F.col("mean").alias("_a")).join(
        right.select(*keys, F.col("mean").alias("_b")), keys, "full"
    ).fillna(0.0, ["_a", "_b"])
    per = j.groupBy(*by, label).agg(pearson("_a", "_b").alias("_r"))
    return per.groupBy(*by).agg(F.avg("_r").alias("pseudobulk_corr"), F.count("_r").alias("n_labels"))
