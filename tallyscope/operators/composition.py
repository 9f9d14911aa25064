"""Composition tables: residual class, scores, mixed regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, pearson_from_sums, plogp
from tallyscope.functions.ordered import exact_quantiles
from tallyscope.operators.distance import jsd, rmse


def with_other(comp: DataFrame, types: DataFrame, by: Sequence[str] = ("spot",)) -> DataFrame:
    """Restrict to the listed types, add ``__other__`` = clip(1 − Σ, 0), renormalise.

    Negative shares count as 0.  A row without any mass fails.
    """
    kept = comp.join(types.select("type").distinct(), "type", "left_semi").select(*by, "type", F.greatest("p", F.lit(0.0)).alias("p"))
    sums = comp.select(*by).distinct().join(kept.groupBy(*by).agg(F.sum("p").alias("_s")), list(by), "left").fillna(0.0, ["_s"])
    rest = F.greatest(1.0 - F.col("_s"), F.lit(0.0))
    total = F.col("_s") + rest
    ok = F.when(total > 0, F.lit(True)).otherwise(F.raise_error("composition row without mass").cast("boolean"))
    sums = sums.where(ok).select(*by, rest.alias("_rest"), total.alias("_total"))
    rows = kept.join(sums, list(by)).select(*by, "type", (F.col("p") / F.col("_total")).alias("p"))
    other = sums.select(*by, F.lit("__other__").alias("type"), (F.col("_rest") / F.col("_total")).alias("p"))
    return rows.unionByName(other)


def composition_scores(truth: DataFrame, pred: DataFrame, n_spots: DataFrame, n_types: DataFrame) -> DataFrame:
    """JSD mean and median, Pearson per type mean and median, RMSE over all cells.

    ``n_spots`` is one row (n_spots), ``n_types`` one row (n_types); a spot ×
    type cell stored on neither side is zero on both.
    """
    d = jsd(truth, pred)
    js = attach(d.agg(F.avg("jsd").alias("jsd_mean")), exact_quantiles(d, (), "jsd", {"jsd_median": 0.5}), ())
    cells = truth.select("spot", "type", F.col("p").alias("a"), F.lit(0.0).alias("b")).unionByName(
        pred.select("spot", "type", F.lit(0.0).alias("a"), F.col("p").alias("b"))
    ).groupBy("spot", "type").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = attach(cells.groupBy("type").agg(
        F.sum("a").alias("sx"), F.sum("b").alias("sy"), F.sum(F.col("a") * F.col("a")).alias("sxx"),
        F.sum(F.col("b") * F.col("b")).alias("syy"), F.sum(F.col("a") * F.col("b")).alias("sxy"),
    ), n_spots, ()).select("type", pearson_from_sums("n_spots", "sx", "sy", "sxx", "syy", "sxy").alias("r"))
    r = attach(s.agg(F.avg("r").alias("pearson_mean"), F.count("r").alias("n_defined_types")),
               exact_quantiles(s, (), "r", {"pearson_median": 0.5}), ())
    total = attach(n_spots, n_types, ()).select((F.col("n_spots") * F.col("n_types")).alias("total"))
    e = rmse(truth, pred, ["spot", "type"], total).select("rmse")
    return attach(attach(js, r, ()), e, ())


def direction_details(means: DataFrame, a, b, metric: str = "metric", method: str = "method", value: str = "value", lower_is_better: Sequence[str] = (), tol: float = 1e-12) -> DataFrame:
    """Which of two methods is better per metric; differences within ``tol`` are ties."""
    p = means.groupBy(metric).agg(
        F.max(F.when(F.col(method) == F.lit(a), F.col(value))).alias("a"), F.max(F.when(F.col(method) == F.lit(b), F.col(value))).alias("b")
    )
    d = F.col("a") - F.col("b")
    signed = F.when(F.col(metric).isin(*lower_is_better), -d).otherwise(d)
    return p.select(
        metric, "a", "b", d.alias("difference"),
        F.when(d.isNull() | (F.abs(d) <= tol), "tie_or_indeterminate").when(signed > 0, F.lit("first_better")).otherwise("second_better").alias("direction"),
    )


def select_roi(points: DataFrame, label: str, width: float, steps: int = 19, minimum: int = 25) -> DataFrame:
    """Window of a steps × steps sliding grid with the largest entropy × log1p(n).

    A point finds the window indices that cover it by arithmetic, so windows
    and points meet without a range join.
    """
    box = points.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    j = attach(points.select("x", "y", F.col(label).alias("_l")), box, ())

    def windows(v, lo, hi):
        step = F.greatest((F.col(hi) - F.lit(width) - F.col(lo)) / (steps - 1), F.lit(1e-12))
        first = F.greatest(F.ceil((F.col(v) - F.lit(width) - F.col(lo)) / step), F.lit(0))
        last = F.least(F.floor((F.col(v) - F.col(lo)) / step), F.lit(steps - 1))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), step

    wx, sx = windows("x", "_x0", "_x1")
    wy, sy = windows("y", "_y0", "_y1")
    hits = j.withColumns({"i": F.explode(wx)}).withColumn("j", F.explode(wy)).select(
        "i", "j", "_l", (F.col("_x0") + F.col("i") * sx).alias("x0"), (F.col("_y0") + F.col("j") * sy).alias("y0")
    )
    per = hits.groupBy("i", "j", "_l").agg(F.count(F.lit(1)).alias("n"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    w = Window.partitionBy("i", "j")
    per = per.withColumn("_t", F.sum("n").over(w))
    s = per.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"),
        (-F.sum(plogp(F.col("n") / F.col("_t"), False))).alias("entropy"),
    ).where(F.col("n") >= minimum)
    return s.withColumn("score", F.col("entropy") * F.log1p(F.col("n"))).orderBy(
        F.round("score", 9).desc(), "i", "j"
    ).limit(1)
