"""Alignment scores: rotations, couplings, transferred labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, ratio
from tallyscope.functions.ordered import exact_quantiles, positions
from tallyscope.operators.coupling import marginals
from tallyscope.operators.neighbors import knn
from tallyscope.operators.scores import clustering_scores


def rotate_points(points: DataFrame, degrees: float, fraction: tuple[float, float] = (0.0, 0.0), by: Sequence[str] = ()) -> DataFrame:
    """Rotate about centre + fraction × half extent; error of rotating back."""
    box = points.groupBy(*by).agg(
        ((F.min("x") + F.max("x")) / 2.0 + F.lit(fraction[0]) * (F.max("x") - F.min("x")) / 2.0).alias("_px"),
        ((F.min("y") + F.max("y")) / 2.0 + F.lit(fraction[1]) * (F.max("y") - F.min("y")) / 2.0).alias("_py"),
    )
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    j = attach(points, box, by)
    dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
    j = j.withColumns({"rx": F.col("_px") + c * dx - s * dy, "ry": F.col("_py") + s * dx + c * dy})
    ux, uy = F.col("rx") - F.col("_px"), F.col("ry") - F.col("_py")
    bx, by_ = F.col("_px") + c * ux + s * uy, F.col("_py") - s * ux + c * uy
    return j.withColumn("inverse_error", F.greatest(F.abs(bx - F.col("x")), F.abs(by_ - F.col("y")))).drop("_px", "_py")


def recovered_rotation(pairs: DataFrame, by: Sequence[str] = (), src: Sequence[str] = ("x", "y"), dst: Sequence[str] = ("rx", "ry")) -> DataFrame:
    """Angle of the best proper 2-D rotation from src to dst, closed form."""
    (sx, sy), (dx, dy) = src, dst
    return pairs.groupBy(*by).agg(
        F.degrees(F.atan2(F.covar_pop(sx, dy) - F.covar_pop(sy, dx), F.covar_pop(sx, dx) + F.covar_pop(sy, dy))).alias("rotation_degrees")
    )


def weighted_procrustes(coupling: DataFrame, ref: DataFrame, mov: DataFrame) -> DataFrame:
    """Mass-weighted rigid fit of the moving points onto the reference.

    Returns the moving points with transformed ``tx, ty`` and the angle.
    ``coupling`` is (ref_idx, mov_idx, mass).
    """
    j = coupling.join(ref.select(F.col("obs_id").alias("ref_idx"), F.col("x").alias("rx"), F.col("y").alias("ry")), "ref_idx").join(
        mov.select(F.col("obs_id").alias("mov_idx"), F.col("x").alias("mx"), F.col("y").alias("my")), "mov_idx"
    )
    w = F.col("mass")
    m = F.sum(w)

    def mean(c):
        return F.sum(w * F.col(c)) / m

    def cross(a, b):
        return F.sum(w * F.col(a) * F.col(b)) / m - mean(a) * mean(b)

    fit = j.agg(
        mean("rx").alias("_rx"), mean("ry").alias("_ry"), mean("mx").alias("_mx"), mean("my").alias("_my"),
        F.atan2(cross("mx", "ry") - cross("my", "rx"), cross("mx", "rx") + cross("my", "ry")).alias("_a"),
    )
    return _moved(mov, fit)


def procrustes_of_marginals(summary: DataFrame, mov: DataFrame) -> DataFrame:
    """``weighted_procrustes`` from the moving rows of a coupling summary with coordinates."""
    j = summary.where("side = 'mov'").select(F.col("idx").alias("obs_id"), "total", "sx", "sy").join(mov.select("obs_id", "x", "y"), "obs_id")
    m = F.sum("total")
    mx, my = F.sum(F.col("total") * F.col("x")) / m, F.sum(F.col("total") * F.col("y")) / m
    rx, ry = F.sum("sx") / m, F.sum("sy") / m

    def cross(a, b, ma, mb):
        return F.sum(F.col(a) * F.col(b)) / m - ma * mb

    turn = F.atan2(cross("x", "sy", mx, ry) - cross("y", "sx", my, rx), cross("x", "sx", mx, rx) + cross("y", "sy", my, ry))
    return _moved(mov, j.agg(rx.alias("_rx"), ry.alias("_ry"), mx.alias("_mx"), my.alias("_my"), turn.alias("_a")))


def _moved(mov: DataFrame, fit: DataFrame) -> DataFrame:
    out = attach(mov, fit, ())
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    c, s = F.cos("_a"), F.sin("_a")
    return out.withColumns({
        "tx": F.col("_rx") + c * dx - s * dy, "ty": F.col("_ry") + s * dx + c * dy, "angle_degrees": F.degrees("_a")
    }).drop("_rx", "_ry", "_mx", "_my", "_a")


def angular_error(a, b):
    """|a − b| wrapped to [0, 180] degrees (column expression)."""
    d = F.pmod(a - b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
    return F.abs(d)


def spatial_error(pairs: DataFrame, spacing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean / median / RMSE / max of the distance (x, y)–(tx, ty), also per spacing unit.

    ``spacing`` is (by…, spacing).
    """
    e = pairs.withColumn(
        "_e", F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))
    )
    s = e.groupBy(*by).agg(
        F.avg("_e").alias("mean_error"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_error"), F.max("_e").alias("max_error")
    )
    j = attach(attach(s, exact_quantiles(e, by, "_e", {"median_error": 0.5}), by), spacing, by)
    for c in ("mean", "median", "rmse", "max"):
        j = j.withColumn(f"{c}_error_spacing", ratio(f"{c}_error", "spacing"))
    return j


SUPPORT_TOLERANCE = 1e-12


def _side(summary: DataFrame, side: str, own: str) -> DataFrame:
    return summary.where(F.col("side") == side).select(F.col("idx").alias(own), "total", "choice", "true_mass")


def check_coupling(coupling: DataFrame, negative_tolerance: float = 1e-12) -> DataFrame:
    """Cells of a valid coupling: finite and not materially negative, else the query fails."""
    v = F.col("mass")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < -negative_tolerance)
    ok = F.when(bad, F.raise_error("coupling mass must be finite and non-negative").cast("boolean")).otherwise(True)
    return coupling.where(ok).withColumn("mass", F.greatest("mass", F.lit(0.0)))


def mapped_moving(coupling: DataFrame, truth: DataFrame, tolerance: float = SUPPORT_TOLERANCE) -> DataFrame:
    """(mov_idx, true_ref, active, choice) for all moving observations in ``truth``."""
    return mapped_of_marginals(marginals(check_coupling(coupling), truth), truth, tolerance)


def mapped_of_marginals(summary: DataFrame, truth: DataFrame, tolerance: float = SUPPORT_TOLERANCE) -> DataFrame:
    """``mapped_moving`` from a coupling summary."""
    best = _side(summary, "mov", "mov_idx")
    active = F.coalesce(F.col("total") > tolerance, F.lit(False))
    return truth.select("mov_idx", F.col("ref_idx").alias("true_ref")).join(best, "mov_idx", "left").select(
        "mov_idx", "true_ref", active.alias("active"), F.when(active, F.col("choice")).alias("choice")
    )


def transport_metrics(coupling: DataFrame, truth: DataFrame, ref: DataFrame, tolerance: float = SUPPORT_TOLERANCE) -> DataFrame:
    """Partial-transport scores of a long coupling, abstentions never forced.

    ``truth`` is (mov_idx, ref_idx) for every moving row, ``ref`` (ref_idx) all
    reference rows.
    """
    return transport_of_marginals(marginals(check_coupling(coupling), truth), truth, ref, tolerance)


def transport_of_marginals(summary: DataFrame, truth: DataFrame, ref: DataFrame, tolerance: float = SUPPORT_TOLERANCE) -> DataFrame:
    """``transport_metrics`` from a coupling summary that was made with ``truth``."""
    mov = mapped_of_marginals(summary, truth, tolerance)
    m = mov.agg(
        F.count(F.lit(1)).alias("n_moving"), F.count_if("active").alias("_na"),
        F.count_if(F.col("active") & (F.col("choice") == F.col("true_ref"))).alias("_nc"),
    )
    best = _side(summary, "ref", "ref_idx").where(F.col("total") > tolerance).select("ref_idx", "choice")
    back = mov.where("active").select(F.col("mov_idx").alias("choice"), F.col("choice").alias("_back"))
    owner = truth.select("ref_idx", F.col("mov_idx").alias("_true_mov"))
    active_ref = best.join(owner, "ref_idx", "left").join(back, "choice", "left")
    r = active_ref.agg(
        F.count(F.lit(1)).alias("_ra"), F.count("_true_mov").alias("_ro"),
        F.count_if(F.col("choice") == F.col("_true_mov")).alias("_rx"),
        F.count_if(F.col("_back") == F.col("ref_idx")).alias("_mutual"),
    )
    n_ref = ref.agg(F.count(F.lit(1)).alias("n_reference"))
    mass = _side(summary, "mov", "mov_idx").agg(F.sum("total").alias("total_mass"), F.coalesce(F.sum("true_mass"), F.lit(0.0)).alias("_tm"))
    positive = F.when(F.col("total_mass") > 0, F.lit(True)).otherwise(F.raise_error("coupling without positive mass").cast("boolean"))
    j = attach(attach(attach(m, r, ()), n_ref, ()), mass.where(positive), ())

    def share(a, b):
        return F.coalesce(ratio(a, b), F.lit(0.0))

    def f1(p, q):
        return F.coalesce(ratio(2.0 * F.col(p) * F.col(q), F.col(p) + F.col(q)), F.lit(0.0))

    out = j.select(
        "total_mass", share("_na", "n_moving").alias("moving_coverage"), share("_nc", "n_moving").alias("exact_recovery"),
        share("_nc", "_na").alias("conditional_accuracy"), share("_ra", "n_reference").alias("active_reference_fraction"),
        share("_ro", "_ra").alias("overlap_precision"), share("_ro", "n_moving").alias("overlap_recall"),
        share("_rx", "_ra").alias("pair_precision"), share("_rx", "n_moving").alias("pair_recall"),
        share("_mutual", "_ra").alias("mutual_consistency"), share("_tm", "total_mass").alias("true_mass_fraction"),
    )
    return out.withColumns({"overlap_f1": f1("overlap_precision", "overlap_recall"), "pair_f1": f1("pair_precision", "pair_recall")})


def mapped_label_metrics(mapped: DataFrame, ref_labels: DataFrame, mov_labels: DataFrame, label: str = "label") -> DataFrame:
    """Label recovery with abstentions as misses, accuracy on active rows, ARI on active rows."""
    j = mapped.join(mov_labels.select(F.col("obs_id").alias("mov_idx"), F.col(label).alias("_m")), "mov_idx").join(
        ref_labels.select(F.col("obs_id").alias("choice"), F.col(label).alias("_r")), "choice", "left"
    )
    hit = F.col("active") & (F.col("_m") == F.col("_r"))
    s = j.agg(
        F.count(F.lit(1)).alias("n_moving"), F.count_if("active").alias("n_active"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("label_recovery"),
        F.coalesce(ratio(F.count_if(hit), F.count_if("active")), F.lit(0.0)).alias("conditional_label_accuracy"),
    )
    ari = clustering_scores(j.where("active"), "_m", "_r").select(F.col("ari").alias("active_ari"))
    return attach(s, ari, ())


def ordered_subset(subset: DataFrame, full: DataFrame, id_col: str = "obs_id", pos: str = "pos") -> DataFrame:
    """Are all ids present and their positions strictly increasing with the subset's?

    Strictly increasing means the rank in the subset equals the rank by the
    full position; both ranks come from distributed positions.
    """
    j = subset.select(id_col, F.col(pos).alias("_s")).join(full.select(id_col, F.col(pos).alias("_f")), id_col, "left")
    gaps = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_f").isNull()).alias("n_absent"))
    found = j.where(F.col("_f").isNotNull())
    a = positions(found.select(id_col, "_s"), (), "_s", "_ps")
    b = positions(found.select(id_col, "_f"), (), "_f", "_pf")
    swaps = a.join(b, id_col).agg(F.count_if(F.col("_ps") != F.col("_pf")).alias("n_displaced"))
    return attach(gaps, swaps, ()).withColumn("ordered", (F.col("n_absent") == 0) & (F.col("n_displaced") == 0))


def coupling_audit(coupling: DataFrame, row_limit: float, col_limit: float, expected_mass: float, tol: float = 1e-9) -> DataFrame:
    """Largest excess over the row and column marginals, and the mass against the overlap."""
    return audit_of_marginals(marginals(coupling), row_limit, col_limit, expected_mass, tol)


def audit_of_marginals(summary: DataFrame, row_limit: float, col_limit: float, expected_mass: float, tol: float = 1e-9) -> DataFrame:
    """``coupling_audit`` from a coupling summary."""
    rows = _side(summary, "ref", "ref_idx").agg(F.max(F.col("total") - row_limit).alias("row_excess"))
    moving = _side(summary, "mov", "mov_idx")
    cols = moving.agg(F.max(F.col("total") - col_limit).alias("column_excess"))
    total = moving.agg(F.sum("total").alias("total_mass"))
    j = attach(attach(total, rows, ()), cols, ())
    return j.withColumn(
        "feasible", (F.col("row_excess") <= tol) & (F.col("column_excess") <= tol) & (F.abs(F.col("total_mass") - expected_mass) <= tol)
    )


def spot_spacing(points: DataFrame, by: Sequence[str] = (), dims: Sequence[str] = ("x", "y"), id_col: str = "obs_id") -> DataFrame:
    """Median distance to the nearest other point."""
    d = knn(points, 1, dims, by, id_col, strict=False).withColumn("_d", F.sqrt("d2"))
    return exact_quantiles(d, by, "_d", {"spacing": 0.5})
