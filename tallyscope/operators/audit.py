"""Data contracts: key sets, bounds, recomputation, comparisons of result tables.

Checks return counters or offending rows.  ``require`` turns a check into a
failing query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach
from tallyscope.operators.pairing import merge_1to1
from tallyscope.operators.stats import melt

TOLERANCE = 1e-12


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Pass the rows through, or fail the query at the first that breaks the rule."""
    ok = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(ok)


def key_match(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate, missing and unexpected keys against the declared key set."""
    rows = df.select(*keys, F.lit(1).alias("_h"), F.lit(0).alias("_e")).unionByName(
        expected.select(*keys).distinct().select(*keys, F.lit(0).alias("_h"), F.lit(1).alias("_e"))
    ).groupBy(*keys).agg(F.sum("_h").alias("_h"), F.sum("_e").alias("_e"))
    return rows.agg(
        F.count_if(F.col("_h") > 1).alias("n_duplicate"), F.count_if((F.col("_h") == 0) & (F.col("_e") > 0)).alias("n_missing"),
        F.count_if((F.col("_h") > 0) & (F.col("_e") == 0)).alias("n_unexpected"),
    ).withColumn("exact", (F.col("n_duplicate") + F.col("n_missing") + F.col("n_unexpected")) == 0)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_bounds(df: DataFrame, keys: Sequence[str], rules: Mapping[str, tuple[float | None, float | None]], tol: float = 1e-9) -> DataFrame:
    """Per metric: defined values, and values outside [low, high] by more than ``tol``."""
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for metric, (lo, hi) in rules.items():
        here = F.col("metric") == metric
        low = F.when(here, F.lit(lo).cast("double")).otherwise(low)
        high = F.when(here, F.lit(hi).cast("double")).otherwise(high)
    long = melt(df, keys, list(rules))
    out = F.coalesce(F.col("value") < low - tol, F.lit(False)) | F.coalesce(F.col("value") > high + tol, F.lit(False))
    return long.groupBy("metric").agg(F.count("value").alias("n_defined"), F.count_if(out).alias("n_out_of_bounds"))


def check_rank_in_support(df: DataFrame, rank: str, support: str, by: Sequence[str] = (), tol: float = 1e-9) -> DataFrame:
    """Ranks that are defined, and those below 1 or beyond their support; a rank without support is beyond it."""
    r, n = F.col(rank).cast("double"), F.coalesce(F.col(support).cast("double"), F.lit(0.0))
    out = r.isNotNull() & (F.isnan(r) | (r < 1 - tol) | (r > n + tol))
    return df.groupBy(*by).agg(F.count(r).alias("n_defined"), F.count_if(out).alias("n_outside_support"))


def check_availability(df: DataFrame, support: str, metrics: Sequence[str]) -> DataFrame:
    """A metric is defined exactly where its support is positive."""
    long = melt(df, [support], metrics)
    has = F.coalesce(F.col(support) > 0, F.lit(False))
    return long.groupBy("metric").agg(
        F.count_if(has & F.col("value").isNull()).alias("n_missing_value"),
        F.count_if(~has & F.col("value").isNotNull()).alias("n_unsupported_value"),
    ).withColumn("consistent", (F.col("n_missing_value") + F.col("n_unsupported_value")) == 0)


def check_recompute(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], metrics: Sequence[str], rtol: float = 1e-12, atol: float = 1e-13) -> DataFrame:
    """Cells where the stored table differs from an independent recomputation."""
    a = melt(stored, keys, metrics).withColumnRenamed("value", "stored")
    b = melt(recomputed, keys, metrics).withColumnRenamed("value", "recomputed")
    j = a.join(b, [*keys, "metric"], "full")
    same = F.col("stored").eqNullSafe(F.col("recomputed")) | (
        F.abs(F.col("stored") - F.col("recomputed")) <= atol + rtol * F.abs("recomputed")
    )
    return j.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different")
    )


def direction(old: Column, new: Column, tol: float = TOLERANCE) -> Column:
    d = new - old
    return (
        F.when(old.isNull() & new.isNull(), "not_applicable").when(old.isNull(), "newly_available").when(new.isNull(), "no_longer_available")
        .when(F.abs(d) <= tol, "unchanged_within_1e-12").when(d > 0, "increased").otherwise("decreased")
    )


def old_vs_new(old: DataFrame, new: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Delta, direction and availability change for every key and metric (one-to-one)."""
    a = melt(old, keys, metrics).withColumnRenamed("value", "old")
    b = melt(new, keys, metrics).withColumnRenamed("value", "new")
    j = merge_1to1(a, b, [*keys, "metric"])
    return j.withColumns({
        "delta": F.col("new") - F.col("old"), "direction": direction(F.col("old"), F.col("new")),
        "availability_changed": F.col("old").isNull() != F.col("new").isNull(),
    })


def scope_delta(old_scope_old_method: DataFrame, new_scope_old_method: DataFrame, new_scope_new_method: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Split a change into the panel's part and the method's part."""
    j = (
        old_scope_old_method.select(*keys, F.col(value).alias("old")).join(
            new_scope_old_method.select(*keys, F.col(value).alias("rescoped")), list(keys)
        ).join(new_scope_new_method.select(*keys, F.col(value).alias("new")), list(keys))
    )
    return j.withColumns({
        "panel_effect": F.col("rescoped") - F.col("old"), "method_effect": F.col("new") - F.col("rescoped"),
        "total_change": F.col("new") - F.col("old"),
    })


def row_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per field that differs, NULL compared as a value."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field", name)

    j = long(old, "old").join(long(new, "new"), [*keys, "field"])
    return j.where(~F.col("old").eqNullSafe(F.col("new")))


def unchanged(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows gained and lost in the columns that a repair must not touch."""
    a, b = old.select(*columns), new.select(*columns)
    gained = b.exceptAll(a).agg(F.count(F.lit(1)).alias("n_gained"))
    lost = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n_lost"))
    return attach(gained, lost, ()).withColumn("unchanged", (F.col("n_gained") + F.col("n_lost")) == 0)


def baseline_gaps(df: DataFrame, by: Sequence[str], kind: str, simulated: str, real: str, metrics: Sequence[str]) -> DataFrame:
    """Simulated minus real mean per group and metric, with the largest absolute gap."""
    long = melt(df, [*by, kind], metrics)
    g = long.groupBy(*by, "metric").agg(
        F.avg(F.when(F.col(kind) == simulated, F.col("value"))).alias("_s"), F.avg(F.when(F.col(kind) == real, F.col("value"))).alias("_r")
    ).withColumn("gap", F.col("_s") - F.col("_r")).drop("_s", "_r")
    top = g.groupBy("metric").agg(F.max(F.abs("gap")).alias("max_abs_gap"))
    return g.join(top, "metric")


def decision(old: DataFrame, new: DataFrame, keys: Sequence[str], metrics: Sequence[str], lower_is_better: Sequence[str] = (), tol: float = TOLERANCE) -> DataFrame:
    """Per key: sorted lists of improved, worsened and unchanged metrics (a declared few)."""
    j = old_vs_new(old, new, keys, metrics)
    d = F.when(F.col("metric").isin(*lower_is_better), -F.col("delta")).otherwise(F.col("delta"))

    def names(cond: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(cond, F.col("metric")))))

    return j.groupBy(*keys).agg(
        names(d > tol).alias("improved"), names(d < -tol).alias("worsened"), names(F.abs(d) <= tol).alias("unchanged")
    )


def rank_equality(old: DataFrame, new: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """Do two rank tables order every key the same way?"""
    j = old.select(*keys, F.col(rank).alias("_o")).join(new.select(*keys, F.col(rank).alias("_n")), list(keys), "full")
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_o").eqNullSafe(F.col("_n"))).alias("n_changed")
    ).withColumn("ranks_equal", F.col("n_changed") == 0)


def check_stacks(slices: DataFrame, arm: str, stack: str, z: str, kind: str, slice_id: str) -> DataFrame:
    """Is the geometry of a stack identical in all arms, with real and simulated slices in each?

    Geometry is an order-free digest of (slice, z), so no list is collected.
    """
    per = slices.groupBy(stack, arm).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64(slice_id, z).cast("decimal(38,0)")).alias("_h"),
        F.countDistinct(kind).alias("_k"),
    )
    return per.groupBy(stack).agg(
        F.count(F.lit(1)).alias("n_arms"), (F.countDistinct("_n", "_h") == 1).alias("identical_geometry"),
        (F.min("_k") >= 2).alias("both_kinds_present"),
    )


def check_solver_records(records: DataFrame, labels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Per job: offending records and labels that do not occur exactly once.

    ``records`` (keys…, label, converged, final_error, iterations,
    max_iterations, stop_threshold, mass) · ``labels`` (keys…, label).
    """
    good = (
        F.col("converged") & (F.col("final_error") < F.col("stop_threshold")) & F.col("iterations").between(1, F.col("max_iterations"))
        & (F.col("mass") > 0)
    )
    g = [*keys, label]
    per = records.groupBy(*g).agg(F.count(F.lit(1)).alias("_c"), F.count_if(~F.coalesce(good, F.lit(False))).alias("_bad"))
    j = labels.select(*g).distinct().withColumn("_want", F.lit(1)).join(per, g, "full")
    return j.groupBy(*keys).agg(
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_bad_records"),
        F.count_if(~F.coalesce((F.col("_c") == 1) & (F.col("_want") == 1), F.lit(False))).alias("n_label_faults"),
    ).withColumn("passed", (F.col("n_bad_records") + F.col("n_label_faults")) == 0)


def digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free content digest: row count and the sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def sensitivity_delta(df: DataFrame, variant: str, primary, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Variant rows next to the primary row of the same key, delta per metric."""
    long = melt(df, [*keys, variant], metrics)
    base = long.where(F.col(variant) == F.lit(primary)).select(*keys, "metric", F.col("value").alias("primary_value"))
    return long.where(F.col(variant) != F.lit(primary)).join(base, [*keys, "metric"]).withColumn(
        "delta", F.col("value") - F.col("primary_value")
    )


def relation(df: DataFrame, keys: Sequence[str], method: str, first, second, value: str, lower_is_better: bool, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """Which of two methods is better, close values being a tie."""
    p = df.groupBy(*keys).agg(
        F.max(F.when(F.col(method) == F.lit(first), F.col(value))).alias("first_value"),
        F.max(F.when(F.col(method) == F.lit(second), F.col(value))).alias("second_value"),
    )
    a, b = F.col("first_value"), F.col("second_value")
    better = a < b if lower_is_better else a > b
    return p.withColumn(
        "relation", F.when(F.abs(a - b) <= atol + rtol * F.abs(b), "tie").when(better, "first_better").otherwise("second_better")
    )


def reversals(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose relation turned from one method to the other."""
    j = old.select(*keys, F.col("relation").alias("old_relation")).join(new.select(*keys, F.col("relation").alias("new_relation")), list(keys))
    tie = (F.col("old_relation") == "tie") | (F.col("new_relation") == "tie")
    return j.withColumn("reversed", ~tie & (F.col("old_relation") != F.col("new_relation")))


def assert_no_columns(df: DataFrame, prohibited: Sequence[str]) -> DataFrame:
    """Refuse a table that carries a prohibited column name (case-insensitive part)."""
    bad = [c for c in df.columns if any(p.lower() in c.lower() for p in prohibited)]
    if bad:
        raise ValueError(f"prohibited columns: {bad}")
    return df
