"""Conditional resampling baselines as joins on hash-drawn positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, col
from tallyscope.functions.ordered import positions
from tallyscope.operators.multinomial import multiplicities
from tallyscope.operators.stats import melt

# Fixed values of the arithmetic draw, which other engines can repeat.
DRAW_ID, DRAW_REPLICATE = 2_654_435_761, 40_503


def hashed_draw(ident: str | Column, replicate: str | Column, seed: int, n: str | Column) -> Column:
    """Uniform position in [0, n), a pure function of (id, replicate, seed)."""
    return F.pmod(F.xxhash64(col(ident), col(replicate), F.lit(seed)), col(n))


def arithmetic_draw(ident: str | Column, replicate: str | Column, seed: int, n: str | Column) -> Column:
    return F.pmod(col(ident).cast("long") * DRAW_ID + col(replicate).cast("long") * DRAW_REPLICATE + F.lit(seed), col(n))


def label_index(source: DataFrame, by: Sequence[str], id_col: str = "obs_id") -> DataFrame:
    """Dense 0-based position of every source row inside its label."""
    return positions(source.select(*by, id_col), by, id_col, "idx")


def conditional_donors(
    source: DataFrame, target: DataFrame, replicates: int, seed: int = 0, by: Sequence[str] = (), label: str = "label",
    id_col: str = "obs_id", draw=hashed_draw,
) -> DataFrame:
    """(by…, label, target, replicate, donor): a same-label source row for every target row.

    Drawn with replacement, independent of partitioning; all replicates are one
    job.  A target label without source rows fails.
    """
    keys = [*by, label]
    idx = label_index(source, keys, id_col)
    n = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    t = target.select(*keys, F.col(id_col).alias("target_id")).join(n, keys, "left")
    ok = F.when(F.col("_n").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("target label lacks source support: "), F.col(label).cast("string"))).cast("boolean")
    )
    t = t.where(ok).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    t = t.withColumn("idx", draw("target_id", "replicate", seed, "_n"))
    return t.join(idx.withColumnRenamed(id_col, "donor_id"), [*keys, "idx"]).select(
        *keys, "target_id", "replicate", "donor_id"
    )


def resampled_counts(counts: DataFrame, donors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whole donor rows under their target ids, one table for all replicates."""
    keys = [*by, "donor_id"]
    return counts.withColumnRenamed("obs_id", "donor_id").join(donors.select(*keys, "target_id", "replicate"), keys).select(
        *by, "replicate", F.col("target_id").alias("obs_id"), "feature_id", "value"
    )


def weighted_donors(
    references: DataFrame, weights: DataFrame, fallback: DataFrame, target: DataFrame, replicates: int, seed: int = 0,
    label: str = "label", id_col: str = "obs_id", slice_col: str = "slice_id", uniform=None,
) -> DataFrame:
    """Choose a reference slice by weight among those holding the class, then a uniform row of it.

    ``references`` (slice, label, id) · ``weights`` (target_slice, slice, weight)
    · ``fallback`` (target_slice, label, slice), used when no weighted slice has
    the class · ``target`` (target_slice, label, id).  The weighted slices of one
    target are a handful, so they travel as a cumulative array on the target row.
    """
    sizes = references.groupBy(slice_col, label).agg(F.count(F.lit(1)).alias("_n"))
    primary = weights.join(sizes, slice_col).select("target_slice", label, slice_col, "weight", "_n")
    spare = fallback.join(sizes, [slice_col, label]).join(
        primary.select("target_slice", label).distinct(), ["target_slice", label], "left_anti"
    ).select("target_slice", label, slice_col, F.lit(1.0).alias("weight"), "_n")
    options = primary.unionByName(spare).groupBy("target_slice", label).agg(
        F.array_sort(F.collect_list(F.struct(F.col(slice_col).alias("s"), F.col("weight").alias("w"), F.col("_n").alias("n")))).alias("_o")
    ).withColumn("_total", F.aggregate("_o", F.lit(0.0), lambda a, e: a + e["w"]))
    u = F.pmod(F.xxhash64(F.col(id_col), F.col("replicate"), F.lit(seed), F.lit("slice")), F.lit(1 << 30)) / float(1 << 30)
    t = target.join(options, ["target_slice", label], "left")
    ok = F.when(F.col("_o").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no declared donor for class "), F.col(label).cast("string"))).cast("boolean")
    )
    t = t.where(ok).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    t = t.withColumn("_u", (u if uniform is None else uniform) * F.col("_total"))
    # index of the first option whose cumulative weight exceeds u
    step = F.aggregate(
        "_o", F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i")),
        lambda a, e: F.struct((a["c"] + e["w"]).alias("c"), (a["i"] + F.when(a["c"] + e["w"] <= F.col("_u"), 1).otherwise(0)).alias("i")),
    )["i"]
    t = t.withColumn("_p", F.element_at("_o", F.least(step + 1, F.size("_o")))).withColumns({
        slice_col: F.col("_p.s"), "idx": hashed_draw(id_col, "replicate", seed, F.col("_p.n")),
    })
    idx = label_index(references, [slice_col, label], id_col).withColumnRenamed(id_col, "donor_id")
    return t.join(idx, [slice_col, label, "idx"]).select(
        "target_slice", label, F.col(id_col).alias("target_id"), "replicate", slice_col, "donor_id"
    )


def bootstrap_region_mean(
    counts: DataFrame, source: DataFrame, blueprint: DataFrame, replicates: int, seed: int = 0, by: Sequence[str] = (),
    label: str = "label", draw=None,
) -> DataFrame:
    """Mean of ``n_spots`` donor rows per region, feature and replicate.

    ``blueprint`` is (by…, label, n_spots).  Multiplicities meet the counts, so
    only sufficient sums exist.  They come from binomial splitting, a row per
    donor drawn; with ``draw``, a row per spot is drawn and counted instead.
    """
    keys = [*by, label]
    n = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = blueprint.select(*keys, "n_spots").join(n, keys).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    )
    if draw is None:
        times = multiplicities(d, [*keys, "replicate"], "_n", "n_spots", seed).withColumnRenamed("times", "_m")
        d = times.join(d.select(*keys, "replicate", "n_spots"), [*keys, "replicate"])
    else:
        d = d.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_spots").cast("long") - 1)))
        d = d.withColumn("idx", draw("_d", "replicate", seed, "_n")).groupBy(*keys, "replicate", "idx", "n_spots").agg(
            F.count(F.lit(1)).alias("_m")
        )
    picked = d.join(label_index(source, keys), [*keys, "idx"])
    return counts.join(picked, [*by, "obs_id"]).groupBy(*keys, "replicate", "feature_id", "n_spots").agg(
        F.sum(F.col("value") * F.col("_m")).alias("_s")
    ).select(*keys, "replicate", "feature_id", "n_spots", (F.col("_s") / F.col("n_spots")).alias("mean"))


def sampled_state(region_means: DataFrame, blueprint: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Feature mean of the whole slice: region means weighted by blueprint abundance."""
    total = blueprint.groupBy(*by).agg(F.sum("n_spots").alias("_t"))
    return attach(region_means, total, by).groupBy(*by, "replicate", "feature_id").agg(
        F.sum(F.col("n_spots") / F.col("_t") * F.col("mean")).alias("mean")
    )


def comparison_frame(metrics: DataFrame, summary: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long table: baseline mean / sd / p05 / p95, the method's value and the difference.

    ``summary`` is the long output of ``replicate_summary`` for the baseline.
    """
    m = melt(metrics, keys, names)
    return summary.join(m, [*keys, "metric"]).select(
        *keys, "metric", F.col("mean").alias("baseline_mean"), F.col("sd").alias("baseline_sd"),
        F.col("p05").alias("baseline_p05"), F.col("p95").alias("baseline_p95"), "value",
        (F.col("value") - F.col("mean")).alias("difference"),
    )
