"""Pairing, validated merges, ordered-axis joins and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach
from tallyscope.functions.ordered import exact_quantiles, running_totals


def pair_by_id(ref: DataFrame, sim: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose identifier occurs on both sides."""
    keys = [*by, "obs_id"]
    return ref.select(*keys).join(sim.select(*keys), keys)


def pair_fractions(ref: DataFrame, sim: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "obs_id"]
    rows = ref.select(*keys, F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(
        sim.select(*keys, F.lit(0).alias("r"), F.lit(1).alias("s"))
    ).groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    common = F.sum(F.when((F.col("r") > 0) & (F.col("s") > 0), 1).otherwise(0))
    return rows.groupBy(*by).agg(
        common.alias("n_paired"), (common / F.sum("r")).alias("fraction_reference"),
        (common / F.sum("s")).alias("fraction_simulated"),
    )


def _rounded(obs: DataFrame, dims: Sequence[str], decimals: int) -> list[Column]:
    return [(F.bround(F.col(d).cast("double"), decimals) + F.lit(0.0)).alias(f"_r{i}") for i, d in enumerate(dims)]


def pairing_diagnostics(
    ref: DataFrame, sim: DataFrame, by: Sequence[str] = (), dims: Sequence[str] = ("x", "y"), decimals: int = 8
) -> DataFrame:
    """One row per group saying how (and whether) observations can be paired.

    Identifiers win whenever any overlap; otherwise a complete, unique
    coordinate match is required.  Failures carry a reason code.
    """
    keys = [*by, "obs_id"]
    r, s = F.lit(1).alias("r"), F.lit(1).alias("s")
    none_r, none_s = F.lit(0).alias("r"), F.lit(0).alias("s")
    ids = ref.select(*keys, r, none_s).unionByName(sim.select(*keys, none_r, s)).groupBy(*keys).agg(
        F.sum("r").alias("r"), F.sum("s").alias("s")
    ).groupBy(*by).agg(
        F.sum("r").alias("n_reference"), F.sum("s").alias("n_simulated"),
        F.coalesce(F.max(F.greatest("r", "s")) > 1, F.lit(False)).alias("_dup_id"),
        F.sum(F.when((F.col("r") > 0) & (F.col("s") > 0), 1).otherwise(0)).alias("_common"),
    )
    bad = F.lit(False)
    for d in dims:
        v = F.col(d).cast("double")
        bad |= v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rounded = [f"_r{i}" for i in range(len(dims))]

    def places(df: DataFrame, here: str, there: str) -> list[Column]:
        exact = [F.col(d).cast("double") for d in dims]
        return [c.alias(f"_{here}{i}") for i, c in enumerate(exact)] + [F.lit(None).cast("double").alias(f"_{there}{i}") for i in range(len(dims))]

    at = ref.select(*by, *_rounded(ref, dims, decimals), bad.cast("int").alias("_bad"), r, none_s, *places(ref, "a", "b")).unionByName(
        sim.select(*by, *_rounded(sim, dims, decimals), bad.cast("int").alias("_bad"), none_r, s, *places(sim, "b", "a"))
    ).groupBy(*by, *rounded).agg(
        F.sum("r").alias("r"), F.sum("s").alias("s"), F.max("_bad").alias("_bad"),
        # in a bijection a place has one row of either side, so a maximum is that row's coordinate
        F.array_max(F.array(*[F.abs(F.max(f"_a{i}") - F.max(f"_b{i}")) for i in range(len(dims))])).alias("_delta"),
    )
    coords = at.groupBy(*by).agg(
        F.max("_bad").alias("_bad"), F.max("_delta").alias("_delta"),
        F.sum(F.when((F.col("r") > 0) & (F.col("s") > 0), 1).otherwise(0)).alias("n_coordinate_overlap"),
        F.sum(F.when(F.col("r") > 1, F.col("r")).otherwise(0)).alias("n_reference_duplicate_rows"),
        F.sum(F.when(F.col("s") > 1, F.col("s")).otherwise(0)).alias("n_simulated_duplicate_rows"),
    )
    j = attach(ids, coords, by)
    dup = (F.col("n_reference_duplicate_rows") > 0) | (F.col("n_simulated_duplicate_rows") > 0)
    whole = (F.col("n_coordinate_overlap") == F.col("n_reference")) & (F.col("n_coordinate_overlap") == F.col("n_simulated"))
    # The reason codes of the pairing contract.
    issue = (
        F.when(F.col("_dup_id"), "nonunique_observation_identifier")
        .when(F.col("_common") > 0, "")
        .when(F.col("_bad") > 0, "nonfinite_spatial_coordinates")
        .when(dup, "nonunique_spatial_coordinates")
        .when(~whole, "incomplete_spatial_coordinate_bijection").otherwise("")
    )
    method = F.when(issue != "", "unavailable").when(F.col("_common") > 0, "exact_identifier").otherwise("unique_spatial_coordinate")
    n = F.when(method == "exact_identifier", F.col("_common")).when(method == "unique_spatial_coordinate", F.col("n_reference")).otherwise(0)
    seen = method.isin("unique_spatial_coordinate") | issue.isin(
        "nonunique_spatial_coordinates", "incomplete_spatial_coordinate_bijection"
    )
    near = F.when(seen, F.col("n_coordinate_overlap"))
    shared = F.when(method == "exact_identifier", F.col("_common")).when(seen, F.col("n_coordinate_overlap")).otherwise(0)
    return j.select(
        *by, "n_reference", "n_simulated", method.alias("spot_pairing"), issue.alias("pairing_issue"),
        n.cast("long").alias("n_paired"), near.alias("n_coordinate_overlap"),
        F.when(seen, F.col("n_reference_duplicate_rows")).alias("n_reference_duplicate_rows"),
        F.when(seen, F.col("n_simulated_duplicate_rows")).alias("n_simulated_duplicate_rows"),
        (shared / F.col("n_reference")).alias("pairing_fraction_reference"),
        (shared / F.col("n_simulated")).alias("pairing_fraction_simulated"),
        F.when(method == "unique_spatial_coordinate", F.col("_delta")).alias("coordinate_max_abs_delta"),
    )


def pair_observations(
    ref: DataFrame, sim: DataFrame, by: Sequence[str] = (), dims: Sequence[str] = ("x", "y"), decimals: int = 8,
    diagnostics: DataFrame | None = None,
) -> DataFrame:
    """(by…, ref_id, sim_id) pairs under the rule of ``pairing_diagnostics``."""
    d = pairing_diagnostics(ref, sim, by, dims, decimals) if diagnostics is None else diagnostics
    d = d.select(*by, "spot_pairing")
    keys = [*by, "obs_id"]
    by_id = attach(ref.select(*keys).join(sim.select(*keys), keys), d, by).where(F.col("spot_pairing") == "exact_identifier")
    rounded = [f"_r{i}" for i in range(len(dims))]

    def side(df: DataFrame, name: str) -> DataFrame:
        # unique coordinates are part of the rule, so groups without them drop out before the join
        kept = attach(df, d, by).where(F.col("spot_pairing") == "unique_spatial_coordinate")
        return kept.select(*by, *_rounded(df, dims, decimals), F.col("obs_id").alias(name))

    by_xy = side(ref, "ref_id").join(side(sim, "sim_id"), [*by, *rounded])
    return by_id.select(*by, F.col("obs_id").alias("ref_id"), F.col("obs_id").alias("sim_id")).unionByName(
        by_xy.select(*by, "ref_id", "sim_id")
    )


def common_features(ref: DataFrame, sim: DataFrame) -> DataFrame:
    """Reference features that the other side has too; ``pos`` is kept."""
    return ref.join(sim.select("feature_id").distinct(), "feature_id", "left_semi")


def intersect_panel(features: DataFrame, dataset: str = "dataset", expected: int | None = None) -> DataFrame:
    """Features of every dataset; with ``expected`` another size fails."""
    k = features.agg(F.countDistinct(dataset).alias("_k"))
    per = features.groupBy("feature_id").agg(F.countDistinct(dataset).alias("_n"))
    panel = attach(per, k, ()).where(F.col("_n") == F.col("_k")).select("feature_id")
    if expected is None:
        return panel
    size = panel.agg(F.count(F.lit(1)).alias("_s"))
    ok = F.when(F.col("_s") == expected, F.lit(True)).otherwise(F.raise_error("panel size differs").cast("boolean"))
    return attach(panel, size, ()).where(ok).select("feature_id")


def attach_metadata(obs: DataFrame, meta: DataFrame, key: str, required: str) -> DataFrame:
    """Left join; ``has_metadata`` says whether the row was found."""
    return obs.join(meta.withColumn("_found", F.lit(True)), key, "left").withColumn(
        "has_metadata", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def metadata_audit(obs: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Rows without metadata (an error) and extra metadata ids (ignored)."""
    a, b = obs.select(key).distinct(), meta.select(key).distinct()
    missing = a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    extra = b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("n_extra"))
    return attach(missing, extra, ()).withColumn("complete", F.col("n_missing") == 0)


def _unique_or_fail(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Fail at run time if a key repeats: rows are folded, never silently dropped."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.struct(*rest)).alias("_row")] if rest else [])
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"{side} key repeats: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
    )
    return agg.where(ok).select(*keys, *([f"_row.{c}" for c in rest]))


def merge_1to1(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner merge whose keys must be unique on both sides."""
    shared = (set(a.columns) & set(b.columns)) - set(keys)
    a, b = _unique_or_fail(a, keys, "left"), _unique_or_fail(b, keys, "right")
    for c in sorted(shared):
        a, b = a.withColumnRenamed(c, c + suffixes[0]), b.withColumnRenamed(c, c + suffixes[1])
    return a.join(b, list(keys))


def merge_mto1(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left merge whose right keys must be unique."""
    return a.join(_unique_or_fail(b, keys, "right"), list(keys), "left")


def merge_indicator(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge with ``both`` / ``left_only`` / ``right_only``."""
    j = a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), list(keys), "full")
    return j.withColumn(
        "merge", F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    ).drop("_l", "_r")


def layered_compare(historical: DataFrame, prior: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str, tol: float = 1e-12) -> DataFrame:
    """Three layers of one metric with their three deltas and changed flags."""
    j = (
        historical.select(*keys, F.col(value).alias("historical"))
        .join(prior.select(*keys, F.col(value).alias("prior")), list(keys))
        .join(fresh.select(*keys, F.col(value).alias("fresh")), list(keys))
    )
    deltas = {"prior_minus_historical": ("prior", "historical"), "fresh_minus_prior": ("fresh", "prior"),
              "fresh_minus_historical": ("fresh", "historical")}
    for name, (x, y) in deltas.items():
        j = j.withColumn(name, F.col(x) - F.col(y)).withColumn(f"{name}_changed", F.abs(F.col(x) - F.col(y)) > tol)
    return j


def _levels(targets: DataFrame, refs: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    """Distinct z levels of both sides with the running number of reference levels."""
    rows = targets.select(*by, F.col(z).cast("double").alias("z"), F.lit(0).alias("r")).unionByName(
        refs.select(*by, F.col(z).cast("double").alias("z"), F.lit(1).alias("r"))
    ).groupBy(*by, "z").agg(F.max("r").alias("r"))
    return running_totals(rows, by, "z", ["r"]).select(*by, "z", "r", F.col("cum_r").alias("i"))


def bracket(targets: DataFrame, refs: DataFrame, z: str = "z", by: Sequence[str] = (), id_col: str = "slice_id") -> DataFrame:
    """Nearest reference strictly below and above each target, and τ between them.

    Levels are numbered by a running count; below and above are then equi-joins
    on the number.  Equal levels resolve to the largest id below, smallest above.
    """
    lev = _levels(targets, refs, by, z)
    ids = refs.groupBy(*by, F.col(z).cast("double").alias("z")).agg(F.max(id_col).alias("hi"), F.min(id_col).alias("lo"))
    numbered = lev.where(F.col("r") == 1).join(ids, [*by, "z"])
    below = numbered.select(*by, F.col("i").alias("_below"), F.col("z").alias("z0"), F.col("hi").alias("lower_id"))
    above = numbered.select(*by, F.col("i").alias("_above"), F.col("z").alias("z1"), F.col("lo").alias("upper_id"))
    t = targets.select(*by, id_col, F.col(z).cast("double").alias("z")).join(lev, [*by, "z"]).withColumns({
        "_below": F.col("i") - F.col("r"), "_above": F.col("i") + 1
    })
    j = t.join(below, [*by, "_below"], "left").join(above, [*by, "_above"], "left")
    return j.select(
        *by, id_col, "z", "lower_id", "upper_id", "z0", "z1", ((F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0"))).alias("tau")
    )


def choose_donor(targets: DataFrame, donors: DataFrame, z: str = "z", label: str = "label", id_col: str = "slice_id", tol: float = 1e-12) -> DataFrame:
    """Per target the donor of the same label nearest along z, another id, ties to the smallest id.

    Only the levels at, just below and just above the target can win, so three
    equi-joins replace a target × donor comparison.
    """
    by = [label]
    lev = _levels(targets, donors, by, z)
    # two ids per level suffice: the smallest, and the next one if the target is the smallest
    first = F.row_number().over(Window.partitionBy(*by, "z").orderBy(id_col))
    two = donors.select(*by, F.col(z).cast("double").alias("z"), id_col).withColumn("_rn", first).where(F.col("_rn") <= 2)
    per = two.groupBy(*by, "z").agg(F.collect_list(id_col).alias("_ids"))
    numbered = lev.where(F.col("r") == 1).join(per, [*by, "z"]).select(*by, F.col("i").alias("_i"), F.col("z").alias("_dz"), "_ids")
    t = targets.select(*by, id_col, F.col(z).cast("double").alias("z")).join(lev, [*by, "z"])
    tries = t.withColumn("_i", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)))
    cand = tries.join(numbered, [*by, "_i"]).withColumn("_d", F.explode("_ids")).where(F.col("_d") != F.col(id_col)).select(
        *by, id_col, "z", F.abs(F.col("_dz") - F.col("z")).alias("_g"), "_d"
    )
    # at most six candidates per target
    low = Window.partitionBy(*by, id_col)
    near = cand.withColumn("_min", F.min("_g").over(low)).where(F.col("_g") <= F.col("_min") + tol)
    return near.groupBy(*by, id_col, "z").agg(F.min("_d").alias("donor_id"), F.min("_min").alias("distance"))


def z_weights(targets: DataFrame, refs: DataFrame, n: int, z: str = "z", by: Sequence[str] = (), id_col: str = "slice_id") -> DataFrame:
    """n nearest references along z, the bracket included, with weights e^(−|dz|/h) summing to 1.

    h is the median spacing of neighbouring references.
    """
    lev = _levels(targets, refs, by, z)
    numbered = lev.where(F.col("r") == 1).select(*by, F.col("i").alias("_i"), F.col("z").alias("ref_z"))
    ref_lev = refs.select(*by, F.col(z).cast("double").alias("z")).distinct()
    gaps = running_totals(ref_lev.withColumn("_one", F.lit(1)), by, "z", ["_one"]).select(
        *by, (F.col("next_z") - F.col("z")).alias("_gap")
    )
    h = exact_quantiles(gaps, by, "_gap", {"_h": 0.5})
    t = targets.select(*by, id_col, F.col(z).cast("double").alias("z")).join(lev, [*by, "z"])
    reach = t.withColumn("_i", F.explode(F.sequence(F.col("i") - F.col("r") - (n - 1), F.col("i") + n)))
    c = reach.join(numbered, [*by, "_i"]).where(F.col("ref_z") != F.col("z")).withColumns({
        "_g": F.abs(F.col("ref_z") - F.col("z")),
        "_in": F.when((F.col("_i") == F.col("i") - F.col("r")) | (F.col("_i") == F.col("i") + 1), 0).otherwise(1),
    })
    # 2n candidates per target at most
    w = Window.partitionBy(*by, id_col).orderBy("_in", "_g", "ref_z")
    top = attach(c.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n), h, by)
    raw = top.withColumn("_w", F.exp(-F.col("_g") / F.col("_h")))
    return raw.select(
        *by, id_col, "z", "ref_z", (F.col("_w") / F.sum("_w").over(Window.partitionBy(*by, id_col))).alias("weight")
    )


def transfer_labels(obs: DataFrame, source: DataFrame, labels: Mapping[str, int], key: str = "obs_id", label: str = "label") -> DataFrame:
    """Label by id under a whitelist: unknown or absent → Other with id 9."""
    lut = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    j = obs.select(key).join(source.select(key, F.col(label).alias("_l")), key, "left")
    known = F.coalesce(F.map_contains_key(lut, F.coalesce("_l", F.lit(""))), F.lit(False))
    return j.select(
        key, F.when(known, F.col("_l")).otherwise("Other").alias("region_label"),
        F.when(known, F.try_element_at(lut, F.col("_l"))).otherwise(9).alias("region_id"),
    )


def transfer_gate(transferred: DataFrame, minimum_share: float) -> DataFrame:
    share = F.avg((F.col("region_label") != "Other").cast("double"))
    return transferred.agg(
        F.count(F.lit(1)).alias("n"), share.alias("labelled_share"), (share >= minimum_share).alias("passed")
    )


def map_volume(voxels: DataFrame, lut: DataFrame, struct: str = "struct_id", region: str = "region_id") -> DataFrame:
    """Structure id to region id: 0 stays 0, unmapped becomes 9."""
    j = voxels.join(lut.select(struct, F.col(region).alias("_r")), struct, "left")
    return j.withColumn(region, F.when(F.col(struct) == 0, 0).otherwise(F.coalesce("_r", F.lit(9)))).drop("_r")


def pending_jobs(jobs: DataFrame, ledger: DataFrame, keys: Sequence[str], config: str = "config_id") -> DataFrame:
    """Jobs without a successful ledger row under the same configuration."""
    done = ledger.where(F.col("status") == "ok").select(*keys, config)
    return jobs.join(done, [*keys, config], "left_anti")


def expected_keys(levels: Mapping[str, DataFrame], exclude: Column | None = None, extra: DataFrame | None = None) -> DataFrame:
    """All combinations of the declared levels, minus exclusions, plus extra rows.

    Levels are lists of a declaration; each travels as one array and is exploded.
    """
    out = None
    for name, df in levels.items():
        values = df.agg(F.sort_array(F.collect_set(name)).alias(f"_{name}"))
        out = (values if out is None else attach(out, values, ())).withColumn(name, F.explode(f"_{name}")).drop(f"_{name}")
    if exclude is not None:
        out = out.where(~exclude)
    return out.unionByName(extra).distinct() if extra is not None else out
