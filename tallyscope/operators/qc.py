"""Quality control, predicates and label hygiene over long count tables.

Tables: ``counts(by…, obs_id, feature_id, value)`` holds non-zero cells only,
``obs(by…, obs_id, …)`` and ``features(feature_id, …)`` carry the dense support.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, col
from tallyscope.functions.ordered import exact_quantiles

INTEGER_TOLERANCE = 1e-6


def check_counts(counts: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Counters of cells that break the count contract (finite, integral, >= 0)."""
    v = F.col(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(bad).alias("n_nonfinite"),
        F.count_if(~bad & (F.abs(v - F.rint(v)) > INTEGER_TOLERANCE)).alias("n_fractional"),
        F.count_if(~bad & (v < 0)).alias("n_negative"),
        F.count_if(v == 0).alias("n_explicit_zero"),
    ).withColumn(
        "is_count_table", (F.col("n_nonfinite") + F.col("n_fractional") + F.col("n_negative")) == 0
    )


def obs_qc(counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total_counts, n_genes_by_counts and pct_counts_mt for every observation.

    Observations without a stored cell survive with zeros.  The mitochondrial
    share is 0 for an empty observation and NULL where no feature is flagged.
    """
    keys = [*by, "obs_id"]
    flags = features.select("feature_id", "mt")
    has_mt = flags.agg(F.coalesce(F.bool_or("mt"), F.lit(False)).alias("_has_mt"))
    sums = (
        counts.join(flags, "feature_id", "left").groupBy(*keys).agg(
            F.sum("value").alias("_t"), F.count_if(F.col("value") > 0).alias("_g"),
            F.sum(F.when(F.col("mt"), F.col("value")).otherwise(0)).alias("_m"),
        )
    )
    t = F.coalesce(F.col("_t"), F.lit(0)).cast("long")
    return attach(obs.select(*keys).join(sums, keys, "left"), has_mt, ()).select(
        *keys, t.alias("total_counts"),
        F.coalesce(F.col("_g"), F.lit(0)).cast("long").alias("n_genes_by_counts"),
        F.when(F.col("_has_mt"), F.when(t > 0, F.col("_m") / t * 100.0).otherwise(0.0)).alias("pct_counts_mt"),
    )


def keep_masks(
    counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str] = (), *,
    min_counts: float, min_genes: int, min_cells: int, max_pct_mt: float | None,
) -> tuple[DataFrame, DataFrame]:
    """Kept observations and kept features, both judged on the unfiltered data."""
    keep = (F.col("total_counts") >= min_counts) & (F.col("n_genes_by_counts") >= min_genes)
    if max_pct_mt is not None:
        keep &= F.col("pct_counts_mt").isNull() | (F.col("pct_counts_mt") <= max_pct_mt)
    kept_obs = obs_qc(counts, obs, features, by).where(keep)
    support = counts.groupBy(*by, "feature_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"))
    kept_features = support.where(F.col("n_cells") >= min_cells)
    return kept_obs, kept_features


def apply_qc(counts: DataFrame, obs: DataFrame, features: DataFrame, by: Sequence[str] = (), **rules) -> DataFrame:
    """The counts restricted to kept observations and kept features."""
    kept_obs, kept_features = keep_masks(counts, obs, features, by, **rules)
    return counts.join(kept_obs.select(*by, "obs_id"), [*by, "obs_id"], "left_semi").join(
        kept_features.select(*by, "feature_id"), [*by, "feature_id"], "left_semi"
    )


def qc_stats(counts: DataFrame, obs: DataFrame, features: DataFrame, **rules) -> DataFrame:
    """Observation and feature numbers before and after the keep rules."""
    kept_obs, kept_features = keep_masks(counts, obs, features, (), **rules)
    parts = {
        "n_obs_before_qc": obs, "n_vars_before_qc": features, "n_obs": kept_obs, "n_vars": kept_features,
    }
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else attach(out, n, ())
    return out


def unique_names(df: DataFrame, name: str, pos: str, out: str = "unique_name") -> DataFrame:
    """Second and later copies of a name get ``-2``, ``-3`` … in ``pos`` order.

    Copies are ranked by a sort inside one name, cut into ranges when a name is
    very frequent.
    """
    from tallyscope.functions.ordered import positions

    ranked = positions(df, [name], pos, "_copy")
    c = F.col("_copy") + 1
    return ranked.withColumn(
        out, F.when(c == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), c.cast("string")))
    ).drop("_copy")


def normalize_label(c: str | Column) -> Column:
    """Trim; blank, NA and NAN become ``unknown``."""
    t = F.trim(col(c))
    return F.when(t.isNull() | F.upper(t).isin("", "NA", "NAN"), F.lit("unknown")).otherwise(t)


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop rows labelled ``unknown``; a table without the column passes unchanged."""
    return df.where(F.col(label).isNull() | (F.col(label) != "unknown")) if label in df.columns else df


# Fixed value: the form of a sample label (stage or treatment, sex, replicate).
SAMPLE_PATTERN = r"^(E\d+|MIA|Abx)([MF])_(\d+)$"


def parse_sample_id(df: DataFrame, sample: str) -> DataFrame:
    """stage / condition / sex / replicate from ids such as ``GSM1_E14M_2``."""
    label = F.regexp_replace(F.col(sample), r"^[^_]*_", "")
    hit = label.rlike(SAMPLE_PATTERN)
    token = F.regexp_extract(label, SAMPLE_PATTERN, 1)
    timed = token.startswith("E")
    unknown = F.lit("unknown")
    return df.withColumns({
        "stage": F.when(hit, F.when(timed, token).otherwise("E14")).otherwise(unknown),
        "condition": F.when(hit, F.when(timed, F.lit("PBS")).otherwise(token)).otherwise(unknown),
        "sex": F.when(hit, F.regexp_extract(label, SAMPLE_PATTERN, 2)).otherwise(unknown),
        "replicate": F.when(hit, F.regexp_extract(label, SAMPLE_PATTERN, 3)).otherwise(unknown),
    })


# Fixed value: ids such as E16.5_E1S3, of stage, embryo and section.
SECTION_PATTERN = r"^(E\d+(?:\.\d+)?)_(E\d+)S(\d+)$"


def parse_section_id(df: DataFrame, sample: str) -> DataFrame:
    """stage / embryo / section; an id of another form is its own section, the rest unknown."""
    c = F.col(sample)
    hit = c.rlike(SECTION_PATTERN)
    part = lambda i: F.regexp_extract(c, SECTION_PATTERN, i)
    return df.withColumns({
        "stage": F.when(hit, part(1)).otherwise("unknown"), "embryo": F.when(hit, part(2)).otherwise("unknown"),
        "section": F.when(hit, F.concat(F.lit("S"), part(3))).otherwise(c),
    })


def parse_donor_id(df: DataFrame, sample: str) -> DataFrame:
    """condition / donor / replicate from ids such as ``GSM1_MBM05_rep2``; the replicate is rep1 where none is named."""
    tokens = F.split(F.regexp_replace(F.col(sample), r"^[^_]*_", ""), "_")
    donor, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    return df.withColumns({
        "condition": F.when(donor.startswith("MBM"), "MBM").when(donor.startswith("ECM"), "ECM").otherwise("unknown"),
        "donor": donor, "replicate": F.when(second.startswith("rep"), second).otherwise("rep1"),
    })


# Spellings of the region names that annotators use.
REGION_SYNONYMS = {
    "DorsalVZ": ("dorsalvz", "dorsvz", "dorvz", "dvz"),
    "VentralVZ": ("ventralvz", "ventvz", "venvz", "vvz"),
    "SeptalVZ": ("septalvz", "septvz", "svz"),
    "CP": ("cp", "corticalplate"),
    "IZ": ("iz", "intermediatezone"),
    "GE": ("ge", "lge", "mge", "cge", "ganglioniceminence"),
    "Septum": ("septum", "septal"),
    "BT": ("bt", "basaltelencephalon", "basallateral", "basal"),
}


def collapse_region(c: str | Column, synonyms: Mapping[str, Sequence[str]] = REGION_SYNONYMS) -> Column:
    """Free-text region to its canonical name, '' where nothing matches."""
    t = F.trim(col(c))
    squashed = F.regexp_replace(F.regexp_replace(t, r"[\s_-]+", "_"), r"^_+", "")
    sided = F.regexp_replace(F.lower(squashed), r"^(left|right|l|r)(_|$)", "")
    key = F.regexp_replace(sided, "_", "")
    out = F.lit("")
    for name, spellings in synonyms.items():
        out = F.when(key.isin(*spellings), F.lit(name)).otherwise(out)
    return F.when(t.isNull() | F.lower(t).isin("", "nan", "none"), F.lit("")).otherwise(out)


def crosswalk(
    labels: DataFrame, acronym: str, name: str, rules: Sequence[tuple[str, Sequence[str], int, str, str]]
) -> DataFrame:
    """Ordered acronym rules; the first that fits decides, otherwise Other.

    A rule is ``(kind, values, region_id, region_label, rule_name)`` with kind
    ``exact`` or ``prefix``.  Acronym 0 or a clear label is background.
    """
    a, text = F.col(acronym).cast("string"), F.lower(F.concat_ws(" ", F.col(acronym).cast("string"), F.col(name)))

    def pack(region_id, region_label, rule_name):
        return F.struct(
            F.lit(region_id).alias("region_id"), F.lit(region_label).alias("region_label"),
            F.lit(rule_name).alias("mapping_rule"),
        )

    chain = F.when((a == "0") | text.contains("clear label"), pack(0, "Background", "zero_or_clear_label"))
    for kind, values, region_id, region_label, rule_name in rules:
        if kind == "exact":
            hit = a.isin(*values)
        else:
            hit = F.lit(False)
            for v in values:
                hit |= a.startswith(v)
        chain = chain.when(hit, pack(region_id, region_label, rule_name))
    chain = chain.otherwise(pack(9, "Other", "qc_unresolved_or_non_target_region"))
    out = labels.withColumn("_r", chain).select("*", "_r.*").drop("_r")
    return out.withColumn(
        "review_status",
        F.when((F.col("region_label") == "Other") & (a != "0"), "auto_review_required").otherwise("auto_mapped"),
    )


def filter_requested(samples: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Requested samples in their stored order; an unknown id fails the query."""
    flagged = requested.select(key).distinct().join(
        samples.select(key).distinct().withColumn("_known", F.lit(True)), key, "left"
    )
    checked = flagged.where(
        F.when(F.col("_known"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("requested sample not found: "), F.col(key).cast("string"))).cast("boolean")
        )
    )
    return samples.join(checked.select(key), key, "left_semi")


def half_split(obs: DataFrame, axis: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """``observed`` at or below the coordinate quantile, ``masked`` above it."""
    cut = exact_quantiles(obs, by, axis, {"split_at": q})
    return attach(obs, cut, by).withColumn(
        "part", F.when(F.col(axis) <= F.col("split_at"), "observed").otherwise("masked")
    )


def label_support(source: DataFrame, target: DataFrame, min_n: int, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Per target label: source rows, whether supported, and target rows."""
    keys = [*by, label]
    s = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_source"))
    t = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_target"))
    return t.join(s, keys, "left").select(
        *keys, "n_target", F.coalesce("n_source", F.lit(0)).cast("long").alias("n_source"),
        (F.coalesce("n_source", F.lit(0)) >= min_n).alias("supported"),
    )


def retained_support(support: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Excluded labels, excluded target rows and the retained share."""
    drop = ~F.col("supported")
    return support.groupBy(*by).agg(
        F.count_if(drop).alias("n_excluded_labels"),
        F.coalesce(F.sum(F.when(drop, F.col("n_target"))), F.lit(0)).alias("n_excluded_rows"),
        (F.sum(F.when(drop, 0).otherwise(F.col("n_target"))) / F.sum("n_target")).alias("retained_fraction"),
    )


def positive_support(counts: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observations with their library size and whether they can be scored."""
    keys = [*by, "obs_id"]
    totals = counts.groupBy(*keys).agg(F.sum("value").alias("_t"))
    return obs.select(*keys).join(totals, keys, "left").select(
        *keys, F.coalesce("_t", F.lit(0)).cast("long").alias("total_counts"),
        (F.coalesce("_t", F.lit(0)) > 0).alias("scored"),
    )


def crop_plate(points: DataFrame, plate: DataFrame, by: Sequence[str] = (), dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """Mark points inside the inclusive bounding box of ``plate``."""
    box = plate.groupBy(*by).agg(
        *[F.min(d).alias(f"_lo_{d}") for d in dims], *[F.max(d).alias(f"_hi_{d}") for d in dims]
    )
    inside = F.lit(True)
    for d in dims:
        inside &= F.col(d).between(F.col(f"_lo_{d}"), F.col(f"_hi_{d}"))
    out = attach(points, box, by).withColumn("inside", inside)
    return out.drop(*[f"_{s}_{d}" for s in ("lo", "hi") for d in dims])


def crop_report(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return marked.groupBy(*by).agg(
        F.count_if("inside").alias("n_kept"), F.count_if(~F.col("inside")).alias("n_dropped"),
        (F.count_if("inside") / F.count(F.lit(1))).alias("kept_fraction"),
    )


def roi_count(points: DataFrame, x0: float, y0: float, x1: float, y1: float, by: Sequence[str] = ()) -> DataFrame:
    """Points in the half-open box [x0, x1) × [y0, y1)."""
    box = points.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return box.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"))


def normalize_columns(df: DataFrame, expected: Sequence[str], prefix: str = "") -> DataFrame:
    """Exact column names, or the same names all under one declared prefix."""
    if set(expected) <= set(df.columns):
        return df.select(*expected)
    if prefix and {prefix + c for c in expected} <= set(df.columns):
        return df.select(*[F.col(prefix + c).alias(c) for c in expected])
    raise ValueError(f"columns {sorted(df.columns)} are not {sorted(expected)}, plain or under {prefix!r}")
