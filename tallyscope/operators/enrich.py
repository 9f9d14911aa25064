"""Label-versus-rest ranking, gene-set enrichment and its comparison."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.exprs import attach, finite, ratio
from tallyscope.functions.ordered import exact_quantiles, positions, running_totals
from tallyscope.functions.session import checkpointed
from tallyscope.operators.correlation import spearman
from tallyscope.operators.stats import label_sizes, n_obs


def gene_set_coverage(sets: DataFrame, universe: DataFrame, minimum: int = 15, maximum: int = 500) -> DataFrame:
    """Members, matches in the universe, coverage and eligibility per term.

    ``sets`` is (term, members array).
    """
    members = sets.select("term", F.explode(F.array_distinct("members")).alias("feature_id"))
    known = universe.select("feature_id").distinct().withColumn("_in", F.lit(1))
    s = members.join(known, "feature_id", "left").groupBy("term").agg(
        F.count(F.lit(1)).alias("original_genes"), F.count("_in").alias("matched_genes")
    )
    return s.withColumns({
        "panel_coverage": F.col("matched_genes") / F.col("original_genes"),
        "eligible": F.col("matched_genes").between(minimum, maximum),
    })


def rank_features(values: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label", split_rows: int | None = None) -> DataFrame:
    """Signed, tie-corrected Wilcoxon rank-sum z of each label against the rest.

    Average ranks come from (value, count) pairs with the absent cells as one
    zero block; the tie correction is one sum per feature shared by all labels.
    Labels need at least two rows, otherwise the query fails.
    """
    f = [*by, "feature_id"]
    sizes = label_sizes(obs, by, label)
    ok = F.when(F.col("n_obs") >= 2, F.lit(True)).otherwise(F.raise_error("label with fewer than two rows").cast("boolean"))
    sizes = sizes.where(ok).withColumnRenamed("n_obs", "n_label")
    total = n_obs(obs, by, "n_all")
    stored = values.where(F.col("value") != 0).join(obs.select(*by, "obs_id", label), [*by, "obs_id"])
    cells = stored.groupBy(*f, label, "value").agg(F.count(F.lit(1)).alias("n"))
    per_value = cells.groupBy(*f, "value").agg(F.sum("n").alias("n"))
    t = attach(running_totals(per_value, f, "value", ["n"], split_rows), total, by)
    zeros = F.col("n_all") - F.col("total_n")
    # negative values rank below the zero block, positive ones above it
    above = F.when(F.col("value") > 0, zeros).otherwise(0)
    ranked = t.select(
        *f, "value", "n", "total_n", "n_all",
        (above + F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"),
    )

    def cubes(n):
        x = n.cast("double")
        return x * x * x - x

    per_feature = ranked.groupBy(*f).agg(
        F.sum(cubes(F.col("n"))).alias("_ties"), F.max("total_n").alias("_nz"), F.max("n_all").alias("n_all"),
        F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("n"))), F.lit(0)).alias("_neg"),
    ).withColumn("_ties", F.col("_ties") + cubes(F.col("n_all") - F.col("_nz")))
    sums = cells.join(ranked.select(*f, "value", "rank"), [*f, "value"]).groupBy(*f, label).agg(
        F.sum(F.col("n") * F.col("rank")).alias("_r"), F.sum("n").alias("_c")
    )
    names = sizes.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("n_label").alias("n"))).alias("_l"))
    grid = attach(per_feature, names, by).withColumn("_e", F.explode("_l")).select(
        *f, "_ties", "_nz", "n_all", "_neg", F.col("_e.l").alias(label), F.col("_e.n").alias("n_label")
    )
    j = grid.join(sums, [*f, label], "left").fillna(0.0, ["_r"]).fillna(0, ["_c"])
    zero_rank = F.col("_neg") + (F.col("n_all") - F.col("_nz") + 1) / F.lit(2.0)
    w = F.col("_r") + (F.col("n_label") - F.col("_c")) * zero_rank
    n1, n = F.col("n_label").cast("double"), F.col("n_all").cast("double")
    correction = 1.0 - F.col("_ties") / (n * n * n - n)
    var = F.greatest(correction, F.lit(0.0)) * n1 * (n - n1) * (n + 1.0) / 12.0
    return j.select(
        *f, label, F.when(var > 0, (w - n1 * (n + 1.0) / 2.0) / F.sqrt(var)).otherwise(0.0).alias("score")
    )


def log_fold_change(values: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """log2 of expm1(label mean) over expm1(rest mean) of log-normalised values."""
    f = [*by, "feature_id"]
    s = values.join(obs.select(*by, "obs_id", label), [*by, "obs_id"]).groupBy(*f, label).agg(F.sum("value").alias("_s"))
    whole = s.groupBy(*f).agg(F.sum("_s").alias("_all"))
    sizes, total = label_sizes(obs, by, label), n_obs(obs, by, "n_all")
    names = sizes.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("n_obs").alias("n"))).alias("_l"))
    grid = attach(whole, names, by).withColumn("_e", F.explode("_l")).select(
        *f, "_all", F.col("_e.l").alias(label), F.col("_e.n").alias("_n")
    )
    j = attach(grid.join(s, [*f, label], "left").fillna(0.0, ["_s"]), total, by)
    here, rest = F.col("_s") / F.col("_n"), (F.col("_all") - F.col("_s")) / (F.col("n_all") - F.col("_n"))
    return j.where(F.col("n_all") > F.col("_n")).select(
        *f, label, F.log2((F.expm1(here) + 1e-9) / (F.expm1(F.greatest(rest, F.lit(0.0))) + 1e-9)).alias("log2_fold_change")
    )


def order_ranking(ranking: DataFrame, by: Sequence[str]) -> DataFrame:
    """1-based position by score descending, feature ascending, and the list length."""
    key = F.struct((-F.col("score")).alias("s"), F.col("feature_id").alias("f"))
    placed = positions(ranking.select(*by, "feature_id", "score", key.alias("_key")), by, "_key", "_p")
    n = ranking.groupBy(*by).agg(F.count(F.lit(1)).alias("n_genes"))
    return attach(placed, n, by).select(*by, "feature_id", "score", (F.col("_p") + 1).alias("pos"), "n_genes")


def enrichment_scores(ranking: DataFrame, sets: DataFrame, by: Sequence[str] = (), weight: float = 1.0, minimum: int = 15, maximum: int = 500) -> DataFrame:
    """Preranked enrichment score, leading edge, tag and gene fractions per term.

    The running sum is evaluated at the hits only.  Terms outside the size
    limits are not eligible, so one (ranking, term) window has at most
    ``maximum`` rows.  ``sets`` is (term, members array).
    """
    members = sets.select("term", F.explode(F.array_distinct("members")).alias("feature_id"))
    hits = order_ranking(ranking, by).join(members, "feature_id")
    g = [*by, "term"]
    size = hits.groupBy(*g).agg(F.count(F.lit(1)).alias("n_hits")).where(F.col("n_hits").between(minimum, maximum))
    h = hits.join(size, g).withColumn("_w", F.pow(F.abs("score"), F.lit(float(weight))))
    w = Window.partitionBy(*g).orderBy("pos")
    all_ = Window.partitionBy(*g)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumns({"_k": F.row_number().over(w), "_cum": F.sum("_w").over(run), "_tot": F.sum("_w").over(all_)})
    miss = (F.col("pos") - F.col("_k")) / (F.col("n_genes") - F.col("n_hits"))
    share = F.when(F.col("_tot") > 0, F.col("_cum") / F.col("_tot")).otherwise(F.col("_k") / F.col("n_hits"))
    prev = F.when(F.col("_tot") > 0, (F.col("_cum") - F.col("_w")) / F.col("_tot")).otherwise((F.col("_k") - 1) / F.col("n_hits"))
    h = h.withColumns({"_after": share - miss, "_before": prev - miss})
    peak = h.groupBy(*g).agg(
        F.max("_after").alias("_up"), F.min("_before").alias("_down"),
        F.min(F.struct((-F.col("_after")).alias("v"), "pos")).alias("_pu"), F.min(F.struct(F.col("_before").alias("v"), "pos")).alias("_pd"),
        F.first("n_hits").alias("n_hits"), F.first("n_genes").alias("n_genes"),
    )
    up = F.abs("_up") >= F.abs("_down")
    es = peak.select(
        *g, F.when(up, F.col("_up")).otherwise(F.col("_down")).alias("es"),
        F.when(up, F.col("_pu.pos")).otherwise(F.col("_pd.pos")).alias("_at"), up.alias("_upper"), "n_hits", "n_genes",
    )
    lead = h.select(*g, "feature_id", "pos").join(es, g).where(
        F.when(F.col("_upper"), F.col("pos") <= F.col("_at")).otherwise(F.col("pos") >= F.col("_at"))
    ).groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature_id"))), lambda e: e["feature_id"]).alias("leading_edge"),
    )
    at = F.when(F.col("_upper"), F.col("_at")).otherwise(F.col("n_genes") - F.col("_at") + 1)
    return es.join(lead, g).select(
        *g, "n_hits", "n_genes", "es", "leading_edge", (F.col("_n") / F.col("n_hits")).alias("tag_fraction"),
        (at / F.col("n_genes")).alias("gene_fraction"),
    )


# A prime below 2^31 and multipliers below it, whose products stay inside 63 bits.
PRIME, MIX, KEYED, STEP = 2_147_483_647, 48_271, 69_621, 16_807
ROUNDS = 6


def permuted_places(places: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed bijections of 0 … n - 1, each evaluated at one place; all are arrays of whole numbers.

    A Feistel network over a · b places, a and b about the root of n: its two
    digits are shifted in turn by a hash of the other.  Places that land
    behind n walk on through the same network until they land inside.
    """
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = np.ceil(n / a).astype(np.int64)
    out, todo = places.astype(np.int64).copy(), np.arange(len(places))
    while len(todo):
        base, k, high = b[todo], key[todo], a[todo]
        left, right = out[todo] // base, out[todo] % base
        for j in range(ROUNDS):
            v = right if j % 2 == 0 else left
            t = ((v + 1) * MIX + k * KEYED + j * STEP) % PRIME
            t = (t * t % PRIME * KEYED + v) % PRIME
            t = t * t % PRIME
            if j % 2 == 0:
                left = (left + t) % high
            else:
                right = (right + t) % base
        out[todo] = left * base + right
        todo = todo[out[todo] >= n[todo]]
    return out


def permutation_null(ranking: DataFrame, sizes: DataFrame, by: Sequence[str], permutations: int = 1000, seed: int = 2026, weight: float = 1.0, chunks: int | None = None) -> DataFrame:
    """(by…, n_hits, permutation, null_es) of random sets of the given sizes.

    The members of a permutation are the images of 0 … m - 1 under a bijection
    keyed by seed, size and permutation, so they are m evaluations and a join by
    position; nothing is drawn from a whole ranking.  ``sizes`` is (by…, n_hits);
    sizes as large as the ranking have no null.  ``chunks`` sets in how many tasks sets are drawn.
    """
    # fresh aliases: both sides may stem from one frame
    own = [F.col(c).alias(c) for c in by]
    ordered = checkpointed(order_ranking(ranking, by).select(*own, "score", F.col("pos").cast("long").alias("pos"), F.col("n_genes").cast("long").alias("n_genes")))
    lengths = ordered.groupBy(*by).agg(F.max("n_genes").alias("n_genes"))
    wanted = attach(sizes.select(*own, F.col("n_hits").cast("long").alias("n_hits")).distinct(), lengths, by).where("n_hits < n_genes")
    sets = wanted.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    sets = sets.repartition(*([chunks] if chunks else []), *by, "n_hits", "permutation")
    key = (F.col("permutation").cast("long") * 7919 + F.col("n_hits") * 104_729 + seed) % PRIME
    drawn = sets.select(*by, "n_hits", "n_genes", "permutation", key.alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_hits") - 1)).alias("pos"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(pos=permuted_places(*(f[c].to_numpy(np.int64) for c in ("pos", "n_genes", "_key"))) + 1)

    drawn = drawn.mapInPandas(place, drawn.schema).drop("_key")
    hits = drawn.join(ordered.drop("n_genes"), [*by, "pos"]).withColumn("_w", F.pow(F.abs("score"), F.lit(float(weight))))
    g = [*by, "n_hits", "permutation"]
    w, all_ = Window.partitionBy(*g).orderBy("pos"), Window.partitionBy(*g)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a set has n_hits rows
    h = hits.withColumns({"_k": F.row_number().over(w), "_cum": F.sum("_w").over(run), "_tot": F.sum("_w").over(all_)})
    miss = (F.col("pos") - F.col("_k")) / (F.col("n_genes") - F.col("n_hits"))
    share = F.when(F.col("_tot") > 0, F.col("_cum") / F.col("_tot")).otherwise(F.col("_k") / F.col("n_hits"))
    prev = F.when(F.col("_tot") > 0, (F.col("_cum") - F.col("_w")) / F.col("_tot")).otherwise((F.col("_k") - 1) / F.col("n_hits"))
    peak = h.groupBy(*g).agg(F.max(share - miss).alias("_up"), F.min(prev - miss).alias("_down"))
    return peak.select(*g, F.when(F.abs("_up") >= F.abs("_down"), F.col("_up")).otherwise(F.col("_down")).alias("null_es"))


def enrichment_significance(scores: DataFrame, null: DataFrame, by: Sequence[str], minimum_null: int = 10) -> DataFrame:
    """NES, nominal p and FDR q from the null of the same set size.

    Fewer than ``minimum_null`` null values of the same sign leave all three NULL.
    The FDR counts come from running totals over the pooled normalised values.
    """
    scores, null = checkpointed(scores), checkpointed(null)  # both are read several times below
    g = [*by, "n_hits"]
    sign = F.signum("null_es")
    # written: a mean summed again in another order differs in its last digit, and what is normalised by it would no longer meet
    stats = checkpointed(null.withColumn("_s", sign).groupBy(*g, "_s").agg(
        F.count(F.lit(1)).alias("_c"), F.avg(F.abs("null_es")).alias("_m")
    ))
    s = scores.withColumn("_s", F.signum("es")).join(stats, [*g, "_s"], "left")
    s = s.withColumn("nes", F.when((F.coalesce("_c", F.lit(0)) >= minimum_null) & (F.col("_m") > 0), F.col("es") / F.col("_m")))
    # nominal p: pooled order of |ES| among the same size and sign
    at = [*by, "n_hits", "_s"]
    pool = null.select(*g, sign.alias("_s"), F.abs("null_es").alias("v"), F.lit(1).alias("nn")).unionByName(
        s.select(*g, "_s", F.abs("es").alias("v"), F.lit(0).alias("nn"))
    ).groupBy(*at, "v").agg(F.sum("nn").alias("nn"))
    tail = running_totals(pool, at, "v", ["nn"]).select(
        *at, "v", (F.col("total_nn") - F.col("cum_nn") + F.col("nn")).alias("_ge"), F.col("total_nn").alias("_all")
    )
    s = s.withColumn("v", F.abs("es")).join(tail, [*at, "v"], "left").drop("v")
    s = s.withColumn("nominal_p", F.when(F.col("nes").isNotNull(), F.col("_ge") / F.col("_all"))).drop("_ge", "_all")
    # FDR: the null of every term is its size's null, so sizes weigh by their number of terms
    terms = s.where(F.col("nes").isNotNull()).groupBy(*g).agg(F.count(F.lit(1)).alias("_k"))
    nn = null.withColumn("_s", sign).join(stats.drop("_c"), [*g, "_s"]).join(terms, g).where(F.col("_m") > 0)
    both = nn.select(*by, "_s", (F.abs("null_es") / F.col("_m")).alias("v"), F.col("_k").alias("nn"), F.lit(0).cast("long").alias("no")).unionByName(
        s.where(F.col("nes").isNotNull()).select(*by, "_s", F.abs("nes").alias("v"), F.lit(0).cast("long").alias("nn"), F.lit(1).cast("long").alias("no"))
    ).groupBy(*by, "_s", "v").agg(F.sum("nn").alias("nn"), F.sum("no").alias("no"))
    q = running_totals(both, [*by, "_s"], "v", ["nn", "no"])
    n_ge, o_ge = (F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c) for c in ("nn", "no"))
    fdr = ratio(n_ge / F.col("total_nn"), o_ge / F.col("total_no"))
    q = q.where(F.col("no") > 0).select(*by, "_s", "v", F.least(fdr, F.lit(1.0)).alias("fdr_q"))
    s = s.withColumn("v", F.abs("nes")).join(q, [*by, "_s", "v"], "left")
    return s.select(*[c for c in scores.columns], "nes", "nominal_p", "fdr_q")


def recovery_metrics(real: DataFrame, cand: DataFrame, by: Sequence[str] = (), q_cut: float = 0.05) -> DataFrame:
    """Agreement of two enrichments on terms both could test; undefined shares are NULL."""
    keys = [*by, "term"]
    j = real.select(*keys, finite("nes").alias("rn"), finite("q").alias("rq")).join(
        cand.select(*keys, finite("nes").alias("cn"), finite("q").alias("cq")), keys
    )
    ok = F.col("rn").isNotNull() & F.col("rq").isNotNull() & F.col("cn").isNotNull() & F.col("cq").isNotNull()
    j = j.where(ok)
    rp, cp = (F.col("rn") > 0) & (F.col("rq") < q_cut), (F.col("cn") > 0) & (F.col("cq") < q_cut)
    s = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_terms"), F.avg(F.abs(F.col("rn") - F.col("cn"))).alias("nes_mae"),
        F.avg((F.signum("rn") == F.signum("cn")).cast("double")).alias("direction_agreement"),
        F.count_if(rp).alias("real_positive"), F.count_if(cp).alias("candidate_positive"),
        F.count_if(rp & cp).alias("recovered"), ratio(F.count_if(rp & cp), F.count_if(rp)).alias("recall"),
        ratio(F.count_if(rp & cp), F.count_if(cp)).alias("precision"), ratio(F.count_if(rp & cp), F.count_if(rp | cp)).alias("jaccard"),
    )
    return attach(s, spearman(j, "rn", "cn", by, "nes_spearman"), by, "left")


def term_status(real: DataFrame, method: DataFrame, baseline: DataFrame, by: Sequence[str] = (), q_cut: float = 0.05) -> DataFrame:
    """recovered / real_only / method_only / neither / unavailable per term, with baseline spread.

    ``baseline`` has one row per (by…, term, replicate).  Its mean, quantiles
    and positive share stay NULL where a replicate is undefined.
    """
    keys = [*by, "term"]
    rp = (F.col("real_nes") > 0) & (F.col("real_q") < q_cut)
    mp = (F.col("method_nes") > 0) & (F.col("method_q") < q_cut)
    j = real.select(*keys, finite("nes").alias("real_nes"), finite("q").alias("real_q")).join(
        method.select(*keys, finite("nes").alias("method_nes"), finite("q").alias("method_q")), keys
    )
    nothing = F.col("real_nes").isNull() | F.col("real_q").isNull() | F.col("method_nes").isNull() | F.col("method_q").isNull()
    b = baseline.select(*keys, finite("nes").alias("_n"), finite("q").alias("_q"))
    whole = F.count("_n") == F.count(F.lit(1))
    pos = F.when(F.col("_n").isNotNull() & F.col("_q").isNotNull(), ((F.col("_n") > 0) & (F.col("_q") < q_cut)).cast("double"))
    s = b.groupBy(*keys).agg(
        F.when(whole, F.avg("_n")).alias("baseline_mean"), whole.alias("_whole"),
        F.when(F.count(pos) == F.count(F.lit(1)), F.avg(pos)).alias("baseline_positive_fraction"),
    )
    q = exact_quantiles(b, keys, "_n", {"_p05": 0.05, "_p95": 0.95})
    return j.join(s, keys, "left").join(q, keys, "left").select(
        *keys, "real_nes", "method_nes",
        F.when(nothing, "unavailable").when(rp & mp, "recovered").when(rp, "real_only").when(mp, "method_only").otherwise("neither").alias("status"),
        "baseline_mean", F.when(F.col("_whole"), F.col("_p05")).alias("baseline_p05"),
        F.when(F.col("_whole"), F.col("_p95")).alias("baseline_p95"), "baseline_positive_fraction",
    )


def group_summary(comparison: DataFrame, by: Sequence[str], lower_is_better: Sequence[str] = ("nes_mae",)) -> DataFrame:
    """Medians of method and baseline, and pairs in which the method is better."""
    keys = [*by, "metric"]
    ok = F.col("value").isNotNull() & F.col("baseline_mean").isNotNull()
    v = comparison.withColumns({"_v": F.when(ok, F.col("value")), "_b": F.when(ok, F.col("baseline_mean"))})
    better = F.when(F.col("metric").isin(*lower_is_better), F.col("_v") < F.col("_b")).otherwise(F.col("_v") > F.col("_b"))
    s = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count("_v").alias("valid_pairs"), F.count_if(better).alias("better_pairs")
    )
    for c, name in (("_v", "method_median"), ("_b", "baseline_median")):
        s = s.join(exact_quantiles(v, keys, c, {name: 0.5}), keys, "left")
    return s
