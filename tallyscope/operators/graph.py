"""Statistics on neighbour graphs: spatial autocorrelation, votes, components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.exprs import attach, finite, pearson, plogp
from tallyscope.functions.session import checkpointed
from tallyscope.operators.pairpass import dealt
from tallyscope.operators.stats import label_sizes, n_obs


def weighted(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Add ``weight``: 1/k for row-normalised graphs, 1 otherwise."""
    return edges.withColumn("weight", F.lit(1.0 / k if k else 1.0))


# cells of the sources of one task, cells of an observation in one row, products looked up at a time
BLOCK_CELLS, ROW_CELLS, LOOKUPS = 1 << 18, 1 << 14, 1 << 20


def _products(sources: pd.DataFrame, ends: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(features, Σ w·xi·xj) of the edges between ``sources(obs_id, f, x)`` and ``ends(srcs, ws, f, x)``, whose rows hold arrays."""
    joined = lambda column: np.concatenate([np.asarray(v) for v in column])
    lengths = lambda column: np.array([len(v) for v in column], int)
    code, features = pd.factorize(joined(sources["f"]))
    # repeated cells of an observation add up
    held, at = np.unique(np.repeat(np.arange(len(sources)), lengths(sources["f"])) * len(features) + code, return_inverse=True)
    x = np.bincount(at, joined(sources["x"]))
    degree, size = lengths(ends["srcs"]), lengths(ends["f"])
    src, weight = pd.Index(sources["obs_id"]).get_indexer(joined(ends["srcs"])), joined(ends["ws"])
    # only cells of features that some source of this block has
    row, feature, value = np.repeat(np.arange(len(ends)), size), pd.Index(features).get_indexer(joined(ends["f"])), joined(ends["x"])
    row, feature, value = (c[feature >= 0] for c in (row, feature, value))
    first, times = np.cumsum(degree) - degree, degree[row]
    total, cuts = np.zeros(len(features)), np.cumsum(times)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(cuts, (cuts[lo - 1] if lo else 0) + LOOKUPS, side="right")))
        cell = np.repeat(np.arange(lo, hi), times[lo:hi])
        edge = first[row[cell]] + np.arange(len(cell)) - np.repeat(np.cumsum(times[lo:hi]) - times[lo:hi], times[lo:hi])
        key = src[edge] * len(features) + feature[cell]
        place = np.minimum(np.searchsorted(held, key), len(held) - 1)
        met = (held[place] == key) & (src[edge] >= 0)
        total += np.bincount(feature[cell[met]], weight[edge[met]] * x[place[met]] * value[cell[met]], len(features))
        lo = hi
    return features, total


def edge_products(cells: DataFrame, edges: DataFrame, by: Sequence[str] = (), block_cells: int = BLOCK_CELLS, row_cells: int = ROW_CELLS) -> DataFrame:
    """(by…, feature_id, _cross): parts of Σ w·xi·xj over ``edges(by…, src, dst, weight)`` of ``cells(by…, obs_id, feature_id, x)``.

    An observation's cells travel as arrays to the blocks of sources that have an edge to
    it; products are looked up there, so no row is made for a cell and an edge.
    """
    cells = cells.where(F.col("feature_id").isNotNull())
    per = cells.groupBy(*by, "obs_id").agg(F.count(F.lit(1)).alias("_n"))
    loads = per.agg(
        F.greatest(F.lit(1), F.ceil(F.sum("_n") / block_cells)).cast("int").alias("_blocks"), F.greatest(F.lit(1), F.ceil(F.max("_n") / row_cells)).cast("int").alias("_parts"),
    )
    block = lambda c: F.pmod(F.xxhash64(c), F.col("_blocks")).cast("int")
    packed = attach(cells, loads, ()).withColumn("_c", F.pmod(F.xxhash64("feature_id"), F.col("_parts")).cast("int")).groupBy(*by, "obs_id", "_blocks", "_c").agg(
        F.collect_list("feature_id").alias("f"), F.collect_list("x").alias("x")
    )
    asked = attach(edges, loads, ()).groupBy(*by, F.col("dst").alias("obs_id"), block("src").alias("_b")).agg(F.collect_list("src").alias("srcs"), F.collect_list(F.col("weight").cast("double")).alias("ws"))
    group = [*by, "_b", "_c"]
    left = packed.withColumn("_b", block("obs_id")).select(*group, "obs_id", "f", "x")
    # fresh names: both sides stem from one frame
    right = packed.select(*[F.col(c).alias(c) for c in (*by, "obs_id", "_c", "f", "x")]).join(asked, [*by, "obs_id"]).select(*group, "srcs", "ws", "f", "x")
    schema = cells.select(*by, "feature_id", F.lit(0.0).alias("_cross")).schema
    n_keys, names = len(by), schema.names

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        features, total = _products(a, b)
        some = np.flatnonzero(total)
        out = pd.DataFrame({"feature_id": features[some], "_cross": total[some]})
        for i in range(n_keys):
            out.insert(i, names[i], key[i])
        return out

    return dealt(left, group).groupBy(*group).cogroup(dealt(right, group).groupBy(*group)).applyInPandas(meet, schema)


def _moran_parts(counts: DataFrame, edges: DataFrame, obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per feature the pieces of Moran's I without making the table dense.

    Σ w (xi−m)(xj−m) = Σ w xi xj − m Σ out_i xi − m Σ in_j xj + m² Σ w.
    The edges meet only stored cells (``edge_products``).
    """
    keys = [*by, "feature_id"]
    cells = counts.where(F.col("value") != 0).select(
        *by, "obs_id", "feature_id", F.col("value").cast("double").alias("x")
    )
    ends = edges.select(*by, F.explode(F.array(
        F.struct(F.col("src").alias("obs_id"), F.col("weight").alias("o"), F.lit(0.0).alias("i")),
        F.struct(F.col("dst").alias("obs_id"), F.lit(0.0).alias("o"), F.col("weight").alias("i")),
    )).alias("_e")).select(*by, "_e.*")
    o = [*by, "obs_id"]
    strength = ends.groupBy(*o).agg(F.sum("o").alias("_out"), F.sum("i").alias("_in"))
    own = cells.join(strength, o, "left").fillna(0.0, ["_out", "_in"]).groupBy(*keys).agg(
        F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum((F.col("_out") + F.col("_in")) * F.col("x")).alias("_lin"),
    )
    cross = edge_products(cells, edges, by).groupBy(*keys).agg(F.sum("_cross").alias("_cross"))
    total = strength.groupBy(*by).agg(F.sum("_out").alias("_w"))
    base = own.join(cross, keys, "left").fillna(0.0, ["_cross"])
    base = attach(attach(base, total, by), n_obs(obs, by), by)
    m = F.col("sx") / F.col("n_obs")
    return base.withColumns({
        "_num": F.col("_cross") - m * F.col("_lin") + m * m * F.col("_w"),
        "_den": F.col("sxx") - F.col("n_obs") * m * m,
    })


def moran(counts: DataFrame, edges: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moran's I with the edge weights as given (1/k: row-normalised)."""
    p = _moran_parts(counts, edges, obs, by)
    return p.select(
        *by, "feature_id", F.when(F.col("_den") > 1e-12 * F.col("sxx"), F.col("_num") / F.col("_den")).alias("moran")
    )


def moran_unit(counts: DataFrame, edges: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unit weights with the n/W factor; NULL below three rows or without variance."""
    p = _moran_parts(counts, edges.withColumn("weight", F.lit(1.0)), obs, by)
    ok = (F.col("n_obs") >= 3) & (F.col("_w") > 0) & (F.col("_den") > 1e-12 * F.col("sxx"))
    return p.select(
        *by, "feature_id", F.when(ok, F.col("n_obs") / F.col("_w") * F.col("_num") / F.col("_den")).alias("moran")
    )


def moran_panel(
    ref: DataFrame, sim: DataFrame, ref_edges: DataFrame, sim_edges: DataFrame, ref_obs: DataFrame, sim_obs: DataFrame,
    panel: DataFrame, by: Sequence[str] = (),
) -> DataFrame:
    """Both Moran values for every panel feature (by…, feature_id, rank)."""
    keys = [*by, "feature_id"]
    small = panel.select(*keys)
    r = moran(ref.join(small, keys, "left_semi"), ref_edges, ref_obs, by).withColumnRenamed("moran", "reference_moran")
    s = moran(sim.join(small, keys, "left_semi"), sim_edges, sim_obs, by).withColumnRenamed("moran", "simulated_moran")
    return panel.join(r, keys, "left").join(s, keys, "left")


def profile_corr(panel: DataFrame, by: Sequence[str] = (), minimum: int = 5, a: str = "reference_moran", b: str = "simulated_moran", name: str = "moran_correlation") -> DataFrame:
    ok = finite(a).isNotNull() & finite(b).isNotNull()
    return panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_panel"), F.count_if(ok).alias("n_valid"),
        F.when(F.count_if(ok) >= minimum, pearson(a, b)).alias(name),
    )


def residual_moran(counts: DataFrame, edges: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Unit-weight Moran's I after removing label means, still without densifying.

    With x' = x − m(label) the sums split into stored-cell terms, label-mean
    terms per edge label pair, and their cross terms, all of which are small
    aggregates: Σ x'i x'j = Σ xi xj − Σ xi m(lj) − Σ m(li) xj + Σ m(li) m(lj).
    """
    keys = [*by, "feature_id"]
    o = [*by, "obs_id"]
    lab = obs.select(*o, label)
    cells = counts.where(F.col("value") != 0).select(*o, "feature_id", F.col("value").cast("double").alias("x")).join(lab, o)
    sizes = label_sizes(obs, by, label)
    means = cells.groupBy(*by, label, "feature_id").agg(F.sum("x").alias("_s")).join(sizes, [*by, label]).select(
        *by, label, "feature_id", "n_obs", (F.col("_s") / F.col("n_obs")).alias("m")
    )
    # Σ x'² = Σ x² − Σ_l n_l m_l²
    den = cells.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("sxx")).join(
        means.groupBy(*keys).agg(F.sum(F.col("n_obs") * F.col("m") * F.col("m")).alias("_nm")), keys
    ).withColumn("_den", F.col("sxx") - F.col("_nm"))
    # every obs counts how often each label sits at the other end, in either direction
    ends = edges.select(*by, "src", "dst")
    l_src = lab.select(*by, F.col("obs_id").alias("src"), F.col(label).alias("_ls"))
    l_dst = lab.select(*by, F.col("obs_id").alias("dst"), F.col(label).alias("_ld"))
    e = ends.join(l_src, [*by, "src"]).join(l_dst, [*by, "dst"])
    touch = (
        e.select(*by, F.col("src").alias("obs_id"), F.col("_ld").alias("_other"))
        .unionByName(e.select(*by, F.col("dst").alias("obs_id"), F.col("_ls").alias("_other")))
        .groupBy(*o, "_other").agg(F.count(F.lit(1)).alias("_t"))
    )
    other = means.select(*by, F.col(label).alias("_other"), "feature_id", F.col("m").alias("_mo"))
    linear = (
        cells.join(touch, o).groupBy(*by, "_other", "feature_id").agg(F.sum(F.col("x") * F.col("_t")).alias("_xt"))
        .join(other, [*by, "_other", "feature_id"]).groupBy(*keys).agg(F.sum(F.col("_xt") * F.col("_mo")).alias("_lin"))
    )
    mix = e.groupBy(*by, "_ls", "_ld").agg(F.count(F.lit(1)).alias("_e"))
    ms = means.select(*by, F.col(label).alias("_ls"), "feature_id", F.col("m").alias("_ms"))
    md = means.select(*by, F.col(label).alias("_ld"), "feature_id", F.col("m").alias("_md"))
    square = mix.join(ms, [*by, "_ls"]).join(md, [*by, "_ld", "feature_id"]).groupBy(*keys).agg(
        F.sum(F.col("_e") * F.col("_ms") * F.col("_md")).alias("_sq")
    )
    dst = cells.select(*by, F.col("obs_id").alias("dst"), "feature_id", F.col("x").alias("xj"))
    lag = ends.join(dst, [*by, "dst"]).groupBy(*by, "src", "feature_id").agg(F.sum("xj").alias("wx"))
    src = cells.select(*by, F.col("obs_id").alias("src"), "feature_id", F.col("x").alias("xi"))
    cross = src.join(lag, [*by, "src", "feature_id"]).groupBy(*keys).agg(F.sum(F.col("xi") * F.col("wx")).alias("_cross"))
    total = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("_w"))
    p = den.join(cross, keys, "left").join(linear, keys, "left").join(square, keys, "left").fillna(0.0, ["_cross", "_lin", "_sq"])
    p = attach(attach(p, total, by), n_obs(obs, by), by)
    ok = (F.col("n_obs") >= 3) & (F.col("_w") > 0) & (F.col("_den") > 1e-12 * F.col("sxx"))
    num = F.col("_cross") - F.col("_lin") + F.col("_sq")
    return p.select(*by, "feature_id", F.when(ok, F.col("n_obs") / F.col("_w") * num / F.col("_den")).alias("residual_moran"))


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Out- and in-degree of every node that has an edge."""
    ends = edges.select(*by, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(*by, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy(*by, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def graph_audit(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges, self edges and degree range per graph."""
    e = edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("n_self_edges")
    )
    d = degrees(edges, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min("out_degree").alias("min_out_degree"),
        F.max("out_degree").alias("max_out_degree"), F.max("in_degree").alias("max_in_degree"),
    )
    return attach(e, d, by)


def components(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = (), id_col: str = "obs_id", max_rounds: int = 60) -> DataFrame:
    """Weak components: every node with the smallest id it is connected to.

    Alternating large-star / small-star rounds (logarithmic in the diameter).
    Each round is written to the shared folder, which cuts the lineage and
    survives lost executors.
    """
    keys = list(by)
    e = edges.select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.unionByName(df.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = df
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        j = both.join(low, [*keys, "u"])
        if large:
            moved = j.where(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        else:
            moved = j.select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
                low.select(*keys, "u", F.col("_m").alias("v"))
            )
        return moved.where("u <> v").distinct()

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)"))).first()

    seen = mark(e)
    for _ in range(max_rounds):
        e = checkpointed(star(star(e, True), False))
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy(*keys, F.col("u").alias(id_col)).agg(F.min("v").alias("_root"))
    return nodes.select(*keys, id_col).join(root, [*keys, id_col], "left").select(
        *keys, id_col, F.coalesce("_root", F.col(id_col)).alias("component")
    )


def smooth_values(values: DataFrame, edges: DataFrame, by: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """Mean over the neighbours and the point itself of (by…, obs_id, key…, value)."""
    loops = values.select(*by, F.col("obs_id").alias("src"), F.col("obs_id").alias("dst")).distinct()
    ends = edges.select(*by, "src", "dst").unionByName(loops)
    v = values.withColumnRenamed("obs_id", "dst")
    return ends.join(v, [*by, "dst"]).groupBy(*by, F.col("src").alias("obs_id"), *key).agg(F.avg("value").alias("value"))


def smooth_labels(obs: DataFrame, edges: DataFrame, labels: Sequence, fraction: float, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Majority vote over neighbours and self; ties go to the first declared label."""
    own = obs.select(*by, F.col("obs_id").alias("src"), F.col("obs_id").alias("dst"))
    ends = edges.select(*by, "src", "dst").unionByName(own)
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    votes = ends.join(obs.select(*by, F.col("obs_id").alias("dst"), label), [*by, "dst"]).groupBy(*by, "src", label).agg(
        F.count(F.lit(1)).alias("_v")
    )
    # neighbours are k per point, so the labels seen by one point are at most k
    lead = votes.groupBy(*by, "src").agg(
        F.min(F.struct((-F.col("_v")).alias("v"), order.alias("o"), F.col(label).alias("l"))).alias("_b"),
        F.sum("_v").alias("_n"),
    )
    j = obs.select(*by, "obs_id", label).join(lead.withColumnRenamed("src", "obs_id"), [*by, "obs_id"])
    share = -F.col("_b.v") / F.col("_n")
    return j.select(
        *by, "obs_id", F.when(share >= fraction, F.col("_b.l")).otherwise(F.col(label)).alias("smoothed_label"),
        share.alias("fraction"),
    )


def vote(edges: DataFrame, labelled: DataFrame, by: Sequence[str] = (), label: str = "label", id_col: str = "obs_id") -> DataFrame:
    """Most frequent label among the k neighbours, ties to the smallest label."""
    v = edges.join(labelled.select(*by, F.col(id_col).alias("dst"), label), [*by, "dst"]).groupBy(*by, "src", label).agg(
        F.count(F.lit(1)).alias("_v")
    )
    lead = F.min(F.struct((-F.col("_v")).alias("v"), F.col(label).alias("l")))
    return v.groupBy(*by, F.col("src").alias(id_col)).agg(lead.alias("_b")).select(
        *by, id_col, F.col("_b.l").alias("predicted")
    )


def neighbour_labels(edges: DataFrame, obs: DataFrame, by: Sequence[str], label: str, id_col: str = "obs_id") -> DataFrame:
    a = obs.select(*by, F.col(id_col).alias("src"), F.col(label).alias("_own"))
    b = obs.select(*by, F.col(id_col).alias("dst"), F.col(label).alias("_other"))
    return edges.join(a, [*by, "src"]).join(b, [*by, "dst"])


def label_purity(edges: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label", id_col: str = "obs_id", unlabelled: Sequence[str] = ()) -> DataFrame:
    """Mean share of same-label neighbours, and 1 − purity.

    Unlabelled rows stay neighbours but do not enter the mean.
    """
    j = neighbour_labels(edges, obs, by, label, id_col)
    valid = F.col("_own").isNotNull()
    if unlabelled:
        valid &= ~F.lower(F.col("_own").cast("string")).isin(*unlabelled)
    same = F.coalesce(F.col("_own") == F.col("_other"), F.lit(False)).cast("double")
    per = j.where(valid).groupBy(*by, "src").agg(F.avg(same).alias("_p"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg("_p").alias("purity"), (1.0 - F.avg("_p")).alias("contamination")
    )


def batch_entropy(edges: DataFrame, obs: DataFrame, batch: str, second, by: Sequence[str] = (), id_col: str = "obs_id") -> DataFrame:
    """Mean base-2 entropy of the two-batch mix around each point."""
    b = obs.select(*by, F.col(id_col).alias("dst"), F.col(batch).alias("_b"))
    p = edges.join(b, [*by, "dst"]).groupBy(*by, "src").agg(
        F.avg((F.col("_b") == F.lit(second)).cast("double")).alias("_p")
    )
    h = -(plogp(F.col("_p")) + plogp(1.0 - F.col("_p")))
    return p.groupBy(*by).agg(F.avg(h).alias("batch_entropy"))


def knn_jaccard(a: DataFrame, b: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over points of |∩| / (2k − |∩|) of two k-NN graphs."""
    keys = [*by, "src", "dst"]
    common = a.select(*keys).join(b.select(*keys), keys).groupBy(*by, "src").agg(F.count(F.lit(1)).alias("_c"))
    nodes = a.select(*by, "src").distinct().join(common, [*by, "src"], "left").fillna(0, ["_c"])
    return nodes.groupBy(*by).agg(F.avg(F.col("_c") / (2.0 * k - F.col("_c"))).alias("knn_jaccard"))


def chaos(edges: DataFrame, n: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Σ nearest same-cluster distance ÷ n; ``edges`` is the k=1 graph per cluster.

    ``n`` is (by…, n_obs).  A cluster of one point adds nothing.
    """
    s = edges.groupBy(*by).agg(F.sum(F.sqrt("d2")).alias("_s"))
    return attach(n, s, by, "left").select(*by, (F.coalesce("_s", F.lit(0.0)) / F.col("n_obs")).alias("chaos"))


def pas(edges: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label", id_col: str = "obs_id") -> DataFrame:
    """Share of points with more than half of their neighbours in other clusters."""
    j = neighbour_labels(edges, obs, by, label, id_col)
    per = j.groupBy(*by, "src").agg(F.avg((F.col("_own") != F.col("_other")).cast("double")).alias("_f"))
    return per.groupBy(*by).agg(F.avg((F.col("_f") > 0.5).cast("double")).alias("pas"))


def modularity(edges: DataFrame, clusters: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", id_col: str = "obs_id") -> DataFrame:
    """Weighted modularity of a labelled undirected graph.

    Each directed row is half an undirected edge: Σ_c (in_c/2m − (deg_c/2m)²).
    """
    w = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    j = neighbour_labels(w, clusters, by, cluster, id_col)
    total = j.groupBy(*by).agg((2.0 * F.sum("weight")).alias("_2m"))
    inside = j.where(F.col("_own") == F.col("_other")).groupBy(*by, F.col("_own").alias("_c")).agg((2.0 * F.sum("weight")).alias("_in"))
    deg = j.select(*by, F.col("_own").alias("_c"), "weight").unionByName(
        j.select(*by, F.col("_other").alias("_c"), "weight")
    ).groupBy(*by, "_c").agg(F.sum("weight").alias("_deg"))
    d = attach(deg.join(inside, [*by, "_c"], "left").fillna(0.0, ["_in"]), total, by)
    return d.groupBy(*by).agg(
        F.sum(F.col("_in") / F.col("_2m") - (F.col("_deg") / F.col("_2m")) * (F.col("_deg") / F.col("_2m"))).alias("modularity")
    )


def select_resolution(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The resolution with the largest modularity; ties go to the lower one."""
    best = F.min(F.struct((-F.col("modularity")).alias("m"), F.col("resolution").alias("r")))
    return scored.where(F.col("modularity").isNotNull()).groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.r").alias("resolution"), (-F.col("_b.m")).alias("modularity")
    )


def nn_transfer(edges: DataFrame, query: DataFrame, ref: DataFrame, identity: str, label: str = "label", by: Sequence[str] = (), id_col: str = "obs_id") -> DataFrame:
    """Identity and label agreement with the nearest reference, and its mean distance."""
    q = query.select(*by, F.col(id_col).alias("src"), F.col(identity).alias("_qi"), F.col(label).alias("_ql"))
    r = ref.select(*by, F.col(id_col).alias("dst"), F.col(identity).alias("_ri"), F.col(label).alias("_rl"))
    j = edges.where(F.col("rank") == 1).join(q, [*by, "src"]).join(r, [*by, "dst"])
    return j.groupBy(*by).agg(
        F.avg((F.col("_qi") == F.col("_ri")).cast("double")).alias("identity_accuracy"),
        F.avg((F.col("_ql") == F.col("_rl")).cast("double")).alias("region_accuracy"), F.avg(F.sqrt("d2")).alias("mean_distance"),
    )


# --- centroid and rule classifiers -------------------------------------------


def centroids(values: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(by…, label, feature_id, c): label means of sparse features."""
    from tallyscope.operators.stats import class_means

    return class_means(values, obs, by, label).select(*by, label, "feature_id", F.col("mean").alias("c"))


def centroid_similarities(values: DataFrame, cents: DataFrame, obs: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(by…, obs_id, label, score): cosine clipped to [0, 1]; an empty row scores 0 everywhere.

    Labels are a declared few, so a row meets one centroid vector per label.
    """
    o = [*by, "obs_id"]
    norm = values.groupBy(*o).agg(F.sqrt(F.sum(F.col("value").cast("double") * F.col("value"))).alias("_nv"))
    cn = cents.groupBy(*by, label).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_nc"))
    dot = values.join(cents, [*by, "feature_id"]).groupBy(*o, label).agg(F.sum(F.col("value") * F.col("c")).alias("_dot"))
    names = cn.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("_nc").alias("n"))).alias("_l"))
    grid = attach(obs.select(*o).distinct(), names, by).withColumn("_e", F.explode("_l")).select(
        *o, F.col("_e.l").alias(label), F.col("_e.n").alias("_nc")
    )
    j = grid.join(dot, [*o, label], "left").join(norm, o, "left")
    s = F.col("_dot") / F.greatest("_nv", F.lit(1e-8)) / F.greatest("_nc", F.lit(1e-8))
    return j.select(*o, label, F.coalesce(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)), F.lit(0.0)).alias("score"))


def best_label(scores: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Best label, its score and the lead over the second; ties in label order.

    Scores equal to nine decimals are ties.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), F.col(label).alias("l"), F.col("score").alias("s"))))
    return scores.groupBy(*by, "obs_id").agg(ranked.alias("_r")).select(
        *by, "obs_id", F.col("_r")[0]["l"].alias("best"), F.col("_r")[0]["s"].alias("best_score"),
        (F.col("_r")[0]["s"] - F.try_element_at("_r", F.lit(2))["s"]).alias("confidence"),
    )


def centroid_classify(values: DataFrame, cents: DataFrame, obs: DataFrame, other_threshold: float | None = None, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    b = best_label(centroid_similarities(values, cents, obs, by, label), by, label)
    name = F.col("best").cast("string")
    if other_threshold is not None:
        name = F.when(F.col("best_score") < other_threshold, F.lit("Other")).otherwise(name)
    return b.select(*by, "obs_id", name.alias("predicted"), "best_score", "confidence")


def rule_max(*markers: Column) -> Column:
    return F.greatest(*markers)


def rule_product(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(a, F.lit(0.0)) * F.greatest(b, F.lit(0.0)))


def rule_difference(a: Column, b: Column, share: float) -> Column:
    return F.greatest(a - F.lit(share) * b, F.lit(0.0))


def rule_scores(wide: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Named marker rules of a wide marker table as (keys, region, score)."""
    return wide.select(*keys, *[c.alias(n) for n, c in rules.items()]).unpivot(list(keys), list(rules), "region", "score")


def tune_grid(cells: DataFrame, params: Sequence[str], fold: str, label: str = "label") -> DataFrame:
    """Best parameter row by leave-one-fold-out centroid classification.

    ``cells`` is (params…, fold, obs_id, label, feature_id, value), dense or
    sparse.  Grid points and folds are key columns of one job: the training
    sums of a fold are the sums of all folds minus its own.
    """
    from tallyscope.operators.scores import classification_summary

    cells = checkpointed(cells)  # read six times below
    g, f = [*params, label, "feature_id"], [*params, fold]
    own = cells.groupBy(*g, fold).agg(F.sum("value").alias("_s"))
    size = cells.select(*params, fold, "obs_id", label).distinct().groupBy(*params, label, fold).agg(F.count(F.lit(1)).alias("_n"))
    folds = cells.select(*f).distinct()
    total = own.groupBy(*g).agg(F.sum("_s").alias("_ts"))
    n_total = size.groupBy(*params, label).agg(F.sum("_n").alias("_tn"))
    rest = (
        total.join(n_total, [*params, label]).join(folds, list(params))
        .join(own, [*g, fold], "left").join(size, [*params, label, fold], "left").fillna(0, ["_s", "_n"])
        .where(F.col("_tn") > F.col("_n"))
        .select(*f, label, "feature_id", ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("c"))
    )
    obs = cells.select(*f, "obs_id", F.col(label).alias("_truth")).distinct()
    scores = centroid_similarities(cells.select(*f, "obs_id", "feature_id", "value"), rest, obs, f, label)
    pred = best_label(scores, f, label).join(obs, [*f, "obs_id"])
    s = classification_summary(pred, "_truth", "best", cells.select(label), params, label)
    return s.where(F.col("macro_f1").isNotNull()).orderBy(
        F.round("macro_f1", 9).desc(), F.round("accuracy", 9).desc(), F.col("n").desc(), *params
    ).limit(1)
