"""Hand-derived cases: pairing, couplings, resampling, enrichment, audits, files."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.functions.session import scratch_path
from tallyscope.operators import alignment, audit, axis, composition, correlation, distance, enrich, pairing, qc, resample, scores, stats, topk, transform
from tallyscope.sources import readers, writers

OBS = "obs_id string, x double, y double"


def diag(spark, ref, sim):
    return pairing.pairing_diagnostics(spark.createDataFrame(ref, OBS), spark.createDataFrame(sim, OBS)).first()


def pairs(spark, ref, sim):
    return {(r.ref_id, r.sim_id) for r in pairing.pair_observations(spark.createDataFrame(ref, OBS), spark.createDataFrame(sim, OBS)).collect()}


REF = [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)]


def test_identifiers_win_over_coordinates(spark):
    sim = [("a", 9.0, 9.0), ("z", 1.0, 0.0)]
    assert pairs(spark, REF, sim) == {("a", "a")}
    assert diag(spark, REF, sim).spot_pairing == "exact_identifier"


def test_permuted_coordinates_are_recovered(spark):
    sim = [("p", 0.0, 1.0), ("q", 0.0, 0.0), ("r", 1.0, 0.0)]
    assert pairs(spark, REF, sim) == {("a", "q"), ("b", "r"), ("c", "p")}


def test_rounding_noise_is_ignored(spark):
    sim = [("p", 1e-12, 1.0), ("q", 0.0, -1e-12), ("r", 1.0, 1e-11)]
    assert len(pairs(spark, REF, sim)) == 3
    assert diag(spark, REF, sim).coordinate_max_abs_delta == pytest.approx(1e-11, rel=1e-3)
    assert diag(spark, REF, REF).coordinate_max_abs_delta is None


@pytest.mark.parametrize("ref, sim, issue", [
    (REF, [("p", 0.0, 0.0), ("q", 0.0, 0.0), ("r", 1.0, 0.0)], "nonunique_spatial_coordinates"),
    (REF, [("p", 0.0, 0.0), ("q", 1.0, 0.0)], "incomplete_spatial_coordinate_bijection"),
    ([("a", 0.0, 0.0), ("a", 1.0, 0.0)], [("a", 0.0, 0.0)], "nonunique_observation_identifier"),
    (REF, [("p", float("nan"), 0.0), ("q", 1.0, 0.0), ("r", 0.0, 1.0)], "nonfinite_spatial_coordinates"),
])
def test_pairing_failures_carry_a_reason(spark, ref, sim, issue):
    d = diag(spark, ref, sim)
    assert (d.spot_pairing, d.pairing_issue, d.n_paired) == ("unavailable", issue, 0)
    assert pairs(spark, ref, sim) == set()


def transport(spark, matrix, truth):
    rows = [(i, j, float(v)) for i, r in enumerate(matrix) for j, v in enumerate(r) if v]
    c = spark.createDataFrame(rows, "ref_idx int, mov_idx int, mass double")
    t = spark.createDataFrame([(j, r) for j, r in enumerate(truth)], "mov_idx int, ref_idx int")
    ref = spark.createDataFrame([(i,) for i in range(len(matrix))], "ref_idx int")
    return alignment.transport_metrics(c, t, ref).first().asDict(), alignment.mapped_moving(c, t)


def test_perfect_partial_coupling(spark):
    m, _ = transport(spark, [[0, 0], [0.25, 0], [0, 0], [0, 0.25]], [1, 3])
    for k in ("moving_coverage", "exact_recovery", "overlap_precision", "overlap_recall", "pair_f1", "mutual_consistency", "true_mass_fraction"):
        assert m[k] == 1.0
    assert m["active_reference_fraction"] == 0.5


def test_wrong_row_coupling(spark):
    m, _ = transport(spark, [[0.30, 0], [0.20, 0], [0, 0], [0, 0.25]], [1, 3])
    assert m["overlap_precision"] == pytest.approx(2 / 3) and m["overlap_recall"] == 1.0
    assert m["pair_precision"] == pytest.approx(2 / 3) and m["exact_recovery"] == 0.5
    assert m["mutual_consistency"] == pytest.approx(2 / 3)


def test_abstention_counts_as_missed(spark):
    m, mapped = transport(spark, [[0, 0], [0.25, 0], [0, 0], [0, 0]], [1, 3])
    assert (m["moving_coverage"], m["exact_recovery"], m["conditional_accuracy"]) == (0.5, 0.5, 1.0)
    ref = spark.createDataFrame([(0, "L1"), (1, "L2"), (2, "L1"), (3, "L3")], "obs_id int, label string")
    mov = spark.createDataFrame([(0, "L2"), (1, "L3")], "obs_id int, label string")
    lab = alignment.mapped_label_metrics(mapped, ref, mov).first()
    assert (lab.label_recovery, lab.conditional_label_accuracy) == (0.5, 1.0)


@pytest.mark.parametrize("mass", [-0.5, float("nan"), 0.0])
def test_invalid_coupling_is_refused(spark, mass):
    c = spark.createDataFrame([(0, 0, mass)], "ref_idx int, mov_idx int, mass double")
    t = spark.createDataFrame([(0, 0)], "mov_idx int, ref_idx int")
    with pytest.raises(Exception):
        alignment.transport_metrics(c, t, t.select("ref_idx")).collect()


def test_ordered_subset(spark):
    full = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "obs_id string, pos int")
    ok = spark.createDataFrame([("a", 0), ("c", 1)], "obs_id string, pos int")
    bad = spark.createDataFrame([("c", 0), ("a", 1)], "obs_id string, pos int")
    assert alignment.ordered_subset(ok, full).first().ordered and not alignment.ordered_subset(bad, full).first().ordered


def test_half_turn_is_recovered(spark):
    p = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(9)], "obs_id int, x double, y double")
    r = alignment.rotate_points(p, 135.0, (0.2, -0.4))
    assert alignment.recovered_rotation(r).first()[0] == pytest.approx(135.0)
    assert r.agg(F.max("inverse_error")).first()[0] < 1e-9


# --- resampling --------------------------------------------------------------


def test_weighted_references_are_drawn_three_to_one(spark):
    refs = spark.createDataFrame([(4, "a", f"4-{i}") for i in range(8)] + [(7, "a", f"7-{i}") for i in range(5)] + [(19, "c", "19-0"), (19, "c", "19-1")], "slice_id int, label string, obs_id string")
    w = spark.createDataFrame([(1, 4, 0.1), (1, 7, 0.3)], "target_slice int, slice_id int, weight double")
    spare = spark.createDataFrame([(1, "c", 19)], "target_slice int, label string, slice_id int")
    tgt = spark.createDataFrame([(1, "a" if i < 900 else "c", f"t{i}") for i in range(1000)], "target_slice int, label string, obs_id string")
    d = resample.weighted_donors(refs, w, spare, tgt, 5, 3)
    share = d.where("label = 'a'").agg(F.avg((F.col("slice_id") == 7).cast("double"))).first()[0]
    assert share == pytest.approx(0.75, abs=0.025)
    assert d.count() == 5000 and d.where("label = 'c' and slice_id <> 19").count() == 0
    again = resample.weighted_donors(refs.repartition(5), w, spare, tgt.repartition(3), 5, 3)
    assert d.exceptAll(again).count() == 0


def test_conditional_donors_stay_in_their_label(spark):
    src = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "obs_id long, label string")
    tgt = spark.createDataFrame([(100 + i, "ab"[i % 2]) for i in range(30)], "obs_id long, label string")
    d = resample.conditional_donors(src, tgt, 4, 1)
    assert d.count() == 120
    assert d.join(src.select(F.col("obs_id").alias("donor_id"), F.col("label").alias("l")), "donor_id").where("l <> label").count() == 0
    with pytest.raises(Exception, match="lacks source support"):
        resample.conditional_donors(src.where("label = 'a'"), tgt, 1).collect()


def test_support_boundary(spark):
    src = spark.createDataFrame([("a",)] * 19 + [("b",)] * 20, "label string")
    tgt = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    s = {r.label: r.supported for r in qc.label_support(src, tgt, 20).collect()}
    assert s == {"a": False, "b": True}


# --- implicit zeros ----------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    counts = spark.createDataFrame([(0, 0, 3), (1, 0, 1), (1, 1, 2)], "obs_id long, feature_id long, value long")
    obs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "obs_id long, label string")
    features = spark.createDataFrame([(0, True), (1, False), (2, False)], "feature_id long, mt boolean")
    return counts, obs, features


def test_gene_stats_count_absent_cells(small):
    counts, obs, features = small
    g = {r.feature_id: r for r in stats.gene_stats(counts, obs, (), features).collect()}
    assert g[0]["mean"] == pytest.approx(4 / 3) and g[0]["variance"] == pytest.approx(10 / 3 - 16 / 9)
    assert g[1]["zero_fraction"] == pytest.approx(2 / 3) and g[2]["zero_fraction"] == 1.0


def test_explicit_zero_rows_change_nothing(spark, small):
    counts, obs, features = small
    padded = counts.unionByName(spark.createDataFrame([(2, 0, 0), (0, 2, 0)], "obs_id long, feature_id long, value long"))
    a, b = (sorted(map(tuple, stats.gene_stats(c, obs, (), features).collect())) for c in (counts, padded))
    assert a == b


def test_empty_observations_survive_qc(small):
    q = {r.obs_id: r for r in qc.obs_qc(*small).collect()}
    assert (q[2].total_counts, q[2].n_genes_by_counts, q[2].pct_counts_mt) == (0, 0, 0.0)
    assert q[1].pct_counts_mt == pytest.approx(100 / 3)
    counts, obs, features = small
    assert all(r.pct_counts_mt is None for r in qc.obs_qc(counts, obs, features.withColumn("mt", F.lit(False))).collect())


def test_label_means_are_one_hot_least_squares(small):
    counts, obs, _ = small
    fit = {(r.label, r.feature_id): r.prediction for r in transform.fit_label_means(counts, obs).collect()}
    x = np.array([[1, 0], [1, 0], [0, 1]], float)
    y = np.array([[3, 0], [1, 2], [0, 0]], float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit["a", 0] == pytest.approx(beta[0, 0]) and fit["a", 1] == pytest.approx(beta[0, 1])


def test_undefined_correlations_are_null_and_log_corr_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert correlation.safe_pearson(df, "x", "y").first()[0] is None
    assert correlation.log_corr(df, "x", "y").first()[0] == 0.0


def test_check_counts_sees_planted_faults(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (-2.0,), (float("nan"),), (0.0,), (2.0000001,)], "value double")
    c = qc.check_counts(df).first()
    assert (c.n_nonfinite, c.n_fractional, c.n_negative, c.n_explicit_zero, c.is_count_table) == (1, 1, 1, 1, False)


# --- scores ------------------------------------------------------------------


def test_clustering_edge_cases(spark):
    one = spark.createDataFrame([(0, 0)] * 4, "t int, p int")
    assert scores.clustering_scores(one, "t", "p").first().ari == 1.0
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(12)], "t int, p int")
    s = scores.clustering_scores(same, "t", "p").first()
    assert s.ari == pytest.approx(1.0) and s.nmi == pytest.approx(1.0)
    assert scores.ami(same, "t", "p").first().ami == pytest.approx(1.0)


def test_log_factorial(spark):
    ns = [0, 1, 5, 31, 32, 100, 10**6]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", scores.log_factorial(F.col("n")).alias("v"))
    for r in df.collect():
        assert r.v == pytest.approx(math.lgamma(r.n + 1), rel=1e-13, abs=1e-13)


def test_undefined_f1_stays_null(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    m = {r.label: r for r in scores.classification_metrics(df, "t", "p", names).collect()}
    assert m["a"].f1 == pytest.approx(2 / 3) and m["b"].recall is None and m["c"].f1 is None


def test_composition_residual(spark):
    comp = spark.createDataFrame([("s", "A", 0.5), ("s", "B", 0.2), ("s", "C", 0.3)], "spot string, type string, p double")
    types = spark.createDataFrame([("A",), ("B",)], "type string")
    got = {r.type: r.p for r in composition.with_other(comp, types).collect()}
    assert got == {"A": pytest.approx(0.5), "B": pytest.approx(0.2), "__other__": pytest.approx(0.3)}


def test_enrichment_against_a_running_sum(spark):
    rng = np.random.default_rng(2)
    score = np.round(rng.normal(size=120), 6)
    members = sorted(rng.choice(120, 20, replace=False).tolist())
    ranking = spark.createDataFrame([(int(i), float(s)) for i, s in enumerate(score)], "feature_id long, score double")
    sets = spark.createDataFrame([("t", members), ("tiny", [1, 2])], "term string, members array<long>")
    r = enrich.enrichment_scores(ranking, sets)
    assert [x.term for x in r.collect()] == ["t"]
    order = sorted(range(120), key=lambda i: (-score[i], i))
    hit = np.isin(order, members)
    w = np.where(hit, np.abs(score[order]), 0.0)
    run = np.cumsum(w / w.sum() - (~hit) / 100.0)
    es = run[np.argmax(np.abs(run))]
    got = r.first()
    assert got.es == pytest.approx(es, rel=1e-9)
    lead = [order[i] for i in range(120) if hit[i] and (i <= np.argmax(run) if es > 0 else i > np.argmin(run))]
    assert got.leading_edge == lead


def test_too_small_null_gives_null_significance(spark):
    s = spark.createDataFrame([("t", 20, 0.5), ("u", 20, -0.4)], "term string, n_hits long, es double")
    null = spark.createDataFrame([(20, i, 0.2 + i / 100) for i in range(12)] + [(20, 50 + i, -0.3) for i in range(3)], "n_hits long, permutation int, null_es double")
    r = {x.term: x for x in enrich.enrichment_significance(s, null, []).collect()}
    assert r["t"].nes == pytest.approx(0.5 / np.mean([0.2 + i / 100 for i in range(12)])) and r["t"].nominal_p == 0.0
    assert r["u"].nes is None and r["u"].nominal_p is None and r["u"].fdr_q is None


def test_permutations_do_not_depend_on_partitions(spark):
    r = spark.createDataFrame([("x", i, float((i * 37) % 101) - 50) for i in range(100)], "label string, feature_id long, score double")
    n = spark.createDataFrame([("x", 15), ("x", 20)], "label string, n_hits long")
    a = enrich.permutation_null(r, n, ["label"], 30, chunks=4)
    b = enrich.permutation_null(r.repartition(6), n, ["label"], 30, chunks=7)
    assert a.count() == 60 and a.exceptAll(b).count() == 0


def test_variable_features_are_found(spark):
    rng = np.random.default_rng(7)
    dense = rng.poisson(rng.uniform(1, 8, size=60), size=(200, 60))
    dense[:, :3] = rng.negative_binomial(0.4, 0.1, size=(200, 3))
    rows = [(i, j, int(dense[i, j])) for i in range(200) for j in range(60) if dense[i, j]]
    counts = spark.createDataFrame(pd.DataFrame(rows, columns=["obs_id", "feature_id", "value"]))
    obs = spark.range(200).withColumnRenamed("id", "obs_id")
    assert {r.feature_id for r in topk.select_panel(counts, obs, 3).collect()} == {0, 1, 2}


def test_splitting_a_class_in_half(spark):
    obs = spark.createDataFrame([("s", i, "a" if i < 7 else "b") for i in range(8)], "slice string, obs_id long, label string")
    h = axis.split_half(obs, ["slice"])
    assert {r.half: r["count"] for r in h.groupBy("half").count().collect()} == {"left": 3, "right": 4}
    assert h.where("label = 'b'").count() == 0


# --- audits ------------------------------------------------------------------


def test_key_faults_are_counted(spark):
    df = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    want = spark.createDataFrame([(1,), (2,)], "k int")
    r = audit.key_match(df, want, ["k"]).first()
    assert (r.n_duplicate, r.n_missing, r.n_unexpected, r.exact) == (1, 1, 1, False)
    assert audit.key_match(want, want, ["k"]).first().exact


def test_merges_refuse_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, w string")
    for bad in (lambda: pairing.merge_1to1(a, b, ["k"]), lambda: pairing.merge_mto1(b, a, ["k"])):
        with pytest.raises(Exception, match="key repeats"):
            bad().collect()
    assert pairing.merge_mto1(a, b, ["k"]).count() == 2


def test_solver_gate(spark):
    schema = "job int, label string, converged boolean, final_error double, iterations int, max_iterations int, stop_threshold double, mass double"
    good = [(1, "a", True, 1e-9, 5, 100, 1e-6, 1.0), (1, "b", True, 1e-9, 5, 100, 1e-6, 1.0)]
    labels = spark.createDataFrame([(1, "a"), (1, "b")], "job int, label string")
    assert audit.check_solver_records(spark.createDataFrame(good, schema), labels, ["job"]).first().passed
    for bad in ([good[0]], [good[0], (1, "b", False, 1e-9, 5, 100, 1e-6, 1.0)], good + [good[0]], [good[0], (1, "b", True, None, 5, 100, 1e-6, 1.0)]):
        assert not audit.check_solver_records(spark.createDataFrame(bad, schema), labels, ["job"]).first().passed


def test_prohibited_columns(spark):
    with pytest.raises(ValueError):
        audit.assert_no_columns(spark.createDataFrame([(1,)], "Composite_score int"), ["composite"])


def test_unknown_request_fails(spark):
    s = spark.createDataFrame([("a",), ("b",)], "sample string")
    with pytest.raises(Exception, match="not found"):
        qc.filter_requested(s, spark.createDataFrame([("z",)], "sample string"), "sample").collect()


def test_missing_class_makes_the_conditional_score_undefined(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "obs_id int, label string")
    b = spark.createDataFrame([(1, "a"), (2, "c")], "obs_id int, label string")
    score = spark.createDataFrame([("a", 1.0)], "label string, w double")
    r = distance.conditional_with_support(score, a, b, "w").first()
    assert (r.w, r.missing_mass, r.extra_mass) == (None, 0.5, 0.5)


# --- files -------------------------------------------------------------------


def test_existing_target_is_refused(spark):
    path = scratch_path(spark, "once")
    df = spark.range(3)
    writers.write_table(df, path)
    with pytest.raises(Exception):
        writers.write_table(df, path)
    writers.write_table(df, path, overwrite=True)


def test_wide_table_needs_its_id_column(spark):
    path = scratch_path(spark, "wide")
    spark.createDataFrame([("c1", 2, 0)], "barcode string, g1 int, g2 int").write.option("header", True).csv(path)
    rows, reason = readers.read_wide_counts(spark, path)
    assert rows.count() == 0 and "cell" in reason


def test_repeated_label_id_fails(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "obs_id string, label string")
    with pytest.raises(Exception, match="repeats"):
        readers.unique_labels(df).collect()


def test_label_definitions_skip_comments(spark):
    lines = spark.createDataFrame([("# header",), ('  12  255 0 0  1 1 0  "DPall: dorsal pallium"',), ('   0    0 0 0  0 0 0  "Clear Label"',)], "value string")
    got = {r.struct_id: (r.acronym, r.name) for r in readers.parse_label_defs(lines).collect()}
    assert got == {12: ("DPall", "dorsal pallium"), 0: ("Clear Label", "Clear Label")}


def test_manifest_keeps_the_last_row(spark):
    old = spark.createDataFrame([("a", 1, "ok"), ("b", 1, "ok")], "k string, arrival int, status string")
    new = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "skipped")], "k string, arrival int, status string")
    assert {r.k: r.status for r in writers.append_manifest(old, new, ["k"]).collect()} == {"a": "skipped", "b": "ok"}


def test_manifest_rows_of_one_arrival_have_one_winner(spark):
    cols = "k string, arrival int, status string, note string"
    old = spark.createDataFrame([("a", 9, "A", "x"), ("b", 2, "R", "y"), ("b", 2, "N", "z"), ("b", 2, "N", None), ("c", None, "A", "x"), ("c", 1, "R", "x")], cols)
    new = [("a", 1, s, "x") for s in ("R", "A", "N", None)]
    for rows in (new, new[::-1]):
        got = {r.k: tuple(r)[1:] for r in writers.append_manifest(old, spark.createDataFrame(rows, cols), ["k"]).collect()}
        assert got == {"a": (1, "A", "x"), "b": (2, "N", "z"), "c": (1, "R", "x")}


def test_fractional_samples_are_skipped_with_a_reason(spark):
    rows = [("s1", "a", 1.0), ("s1", "b", 0.0), ("s2", "a", 2.4), ("s3", "a", None), ("s4", "a", 3.0)]
    long = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    counts, skipped = readers.usable_counts(long)
    assert sorted((r.sample_id, r.value) for r in counts.collect()) == [("s1", 1), ("s4", 3)]
    assert {r.sample_id: r.skip_reason for r in skipped.collect()} == {"s2": "fractional_value", "s3": "unreadable_value"}
    with pytest.raises(Exception, match="not a count: 2.4"):
        readers.to_counts(long.where("sample_id = 's2'")).collect()


def test_image_positions_with_the_barcode_last(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("imagerow,imagecol,barcode\n3.5,1.25,AA\n")
    assert [tuple(r) for r in readers.read_positions(spark, str(path)).collect()] == [("AA", 1.25, 3.5)]


def test_negative_shares_count_as_nothing(spark):
    comp = spark.createDataFrame([("s", "a", 0.8), ("s", "b", -0.2), ("s", "c", 0.1)], "spot string, type string, p double")
    got = {r.type: r.p for r in composition.with_other(comp, spark.createDataFrame([("a",), ("b",)], "type string")).collect()}
    assert got == pytest.approx({"a": 0.8, "b": 0.0, "__other__": 0.2})


def test_a_feature_lost_in_the_candidate_has_ratio_zero(spark):
    cols = "feature_id string, mean double, variance double, zero_fraction double"
    base = spark.createDataFrame([("a", 1.0, 1.0, 0.5), ("b", 2.0, 1.0, 0.5), ("c", 3.0, 1.0, 0.5), ("d", 0.0, 0.0, 1.0)], cols)
    cand = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 2.0, 1.0, 0.5), ("c", 6.0, 1.0, 0.5), ("d", 1.0, 1.0, 0.5)], cols)
    r = stats.perturbation_audit(base, cand).first()
    assert (r.n_positive_genes, r.median_gene_ratio) == (3, 1.0)
    assert (r.mean_increased, r.mean_decreased, r.sparsity_increased, r.sparsity_decreased) == (True, False, False, False)
    assert (r.median_variance_ratio, r.variance_increased) == (1.0, False)


@pytest.mark.parametrize("values, found", [
    ([1.0, 2.0], (True, True, True)), ([1.0, 2.5], (True, True, False)), ([1.0, -2.0], (True, False, True)),
    ([1.0, float("nan")], (False, False, False)), ([1.0, float("inf")], (False, False, False)), ([1.0, None], (False, False, False)), ([], (True, True, True)),
])
def test_structure_of_a_perturbed_table(spark, values, found):
    counts = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], "obs_id long, feature_id string, value double")
    obs, panel = spark.range(2).withColumnRenamed("id", "obs_id"), spark.createDataFrame([("a",), ("b",)], "feature_id string")
    r = stats.structural_checks(counts, obs, obs, panel, panel.where("feature_id = 'a'")).first()
    assert (r.finite, r.nonnegative, r.integer_counts) == found
    assert (r.same_observations, r.same_features) == (True, False)


def test_expected_directions_decide_the_status(spark):
    cols = "feature_id string, mean double, variance double, zero_fraction double"
    base = spark.createDataFrame([("a", 2.0, 1.0, 0.0)], cols)
    cand = spark.createDataFrame([("a", 1.0, 2.0, 0.25)], cols)
    fine = spark.sql("select true as finite, true as same_features")
    check = lambda s, d: stats.perturbation_check(stats.perturbation_audit(base, cand), s, d).first().status
    assert check(fine, ["mean_down", "zeros_up", "variance_up"]) == "ok"
    assert check(fine, ["mean_down", "zeros_down"]) == "failed"
    assert check(spark.sql("select true as finite, false as same_features"), ["mean_down"]) == "failed"
    with pytest.raises(ValueError, match="sideways"):
        check(fine, ["sideways"])


def test_section_and_donor_ids(spark):
    ids = spark.createDataFrame([("E16.5_E1S3",), ("E9_E2S1",), ("E9_odd",), ("GSM1_MBM05_rep2",), ("GSM1_ECM7",), ("plain",), (None,)], "s string")
    got = {r.s: (r.stage, r.embryo, r.section) for r in qc.parse_section_id(ids, "s").collect()}
    assert got["E16.5_E1S3"] == ("E16.5", "E1", "S3") and got["E9_E2S1"] == ("E9", "E2", "S1")
    assert got["E9_odd"] == ("unknown", "unknown", "E9_odd") and got[None] == ("unknown", "unknown", None)
    got = {r.s: (r.condition, r.donor, r.replicate) for r in qc.parse_donor_id(ids, "s").collect()}
    assert got["GSM1_MBM05_rep2"] == ("MBM", "MBM05", "rep2") and got["GSM1_ECM7"] == ("ECM", "ECM7", "rep1")
    assert got["plain"] == ("unknown", "plain", "rep1") and got[None] == ("unknown", None, "rep1")


def test_features_empty_on_both_sides_count(spark):
    counts = [spark.createDataFrame(rows, "obs_id long, feature_id string, value long") for rows in ([(1, "a", 4), (2, "b", 1)], [(1, "a", 2), (2, "b", 3)])]
    obs = spark.createDataFrame([(1, "x"), (2, "x")], "obs_id long, label string")
    panel = spark.createDataFrame([(f,) for f in "abcd"], "feature_id string")
    means = [stats.class_means(c, obs, features=panel) for c in counts]
    want = np.corrcoef([2, 0.5, 0, 0], [1, 1.5, 0, 0])[0, 1]
    assert correlation.pseudobulk_corr(*means).first().pseudobulk_corr == pytest.approx(want)
    assert stats.group_diagnostics(*means, ["label"]).first().n_features == 4


def test_one_group_on_a_tiny_source_is_dealt_over_ranges(spark):
    """A key exploded from one row goes through the range plan like any other."""
    from tallyscope.functions import ordered

    df = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("v")).withColumn("n", F.lit(1))
    out = ordered.running_totals(df, (), "v", ["n"], 100)
    assert out.where("cum_n <> v or total_n <> 2000").count() == 0
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tallyscope.functions.session import checkpoint_folder

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(session("yarn"))
    assert checkpoint_folder(session("yarn", "hdfs://x/y")) == "hdfs://x/y"


def test_a_small_panel_is_returned_whole_with_constants_last(spark):
    rng = np.random.default_rng(51)
    x = rng.poisson(2.0, (20, 5)) + 1
    x[:, 1] = 3
    counts = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(20) for j in range(5)], "obs_id long, feature_id long, value long")
    obs = spark.range(20).withColumnRenamed("id", "obs_id")
    panel = spark.range(7).withColumnRenamed("id", "feature_id")
    got = [r.feature_id for r in topk.select_panel(counts, obs, 50, features=panel).orderBy("rank").collect()]
    assert sorted(got) == list(range(7)) and got[4:] == [1, 5, 6]
    assert len(topk.select_panel(counts, obs, 3).collect()) == 3
