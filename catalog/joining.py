"""Pairing, validated merges and joins along an axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import Tables, sql
from tallyscope.operators import pairing, voxel

SIDES = {
    "ra": "SELECT obs_id, round(x, 6) AS x, y FROM points WHERE label <> 0",
    "sb": "SELECT obs_id, x, y FROM points WHERE label <> 9",
    "sc": "SELECT obs_id + 1000000 AS obs_id, x + 1e-10 AS x, y FROM points WHERE label <> 0",
    "sd": "SELECT obs_id + 1000000 AS obs_id, x, y FROM points WHERE label > 1",
}


@query("jn1_pair_fractions", sql(
    "SELECT count(*) AS n_paired, count(*) / CAST((SELECT count(*) FROM ra) AS DOUBLE) AS fraction_reference, count(*) / CAST((SELECT count(*) FROM sb) AS DOUBLE) AS fraction_simulated FROM ra JOIN sb USING (obs_id)",
    "fraction_reference fraction_simulated", extra=SIDES))
def _(t: Tables):
    p = t.points()
    return pairing.pair_fractions(p.where("label <> 0"), p.where("label <> 9"))


def _pair_sides(t: Tables):
    p = t.points().select("obs_id", F.round("x", 6).alias("x"), "y", "label")
    ref = p.where("label <> 0")
    moved = ref.select((F.col("obs_id") + 1000000).alias("obs_id"), (F.col("x") + 1e-10).alias("x"), "y", "label")
    cases = {"ids": (ref, p.where("label <> 9")), "coords": (ref, moved), "incomplete": (ref, moved.where("label > 1"))}
    ref_all = sim_all = None
    for name, (a, b) in cases.items():
        a, b = a.withColumn("case", F.lit(name)), b.withColumn("case", F.lit(name))
        ref_all = a if ref_all is None else ref_all.unionByName(a)
        sim_all = b if sim_all is None else sim_all.unionByName(b)
    return ref_all, sim_all


@query("jn2_pairing_diagnostics", sql(
    """SELECT 'ids' AS "case", (SELECT count(*) FROM ra) AS n_reference, (SELECT count(*) FROM sb) AS n_simulated, 'exact_identifier' AS spot_pairing, '' AS pairing_issue, (SELECT count(*) FROM ra JOIN sb USING (obs_id)) AS n_paired, CAST(NULL AS BIGINT) AS n_coordinate_overlap, CAST(NULL AS BIGINT) AS n_reference_duplicate_rows, CAST(NULL AS BIGINT) AS n_simulated_duplicate_rows,
    (SELECT count(*) FROM ra JOIN sb USING (obs_id)) / CAST((SELECT count(*) FROM ra) AS DOUBLE) AS pairing_fraction_reference, (SELECT count(*) FROM ra JOIN sb USING (obs_id)) / CAST((SELECT count(*) FROM sb) AS DOUBLE) AS pairing_fraction_simulated, CAST(NULL AS DOUBLE) AS coordinate_max_abs_delta
    UNION ALL SELECT 'coords', (SELECT count(*) FROM ra), (SELECT count(*) FROM ra), 'unique_spatial_coordinate', '', (SELECT count(*) FROM ra), (SELECT count(*) FROM ra), 0, 0, 1.0, 1.0, (SELECT max(greatest(abs(ra.x - sc.x), abs(ra.y - sc.y))) FROM ra JOIN sc ON sc.obs_id = ra.obs_id + 1000000)
    UNION ALL SELECT 'incomplete', (SELECT count(*) FROM ra), (SELECT count(*) FROM sd), 'unavailable', 'incomplete_spatial_coordinate_bijection', 0, (SELECT count(*) FROM sd), 0, 0, (SELECT count(*) FROM sd) / CAST((SELECT count(*) FROM ra) AS DOUBLE), 1.0, NULL""",
    "pairing_fraction_reference pairing_fraction_simulated coordinate_max_abs_delta", extra=SIDES))
def _(t: Tables):
    return pairing.pairing_diagnostics(*_pair_sides(t), ["case"])


@query("jn2_pair_observations", sql(
    """SELECT 'ids' AS "case", ra.obs_id AS ref_id, ra.obs_id AS sim_id FROM ra JOIN sb USING (obs_id) UNION ALL SELECT 'coords', ra.obs_id, ra.obs_id + 1000000 FROM ra""", extra=SIDES))
def _(t: Tables):
    return pairing.pair_observations(*_pair_sides(t), ["case"])


@query("jn3_common_features", sql("SELECT feature_id, brand FROM features WHERE feature_id IN (SELECT l_partkey FROM lineitem)"))
def _(t: Tables):
    sim = t.read("lineitem").select(F.col("l_partkey").alias("feature_id"))
    return pairing.common_features(t.features().select("feature_id", "brand"), sim)


@query("jn4_intersect_panel", sql("SELECT l_partkey AS feature_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3"))
def _(t: Tables):
    rows = t.read("lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("dataset"))
    return pairing.intersect_panel(rows)


@query("jn5_attach_metadata", sql("SELECT doc_id, lang, quality, toxic, quality IS NOT NULL AS has_metadata FROM documents LEFT JOIN labels USING (doc_id)"))
def _(t: Tables):
    return pairing.attach_metadata(t.read("documents").select("doc_id", "lang"), t.read("labels"), "doc_id", "quality")


@query("jn5_metadata_audit", sql(
    "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_extra, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS complete"))
def _(t: Tables):
    return pairing.metadata_audit(t.read("documents"), t.read("labels"), "doc_id")


@query("jn6_merge_1to1", sql(
    "SELECT a.obs_id, a.n AS n_ref, b.n AS n_sim FROM (SELECT obs_id, count(*) AS n FROM ref GROUP BY 1) a JOIN (SELECT obs_id, count(*) AS n FROM cand GROUP BY 1) b ON a.obs_id = b.obs_id"))
def _(t: Tables):
    def n(c):
        return c.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n"))

    return pairing.merge_1to1(n(t.ref()), n(t.cand()), ["obs_id"], ("_ref", "_sim"))


@query("jn7_merge_mto1", sql("SELECT c_custkey, c_nationkey AS nation, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"))
def _(t: Tables):
    n = t.read("nation").withColumnRenamed("n_nationkey", "nation")
    return pairing.merge_mto1(t.read("customer").select("c_custkey", F.col("c_nationkey").alias("nation")), n, ["nation"])


@query("jn8_merge_indicator", sql(
    """SELECT coalesce(a.k, b.k) AS feature_id, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge
    FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 2) b ON a.k = b.k"""))
def _(t: Tables):
    li = t.read("lineitem").withColumnRenamed("l_partkey", "feature_id")
    return pairing.merge_indicator(li.where("l_quantity > 49").select("feature_id").distinct(), li.where("l_quantity < 2").select("feature_id").distinct(), ["feature_id"])


LAYERS = {f"lay{f}": f"SELECT l_suppkey AS k, round(avg(l_discount), 9) AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1" for f in ("A", "N", "R")}
LAYERS = {k.lower(): v for k, v in LAYERS.items()}


@query("jn9_layered_compare", sql(
    """SELECT k, h AS historical, p AS prior, f AS fresh, p - h AS prior_minus_historical, abs(p - h) > 1e-12 AS prior_minus_historical_changed, f - p AS fresh_minus_prior, abs(f - p) > 1e-12 AS fresh_minus_prior_changed, f - h AS fresh_minus_historical, abs(f - h) > 1e-12 AS fresh_minus_historical_changed
    FROM (SELECT a.k, a.v AS h, n.v AS p, r.v AS f FROM laya a JOIN layn n ON a.k = n.k JOIN layr r ON r.k = a.k)""",
    "historical prior fresh prior_minus_historical fresh_minus_prior fresh_minus_historical", extra=LAYERS))
def _(t: Tables):
    def layer(f):
        return t.read("lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount"), 9).alias("v"))

    return pairing.layered_compare(layer("A"), layer("N"), layer("R"), ["k"], "v")


# slices: one per (event type, hour); references are the hours divisible by 7
AXIS = {
    "slices": "SELECT label, hr AS slice_id, hr * 1.5::DOUBLE + CASE WHEN hr % 2 = 0 THEN 0.25::DOUBLE ELSE 0.0 END AS z FROM (SELECT DISTINCT event_type AS label, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS hr FROM events)",
    "refs": "SELECT * FROM slices WHERE slice_id % 7 = 0",
    "tgts": "SELECT * FROM slices WHERE slice_id % 7 <> 0",
}


def _slices(t: Tables):
    hr = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("long")
    s = t.read("events").select(F.col("event_type").alias("label"), hr.alias("slice_id")).distinct()
    return s.withColumn("z", F.col("slice_id") * 1.5 + F.when(F.col("slice_id") % 2 == 0, 0.25).otherwise(0.0))


@query("jn10_bracket", sql(
    """SELECT label, slice_id, z, lower_id, upper_id, z0, z1, (z - z0) / (z1 - z0) AS tau FROM (SELECT t.label, t.slice_id, t.z, (SELECT max(r.slice_id) FROM refs r WHERE r.label = t.label AND r.z < t.z) AS lower_id, (SELECT min(r.slice_id) FROM refs r WHERE r.label = t.label AND r.z > t.z) AS upper_id,
    (SELECT max(r.z) FROM refs r WHERE r.label = t.label AND r.z < t.z) AS z0, (SELECT min(r.z) FROM refs r WHERE r.label = t.label AND r.z > t.z) AS z1 FROM tgts t)""",
    "z z0 z1 tau", "slice_id lower_id upper_id", AXIS))
def _(t: Tables):
    s = _slices(t)
    return pairing.bracket(s.where("slice_id % 7 <> 0"), s.where("slice_id % 7 = 0"), "z", ["label"])


@query("jn11_choose_donor", sql(
    """SELECT label, slice_id, z, donor_id, g AS distance FROM (SELECT t.label, t.slice_id, t.z, r.slice_id AS donor_id, abs(r.z - t.z) AS g, row_number() OVER (PARTITION BY t.label, t.slice_id ORDER BY abs(r.z - t.z), r.slice_id) AS k FROM slices t JOIN refs r ON r.label = t.label AND r.slice_id <> t.slice_id) WHERE k = 1""",
    "z distance", "slice_id donor_id", AXIS))
def _(t: Tables):
    s = _slices(t)
    return pairing.choose_donor(s, s.where("slice_id % 7 = 0"))


@query("jn12_transfer_labels", sql(
    "SELECT c_custkey AS obs_id, CASE WHEN o_custkey IS NULL OR m = '5-LOW' THEN 'Other' ELSE m END AS region_label, CASE m WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 9 END AS region_id FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey",
    i="region_id"))
def _(t: Tables):
    src = t.read("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("obs_id")).agg(F.min("o_orderpriority").alias("label"))
    allowed = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
    return pairing.transfer_labels(t.read("customer").select(F.col("c_custkey").alias("obs_id")), src, allowed)


VOX = {
    "lut": "SELECT n_nationkey AS struct_id, n_regionkey + 1 AS region_id FROM nation",
    "vox": "SELECT DISTINCT 'E' || CAST(l_linenumber % 2 + 11 AS VARCHAR) || '.5' AS age, l_partkey % 40 AS i, l_suppkey % 25 AS j, l_orderkey % 30 AS k FROM lineitem",
    "labelled": "SELECT age, i, j, k, CASE WHEN s = 0 THEN 0 ELSE coalesce(region_id, 9) END AS region_id FROM (SELECT *, (i * 7 + j * 3 + k) % 26 AS s FROM vox) LEFT JOIN lut ON struct_id = s",
    "kept": "SELECT age, i, j, k, round(2.0::DOUBLE * i + 0.5::DOUBLE * k + 5.0, 9) AS x, round(1.5::DOUBLE * k - 3.0, 9) AS y, region_id FROM labelled WHERE region_id BETWEEN 1 AND 8",
    "planes": "SELECT age, j, round(0.25::DOUBLE * j + 0.125::DOUBLE * 0 + 1.0, 2) AS z_world FROM kept GROUP BY 1, 2",
}


def _voxels(t: Tables):
    li = t.read("lineitem")
    v = li.select(
        F.concat(F.lit("E"), (F.col("l_linenumber") % 2 + 11).cast("string"), F.lit(".5")).alias("age"), (F.col("l_partkey") % 40).alias("i"),
        (F.col("l_suppkey") % 25).alias("j"), (F.col("l_orderkey") % 30).alias("k"),
    ).distinct()
    v = v.withColumn("struct_id", (F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 26)
    lut = t.read("nation").select(F.col("n_nationkey").cast("long").alias("struct_id"), (F.col("n_regionkey") + 1).alias("region_id"))
    return pairing.map_volume(v, lut)


@query("jn13_map_volume", sql("SELECT age, i, j, k, region_id FROM labelled", i="i j k region_id", extra=VOX))
def _(t: Tables):
    return _voxels(t).select("age", "i", "j", "k", F.col("region_id").cast("long").alias("region_id"))


AFFINE = [[2.0, 0.0, 0.5, 5.0], [0.0, 0.0, 1.5, -3.0], [0.0, 0.25, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0]]


def _blueprint(t: Tables):
    schema = t.read("nation").select(F.col("n_nationkey").alias("region_id")).withColumns({
        "region_label": F.concat(F.lit("region_"), F.col("region_id").cast("string")), "include": F.col("region_id").between(1, 8),
    })
    return voxel.extract_blueprint(_voxels(t).withColumn("region_id", F.col("region_id").cast("int")), AFFINE, schema)


ORDERED = {**VOX, "zo": "SELECT age, j, z_world, row_number() OVER (PARTITION BY age ORDER BY z_world) - 1 AS z_index FROM planes"}


@query("vx1_extract_blueprint", sql(
    """SELECT age, 'voxel-' || replace(lower(age), '.', '_') || '-z' || lpad(CAST(z_index AS VARCHAR), 3, '0') || '-j' || lpad(CAST(j AS VARCHAR), 3, '0') || '-i' || lpad(CAST(i AS VARCHAR), 3, '0') || '-k' || lpad(CAST(k AS VARCHAR), 3, '0') AS spot_id,
    z_index, z_world, i, j, k, x, y, 'region_' || region_id AS region FROM kept JOIN zo USING (age, j)""", "z_world x y", "z_index i j k", ORDERED))
def _(t: Tables):
    return _blueprint(t)


@query("vx2_volume_summary", sql("SELECT age, z_index, z_world, count(*) AS n_spots FROM kept JOIN zo USING (age, j) GROUP BY 1, 2, 3", "z_world", "z_index n_spots", ORDERED))
def _(t: Tables):
    return voxel.volume_summary(_blueprint(t))


@query("jn14_pending_jobs", sql(
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0)"))
def _(t: Tables):
    jobs = t.read("orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 3).alias("config_id"))
    ledger = t.read("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"), F.lit(0).cast("long").alias("config_id")
    )
    return pairing.pending_jobs(jobs, ledger, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("jn15_expected_keys", sql(
    """SELECT * FROM (SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders)) WHERE NOT (priority = '5-LOW' AND status = 'P') UNION SELECT 'extra', '5-LOW', 'P'"""))
def _(t: Tables):
    levels = {
        "segment": t.read("customer").select(F.col("c_mktsegment").alias("segment")), "priority": t.read("orders").select(F.col("o_orderpriority").alias("priority")),
        "status": t.read("orders").select(F.col("o_orderstatus").alias("status")),
    }
    extra = t.read("region").agg(F.count(F.lit(1))).select(F.lit("extra").alias("segment"), F.lit("5-LOW").alias("priority"), F.lit("P").alias("status"))
    return pairing.expected_keys(levels, (F.col("priority") == "5-LOW") & (F.col("status") == "P"), extra)


@query("jn16_z_weights", sql(
    """SELECT label, slice_id, z, ref_z, w / sum(w) OVER (PARTITION BY label, slice_id) AS weight FROM (SELECT label, slice_id, z, ref_z, exp(-g / h) AS w FROM (SELECT *, row_number() OVER (PARTITION BY label, slice_id ORDER BY CASE WHEN below = 1 OR above = 1 THEN 0 ELSE 1 END, g, ref_z) AS k FROM (
    SELECT t.label, t.slice_id, t.z, r.z AS ref_z, abs(r.z - t.z) AS g, CASE WHEN r.z < t.z THEN rank() OVER (PARTITION BY t.label, t.slice_id, r.z < t.z ORDER BY r.z DESC) END AS below, CASE WHEN r.z > t.z THEN rank() OVER (PARTITION BY t.label, t.slice_id, r.z > t.z ORDER BY r.z) END AS above FROM tgts t JOIN refs r ON r.label = t.label))
    JOIN (SELECT label, quantile_cont(nz - z, 0.5::DOUBLE) AS h FROM (SELECT label, z, lead(z) OVER (PARTITION BY label ORDER BY z) AS nz FROM refs) GROUP BY 1) USING (label) WHERE k <= 4)""",
    "z ref_z weight", "slice_id", AXIS))
def _(t: Tables):
    s = _slices(t)
    return pairing.z_weights(s.where("slice_id % 7 <> 0"), s.where("slice_id % 7 = 0"), 4, "z", ["label"])
