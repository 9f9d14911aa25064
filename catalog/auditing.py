"""Data contracts on result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import METRICS, Tables, sql
from tallyscope.operators import audit, axis, stats

WIDE = {
    "old": "SELECT l_suppkey AS k, round(avg(l_discount), 9) AS discount, CASE WHEN l_suppkey % 4 <> 0 THEN round(avg(l_tax), 9) END AS tax, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1",
    "new": "SELECT l_suppkey AS k, CASE WHEN l_suppkey % 5 = 0 THEN (SELECT o.discount FROM old o WHERE o.k = l_suppkey) ELSE round(avg(l_discount), 9) END AS discount, CASE WHEN l_suppkey % 6 <> 0 THEN round(avg(l_tax), 9) END AS tax, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "lo": "SELECT k, 'discount' AS metric, discount AS v FROM old UNION ALL SELECT k, 'tax', tax FROM old UNION ALL SELECT k, 'n', n FROM old",
    "ln": "SELECT k, 'discount' AS metric, discount AS v FROM new UNION ALL SELECT k, 'tax', tax FROM new UNION ALL SELECT k, 'n', n FROM new",
    "on": "SELECT a.k, a.metric, a.v AS o, b.v AS w FROM lo a JOIN ln b ON a.k = b.k AND a.metric = b.metric",
}
NAMES = ["discount", "tax", "n"]


def _versions(t: Tables):
    def one(flag: str, mod: int):
        k = F.col("l_suppkey")
        return t.read("lineitem").where(F.col("l_returnflag") == flag).groupBy(k.alias("k")).agg(
            F.round(F.avg("l_discount"), 9).alias("discount"), F.round(F.avg("l_tax"), 9).alias("tax"), F.count(F.lit(1)).cast("double").alias("n")
        ).withColumn("tax", F.when(F.col("k") % mod != 0, F.col("tax")))

    old, new = one("A", 4), one("R", 6)
    new = new.join(old.select("k", F.col("discount").alias("_d")), "k").withColumn("discount", F.when(F.col("k") % 5 == 0, F.col("_d")).otherwise(F.col("discount"))).drop("_d")
    return old, new


@query("au1_key_match", sql(
    """SELECT count(*) FILTER (WHERE h > 1) AS n_duplicate, count(*) FILTER (WHERE h = 0 AND e > 0) AS n_missing, count(*) FILTER (WHERE h > 0 AND e = 0) AS n_unexpected, false AS exact FROM (SELECT k, s, sum(h) AS h, sum(e) AS e FROM (SELECT l_partkey AS k, l_suppkey AS s, 1 AS h, 0 AS e FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 0, 1 FROM lineitem WHERE l_quantity < 45) GROUP BY 1, 2)"""))
def _(t: Tables):
    li = t.read("lineitem")
    return audit.key_match(li.where("l_quantity > 40"), li.where("l_quantity < 45"), ["l_partkey", "l_suppkey"])


@query("au2_duplicates", sql("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def _(t: Tables):
    return audit.duplicates(t.read("lineitem"), ["l_partkey", "l_suppkey"])


@query("au3_check_bounds", sql(
    "SELECT metric, count(v) AS n_defined, count(*) FILTER (WHERE CASE metric WHEN 'discount' THEN v < 0.048 OR v > 0.052 WHEN 'tax' THEN v < 0.04 ELSE v > 200 END) AS n_out_of_bounds FROM lo GROUP BY 1", extra=WIDE))
def _(t: Tables):
    return audit.check_bounds(_versions(t)[0], ["k"], {"discount": (0.048, 0.052), "tax": (0.04, None), "n": (None, 200.0)})


@query("au3_rank_in_support", sql(
    "SELECT l_returnflag AS dataset, count(*) AS n_defined, count(*) FILTER (WHERE l_linenumber > n) AS n_outside_support FROM (SELECT l_returnflag, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) - CAST(l_quantity AS BIGINT) % 2 AS n FROM lineitem) GROUP BY 1"))
def _(t: Tables):
    """Line numbers as ranks among the lines of their order, of which odd quantities take one away."""
    lines = t.read("lineitem").select("l_orderkey", F.col("l_returnflag").alias("dataset"), "l_linenumber", "l_quantity")
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    ranked = lines.join(sizes, "l_orderkey").withColumn("support", F.col("_n") - F.col("l_quantity").cast("long") % 2)
    return audit.check_rank_in_support(ranked, "l_linenumber", "support", ["dataset"])


@query("au4_check_availability", sql(
    "SELECT metric, count(*) FILTER (WHERE ok AND v IS NULL) AS n_missing_value, count(*) FILTER (WHERE NOT ok AND v IS NOT NULL) AS n_unsupported_value, count(*) FILTER (WHERE ok <> (v IS NOT NULL)) = 0 AS consistent FROM (SELECT metric, v, k % 4 > 0 AS ok FROM lo WHERE metric <> 'n') GROUP BY 1", extra=WIDE))
def _(t: Tables):
    return audit.check_availability(_versions(t)[0].withColumn("support", F.col("k") % 4), "support", ["discount", "tax"])


@query("au5_check_recompute", sql(
    "SELECT metric, count(*) AS n_cells, count(*) FILTER (WHERE o IS DISTINCT FROM w AND NOT coalesce(abs(o - w) <= 1e-13 + 1e-12 * abs(w), false)) AS n_different FROM on_ GROUP BY 1", extra={**WIDE, "on_": WIDE["on"]}))
def _(t: Tables):
    return audit.check_recompute(*_versions(t), ["k"], NAMES)


OVN = {**WIDE, "on_": WIDE["on"]}


@query("au6_old_vs_new", sql(
    """SELECT k, metric, o AS old, w AS new, w - o AS delta, CASE WHEN o IS NULL AND w IS NULL THEN 'not_applicable' WHEN o IS NULL THEN 'newly_available' WHEN w IS NULL THEN 'no_longer_available' WHEN abs(w - o) <= 1e-12 THEN 'unchanged_within_1e-12' WHEN w > o THEN 'increased' ELSE 'decreased' END AS direction, (o IS NULL) <> (w IS NULL) AS availability_changed FROM on_""",
    "old new delta", extra=OVN))
def _(t: Tables):
    return audit.old_vs_new(*_versions(t), ["k"], NAMES)


@query("au7_scope_delta", sql(
    "SELECT a.k, a.v AS old, n.v AS rescoped, r.v AS new, n.v - a.v AS panel_effect, r.v - n.v AS method_effect, r.v - a.v AS total_change FROM xa a JOIN xn n ON n.k = a.k JOIN xr r ON r.k = a.k", "old rescoped new panel_effect method_effect total_change",
    extra={f"x{f.lower()}": f"SELECT l_suppkey AS k, round(avg(l_discount), 9) AS v FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1" for f in "ANR"}))
def _(t: Tables):
    a, n, r = (t.read("lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount"), 9).alias("v")) for f in "ANR")
    return audit.scope_delta(a, n, r, ["k"], "v")


@query("au8_row_changes", sql(
    """SELECT a.k, a.field, a.v AS old, b.v AS new FROM fa a JOIN fb b ON a.k = b.k AND a.field = b.field WHERE a.v IS DISTINCT FROM b.v""", extra={
        f"f{s}": f"SELECT k, 'prio' AS field, prio AS v FROM g{s} UNION ALL SELECT k, 'n', n FROM g{s}" for s in "ab"} | {
        f"g{s}": f"SELECT o_custkey AS k, max(o_orderpriority) AS prio, CASE WHEN count(*) > 5 THEN CAST(count(*) AS VARCHAR) END AS n FROM orders WHERE o_orderkey % 2 = {i} GROUP BY 1" for i, s in enumerate("ab")}))
def _(t: Tables):
    def side(i):
        return t.read("orders").where(F.col("o_orderkey") % 2 == i).groupBy(F.col("o_custkey").alias("k")).agg(
            F.max("o_orderpriority").alias("prio"), F.when(F.count(F.lit(1)) > 5, F.count(F.lit(1))).alias("n")
        )

    return audit.row_changes(side(0), side(1), ["k"], ["prio", "n"])


@query("au9_unchanged", sql(
    "SELECT (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 30 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20)) AS n_gained, (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 30)) AS n_lost, false AS unchanged"))
def _(t: Tables):
    li = t.read("lineitem")
    return audit.unchanged(li.where("l_quantity > 20"), li.where("l_quantity < 30"), ["l_partkey", "l_suppkey"])


@query("au10_baseline_gaps", sql(
    "SELECT *, max(abs(gap)) OVER (PARTITION BY metric) AS max_abs_gap FROM (SELECT l_linenumber AS method, metric, avg(v) FILTER (WHERE l_returnflag = 'A') - avg(v) FILTER (WHERE l_returnflag = 'R') AS gap FROM (SELECT l_linenumber, l_returnflag, 'l_discount' AS metric, l_discount AS v FROM lineitem UNION ALL SELECT l_linenumber, l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2)",
    "gap max_abs_gap"))
def _(t: Tables):
    li = t.read("lineitem").withColumnRenamed("l_linenumber", "method")
    return audit.baseline_gaps(li, ["method"], "l_returnflag", "A", "R", ["l_discount", "l_tax"])


@query("au11_decision", sql(
    """SELECT k, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE d > 1e-12), '') AS improved, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE d < -1e-12), '') AS worsened, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE abs(d) <= 1e-12), '') AS unchanged
    FROM (SELECT k, metric, CASE WHEN metric = 'tax' THEN o - w ELSE w - o END AS d FROM on_) GROUP BY 1""", extra=OVN))
def _(t: Tables):
    return audit.decision(*_versions(t), ["k"], NAMES, ["tax"])


@query("au11_rank_equality", sql(
    """SELECT count(*) AS n, count(*) FILTER (WHERE a.r IS DISTINCT FROM b.r) AS n_changed, count(*) FILTER (WHERE a.r IS DISTINCT FROM b.r) = 0 AS ranks_equal FROM (SELECT metric, k, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY metric ORDER BY -v NULLS LAST) END AS r FROM lo) a JOIN (SELECT metric, k, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY metric ORDER BY -v NULLS LAST) END AS r FROM ln) b ON a.k = b.k AND a.metric = b.metric""", extra=WIDE))
def _(t: Tables):
    r = [axis.metric_ranks(stats.melt(v, ["k"], NAMES), []) for v in _versions(t)]
    return audit.rank_equality(*r, ["k", "metric"])


@query("au12_check_stacks", sql(
    """SELECT stack, count(DISTINCT arm) AS n_arms, stack <> 3 AS identical_geometry, true AS both_kinds_present FROM (SELECT l_linenumber AS stack, l_returnflag AS arm FROM lineitem) GROUP BY 1"""))
def _(t: Tables):
    li = t.read("lineitem")
    s = li.select("l_linenumber", "l_suppkey").distinct()
    arms = s.withColumn("arm", F.explode(F.array(*[F.lit(x) for x in "ANR"])))
    z = F.col("l_suppkey") * 2.0 + F.when((F.col("l_linenumber") == 3) & (F.col("arm") == "R"), 1.0).otherwise(0.0)
    slices = arms.select(F.col("l_linenumber").alias("stack"), "arm", "l_suppkey", z.alias("z"), (F.col("l_suppkey") % 2).alias("kind"))
    return audit.check_stacks(slices, "arm", "stack", "z", "kind", "l_suppkey")


SOLVER = {
    "rec": "SELECT o_custkey AS job, o_orderpriority AS label, o_orderstatus <> 'P' AS converged, o_totalprice AS err, o_orderkey % 50 AS it FROM orders",
    "per": "SELECT job, label, count(*) AS c, count(*) FILTER (WHERE NOT (converged AND err < 400000 AND it BETWEEN 1 AND 48)) AS bad FROM rec GROUP BY 1, 2",
    "want": "SELECT c_custkey AS job, p.label FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS label FROM orders) p",
}


@query("au13_check_solver_records", sql(
    "SELECT coalesce(w.job, p.job) AS job, coalesce(sum(bad), 0) AS n_bad_records, count(*) FILTER (WHERE NOT coalesce(c = 1, false)) AS n_label_faults, coalesce(sum(bad), 0) + count(*) FILTER (WHERE NOT coalesce(c = 1, false)) = 0 AS passed FROM want w FULL JOIN per p ON p.job = w.job AND p.label = w.label GROUP BY 1", i="n_bad_records", extra=SOLVER))
def _(t: Tables):
    rec = t.read("orders").select(
        F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") != "P").alias("converged"),
        F.col("o_totalprice").alias("final_error"), (F.col("o_orderkey") % 50).alias("iterations"), F.lit(48).alias("max_iterations"),
        F.lit(400000.0).alias("stop_threshold"), F.lit(1.0).alias("mass"),
    )
    kinds = rec.agg(F.collect_set("label").alias("_l"))
    want = t.read("customer").select(F.col("c_custkey").alias("job")).crossJoin(F.broadcast(kinds)).select("job", F.explode("_l").alias("label"))
    return audit.check_solver_records(rec, want, ["job"])


@query("au14_digest_unchanged", sql("SELECT l_returnflag, count(*) AS n_rows, true AS same_digest FROM lineitem GROUP BY 1"))
def _(t: Tables):
    li = t.read("lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    a = audit.digest(li, cols, ["l_returnflag"])
    b = audit.digest(li.repartition(7, "l_partkey"), cols, ["l_returnflag"]).select("l_returnflag", F.col("digest").alias("_d"))
    return a.join(b, "l_returnflag").select("l_returnflag", "n_rows", (F.col("digest") == F.col("_d")).alias("same_digest"))


@query("au15_assert_no_columns", sql("SELECT r_regionkey, r_name FROM region"))
def _(t: Tables):
    return audit.assert_no_columns(t.read("region").select("r_regionkey", "r_name"), ["composite"])


@query("au16_sensitivity_delta", sql(
    "SELECT v.sample, v.method, v.metric, v.value, p.value AS primary_value, v.value - p.value AS delta FROM metric_long v JOIN metric_long p ON p.method = 0 AND p.sample = v.sample AND p.metric = v.metric WHERE v.method <> 0", "value primary_value delta"))
def _(t: Tables):
    return audit.sensitivity_delta(t.metric_long(), "method", 0, ["sample"], METRICS)


@query("au17_relation", sql(
    """SELECT sample, a AS first_value, b AS second_value, CASE WHEN abs(a - b) <= 1e-12 + 1e-10 * abs(b) THEN 'tie' WHEN a < b THEN 'first_better' ELSE 'second_better' END AS relation FROM (SELECT sample, max(value) FILTER (WHERE method = 1) AS a, max(value) FILTER (WHERE method = 2) AS b FROM metric_long WHERE metric = 'tax' GROUP BY 1)""", "first_value second_value"))
def _(t: Tables):
    return audit.relation(t.metric_long(), ["sample"], "method", 1, 2, "tax", True)


@query("au17_reversals", sql(
    """SELECT a.sample, a.r AS old_relation, b.r AS new_relation, a.r <> 'tie' AND b.r <> 'tie' AND a.r <> b.r AS reversed FROM r1 a JOIN r2 b ON a.sample = b.sample""", extra={
        f"r{i}": f"SELECT sample, CASE WHEN abs(a - b) <= 1e-12 + 1e-10 * abs(b) THEN 'tie' WHEN a < b THEN 'first_better' ELSE 'second_better' END AS r FROM (SELECT sample, max(value) FILTER (WHERE method = 1) AS a, max(value) FILTER (WHERE method = 2) AS b FROM metric_long WHERE metric = '{m}' GROUP BY 1)" for i, m in ((1, "tax"), (2, "discount"))}))
def _(t: Tables):
    w = t.metric_long()
    return audit.reversals(audit.relation(w, ["sample"], "method", 1, 2, "tax", True), audit.relation(w, ["sample"], "method", 1, 2, "discount", True), ["sample"])
