"""Sources and sinks: tables written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import METRICS, Tables, sql
from tallyscope.functions.session import scratch_path
from tallyscope.sources import manifest_log, readers, writers

# io8: return flags times line numbers, and spots of a slice
AGES_AND_LINES, SLICE_SPOTS = 21, 1024


@query("io1_read_wide_counts", sql(
    """SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS obs_id, o_orderpriority AS feature_id, count(*) AS value FROM orders GROUP BY 1, 2) WHERE value > 0"""))
def _(t: Tables):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = t.read("orders").groupBy(F.col("o_custkey").cast("string").alias("cell")).pivot("o_orderpriority", levels).agg(F.count(F.lit(1))).fillna(0)
    path = scratch_path(t.spark, "wide")
    writers.write_table(wide, path, fmt="csv", header=True)
    long, reason = readers.read_wide_counts(t.spark, path)
    return readers.to_counts(long)


@query("io1_skip_reasons", sql(
    """SELECT o_orderstatus AS sample_id, 0 AS n_unreadable, count(*) FILTER (WHERE o_totalprice <> round_even(o_totalprice, 0) AND abs(o_totalprice - round_even(o_totalprice, 0)) > 1e-6) AS n_fractional, 0 AS n_negative, 'fractional_value' AS skip_reason FROM orders GROUP BY 1"""))
def _(t: Tables):
    rows = t.read("orders").select(F.col("o_orderstatus").alias("sample_id"), F.col("o_totalprice").alias("value"))
    return readers.integral_samples(rows)


@query("io1_wide_tables", sql(
    """SELECT sample_id, obs_id, feature_id, value, CAST(NULL AS VARCHAR) AS skip_reason FROM (SELECT o_orderstatus AS sample_id, CAST(o_custkey AS VARCHAR) AS obs_id, 'day' || CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) % 5000 AS VARCHAR) AS feature_id, count(*) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2, 3)
    UNION ALL SELECT DISTINCT o_orderstatus, NULL, NULL, CAST(NULL AS BIGINT), CASE o_orderstatus WHEN 'F' THEN 'fractional_value' ELSE 'first_column' END FROM orders WHERE o_orderstatus <> 'O'"""))
def _(t: Tables):
    """Tables of 5 000 features a sample: orders by customer and day.  One sample has halves, one another first column."""
    day = F.pmod(F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")), F.lit(5000))
    cells = t.read("orders").groupBy(F.col("o_orderstatus").alias("sample"), F.col("o_custkey").alias("obs"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    half = F.col("sample") == "F"
    # by number: lines are a thousand times their cells, so tasks must not be merged by the size of these
    parts = -(-t.read("orders").count() // 16_384) or 1
    held = cells.repartition(parts, "sample", "obs").groupBy("sample", "obs").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("e"))
    days = F.sequence(F.lit(0), F.lit(4999))
    zero = F.when(half, "0.0").otherwise("0")
    value = lambda n: F.when(half, (n * 0.5).cast("string")).otherwise(n.cast("string"))
    # the zeros between two days at once: a customer has orders on few of the days
    since = lambda i: F.when(i == 0, -1).otherwise(F.get("e", i - 1)["day"])
    runs = F.transform("e", lambda e, i: F.concat(F.repeat(F.concat(zero, F.lit(",")), e["day"] - since(i) - 1), value(e["n"])))
    rest = F.repeat(F.concat(F.lit(","), zero), 4999 - F.element_at("e", -1)["day"])
    lines = held.select("sample", F.concat(F.col("obs").cast("string"), F.lit(","), F.array_join(runs, ","), rest).alias("value"))
    first = F.when(F.col("sample").isin("O", "F"), "cell").otherwise("EntityID")
    heads = cells.select("sample").distinct().select("sample", F.concat_ws(",", first, F.array_join(F.transform(days, lambda d: F.concat(F.lit("day"), d.cast("string"))), ",")).alias("value"))
    path = scratch_path(t.spark, "tables")
    # mostly zeros, 10 KB a line: as plain text some 100 times the orders
    heads.unionByName(lines).write.partitionBy("sample").option("compression", "gzip").text(path)
    counts, skipped = readers.read_count_tables(t.spark, path, sample="sample=([^/]+)/")
    return counts.withColumn("skip_reason", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True)


@query("io2_read_table", sql("SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS slice_id, p_name, p_size, p_retailprice FROM part", "p_retailprice"))
def _(t: Tables):
    path = scratch_path(t.spark, "table")
    rows = t.read("part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("slice_id"), "p_name", "p_size", "p_retailprice")
    writers.write_table(rows, path, fmt="csv", header=True, sep="\t", compression="gzip")
    return readers.read_table(t.spark, path, "slice_id string, p_name string, p_size int, p_retailprice double", "\t")


@query("io3_read_positions", sql(
    """SELECT 'headed' AS kind, CAST(obs_id AS VARCHAR) AS obs_id, x, y FROM points UNION ALL SELECT 'bare', CAST(obs_id AS VARCHAR), x, y FROM points""", "x y"))
def _(t: Tables):
    p = t.points().select(F.col("obs_id").cast("string").alias("obs_id"), "x", "y")
    headed, bare = scratch_path(t.spark, "headed"), scratch_path(t.spark, "bare")
    writers.write_table(p.select(F.col("obs_id").alias("barcode"), F.col("x").alias("pxl_col_in_fullres"), F.col("y").alias("pxl_row_in_fullres")), headed, fmt="csv", header=True)
    flat = p.select("obs_id", F.lit(1), F.lit(0), F.lit(0), F.col("y"), F.col("x")).toDF("a", "b", "c", "d", "e", "f")
    writers.write_table(flat, bare, fmt="csv", header=False)
    one = readers.read_positions(t.spark, headed).withColumn("kind", F.lit("headed"))
    return one.unionByName(readers.read_positions(t.spark, bare).withColumn("kind", F.lit("bare")))


@query("io4_read_labels", sql("SELECT CAST(c_custkey AS VARCHAR) AS obs_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS label FROM customer"))
def _(t: Tables):
    path = scratch_path(t.spark, "labels")
    rows = t.read("customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", " nan ").otherwise(F.col("c_mktsegment")).alias("l")
    )
    writers.write_table(rows, path, fmt="csv", header=False, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_labels(t.spark, path)


@query("io5_scan_sections", sql("SELECT l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1"))
def _(t: Tables):
    return readers.scan_sections(t.read("lineitem"), "l_linenumber")


@query("io5_load_metadata", sql("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber IN (2, 5)"))
def _(t: Tables):
    return readers.load_metadata(t.read("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], "l_linenumber", [2, 5])


@query("io6_read_gene_sets", sql(
    "SELECT p_brand AS term, 'brand' AS source, count(DISTINCT p_partkey) AS n_members, CAST(sum(DISTINCT p_partkey) AS BIGINT) AS member_sum FROM part GROUP BY 1"))
def _(t: Tables):
    path = scratch_path(t.spark, "sets")
    member = F.col("p_partkey").cast("string")
    lines = t.read("part").groupBy("p_brand").agg(F.collect_list(member).alias("m")).select(F.concat_ws("\t", "p_brand", F.lit("brand"), "m", F.element_at("m", 1)))
    lines.write.text(path)
    s = readers.read_gene_sets(t.spark, path)
    return s.select("term", "source", F.size("members").cast("long").alias("n_members"), F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m.cast("long")).alias("member_sum"))


@query("io7_read_label_defs", sql("SELECT n_nationkey AS struct_id, n_name AS acronym, 'region ' || CAST(n_regionkey AS VARCHAR) || ': part' AS name FROM nation"))
def _(t: Tables):
    path = scratch_path(t.spark, "defs")
    n = t.read("nation")
    line = F.format_string('  %d  %d %d %d  1 1 0  "%s: region %d: part"', "n_nationkey", F.lit(10), F.lit(20), F.lit(30), "n_name", "n_regionkey")
    n.select(F.when(F.col("n_nationkey") == 3, F.concat(F.lit("# ITK comment\n"), line)).otherwise(line).alias("value")).write.text(path)
    return readers.read_label_defs(t.spark, path)


@query("io8_read_blueprint", sql(
    "SELECT l_returnflag AS age, l_linenumber AS z_index, l_linenumber * 2.5::DOUBLE AS z_world, l_linenumber AS j, CAST(l_partkey AS INTEGER) AS i, CAST(l_suppkey AS INTEGER) AS k, l_quantity AS x, l_discount AS y, l_linestatus AS region FROM lineitem", "z_world x y"))
def _(t: Tables):
    li = t.read("lineitem")
    # slices are cut by a hash of the rows, into as many parts as they need to hold some SLICE_SPOTS each, whatever the keys
    parts = -(-li.count() // (AGES_AND_LINES * SLICE_SPOTS)) or 1
    spot = F.struct(
        F.col("l_partkey").cast("int").alias("i"), F.col("l_suppkey").cast("int").alias("k"), F.col("l_quantity").alias("x"),
        F.col("l_discount").alias("y"), F.col("l_linestatus").alias("region"),
    )
    part = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey"), F.lit(parts))
    s = li.groupBy("l_returnflag", "l_linenumber", part.alias("_part")).agg(F.collect_list(spot).alias("v"))
    entry = F.struct(
        F.col("l_linenumber").alias("z_index"), (F.col("l_linenumber") * 2.5).alias("z_world"), F.col("l_linenumber").alias("voxel_j"),
        F.col("v.i").alias("voxel_i"), F.col("v.k").alias("voxel_k"), F.col("v.x").alias("x"), F.col("v.y").alias("y"), F.col("v.region").alias("region"),
    )
    path = scratch_path(t.spark, "blueprint")
    nested = s.select(F.struct(F.col("l_returnflag").alias("age")).alias("metadata"), F.array(entry).alias("slices"))
    writers.write_table(nested, path, fmt="json", compression="gzip")
    return readers.read_blueprint(t.spark, path)


@query("io9_write_table", sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"))
def _(t: Tables):
    path = scratch_path(t.spark, "orders")
    writers.write_table(t.read("orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    writers.write_table(t.read("orders").select("o_orderkey", "o_orderstatus"), path, overwrite=True, partition_by=["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("io10_append_manifest", sql(
    "SELECT k, arrival, status FROM (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS arrival, l_returnflag AS status, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linestatus DESC, l_orderkey * 10 + l_linenumber DESC, l_returnflag) AS r FROM lineitem) WHERE r = 1"))
def _(t: Tables):
    m = t.read("lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.col("l_returnflag").alias("status"), "l_linestatus")
    return writers.append_manifest(m.where("l_linestatus = 'F'").drop("l_linestatus"), m.where("l_linestatus = 'O'").drop("l_linestatus"), ["k"])


@query("io10_manifest_log", sql(
    "SELECT k, arrival, status FROM (SELECT l_suppkey AS k, l_orderkey AS arrival, l_returnflag AS status, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber DESC, l_orderkey DESC, l_returnflag DESC) AS r FROM lineitem) WHERE r = 1"))
def _(t: Tables):
    """A batch per line number in mixed order, a compaction between them, and one batch that was never committed."""
    path = scratch_path(t.spark, "manifest")
    m = t.read("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("arrival"), F.col("l_returnflag").alias("status"), "l_linenumber")
    batch = lambda i: m.where(F.col("l_linenumber") == i).drop("l_linenumber")
    for i in (3, 1, 6, 4):
        manifest_log.append(batch(i), path, at=i)
    manifest_log.compact(t.spark, path, ["k"], "arrival")
    for i in (2, 7, 5):
        manifest_log.append(batch(i), path, at=i)
    batch(7).withColumn("status", F.lit("lost")).write.parquet(f"{path}/rows/_batch=half")
    return manifest_log.current(t.spark, path, ["k"], "arrival")


@query("io11_append_metrics", sql("SELECT sample AS job_id, method, quantity, discount, tax FROM metric_wide", "quantity discount tax"))
def _(t: Tables):
    path = scratch_path(t.spark, "metrics")
    w = t.metric_long().withColumnRenamed("sample", "job_id")
    writers.append_metrics(w.where("job_id <= 2"), path)
    writers.append_metrics(w.where("job_id > 2"), path)
    return t.spark.read.schema("method int, quantity double, discount double, tax double, job_id int").parquet(path).select("job_id", "method", *METRICS)


@query("streaming_running_stats", sql("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1"))
def _(t: Tables):
    from tallyscope.streaming.running import run_available, stream_table

    source = scratch_path(t.spark, "stream")
    t.read("events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents")).repartition(3).write.parquet(source)
    out = scratch_path(t.spark, "running")
    live = stream_table(t.spark, source, t.spark.read.parquet(source).schema).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")
    )
    q = run_available(live, lambda batch, _: batch.write.mode("overwrite").parquet(out), scratch_path(t.spark, "stream-log"))
    q.awaitTermination()
    return t.spark.read.parquet(out)
