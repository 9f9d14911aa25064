"""The given tables in the roles the operators expect, in Spark and in SQL.

Lines are sparse counts (supplier = observation, part = feature, summed
quantity = count), embeddings are points with vectors, events an ordered axis.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.session import spread


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    # counts
    def counts(self, where=None, keys: tuple = ()) -> DataFrame:
        rows = self.read("lineitem")
        if where is not None:
            rows = rows.where(where)
        cell = [c for _, c in keys] + ["l_suppkey", "l_partkey"]
        return spread(rows, *cell).groupBy(
            *[F.col(c).alias(n) for n, c in keys], F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("feature_id")
        ).agg(F.sum("l_quantity").cast("long").alias("value"))

    def ref(self) -> DataFrame:
        return self.counts(F.col("l_orderkey") % 2 == 0)

    def cand(self) -> DataFrame:
        return self.counts(F.col("l_orderkey") % 2 == 1)

    def flagged(self) -> DataFrame:
        return self.counts(keys=(("dataset", "l_returnflag"),))

    def obs(self) -> DataFrame:
        nation = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        return self.read("supplier").join(nation, "s_nationkey").select(
            F.col("s_suppkey").alias("obs_id"), F.col("n_regionkey").alias("label"), F.col("s_nationkey").alias("nation"),
            (F.pmod(F.col("s_suppkey") * 37, F.lit(101)).cast("double") + F.col("s_acctbal") / 20000.0).alias("x"),
            (F.col("s_acctbal") / 100.0).alias("y"),
        )

    def flagged_obs(self) -> DataFrame:
        return self.obs().withColumn("dataset", F.explode(F.array(*[F.lit(x) for x in "ANR"])))

    def features(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"),
            F.col("p_brand").startswith("Brand#1").alias("mt"),
        )

    # points
    def points(self) -> DataFrame:
        e = self.read("embeddings")
        return e.select(
            F.col("vec_id").alias("obs_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
            "label", (F.col("vec_id") % 2).cast("int").alias("batch"), F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id"),
            F.col("embedding").alias("vec"),
        )

    def place_counts(self) -> DataFrame:
        """Small dense-ish counts on the points: feature = dimension."""
        e = self.read("embeddings").select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("feature_id", "e"))
        v = F.greatest(F.lit(0.0), F.round(F.col("e").cast("double") * 20.0)).cast("long")
        return e.select("obs_id", "feature_id", v.alias("value")).where(F.col("value") > 0)

    def dims(self) -> DataFrame:
        return self.read("embeddings").select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("feature_id")).distinct()

    def comp(self, parity: int | None = None) -> DataFrame:
        """Shares of order value by priority per customer."""
        o = self.read("orders")
        if parity is not None:
            o = o.where(F.col("o_orderkey") % 2 == parity)
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        s = o.groupBy(F.col("o_custkey").alias("spot"), F.col("o_orderpriority").alias("type")).agg(F.sum(cents).alias("_v"))
        total = o.groupBy(F.col("o_custkey").alias("spot")).agg(F.sum(cents).alias("_t"))
        return s.join(total, "spot").select("spot", "type", (F.col("_v") / F.col("_t")).alias("p"))

    # axis
    def axis_obs(self) -> DataFrame:
        """One observation per event: slice = hour-of-day block by day, class = event type."""
        return self.read("events").select(
            F.col("event_id").alias("obs_id"), F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("z"),
            F.col("event_type").alias("label"), (F.col("user_id") % 20).alias("feature_id"),
            F.round(F.col("value") * 100).cast("long").alias("value"),
        )

    def metric_long(self) -> DataFrame:
        """Revenue-type metrics per supplier region (method) and ship mode flag (sample), long form."""
        j = self.read("lineitem").join(self.obs().select(F.col("obs_id").alias("l_suppkey"), F.col("label").alias("method")), "l_suppkey")
        w = j.groupBy("method", F.col("l_linenumber").alias("sample")).agg(
            F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
        )
        return w.select("method", "sample", F.round("quantity", 9).alias("quantity"), F.round("discount", 9).alias("discount"), F.round("tax", 9).alias("tax"))


METRICS = ("quantity", "discount", "tax")

# SQL of the same roles
CTES = {
    "counts": "SELECT l_suppkey AS obs_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2",
    "ref": "SELECT l_suppkey AS obs_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2",
    "cand": "SELECT l_suppkey AS obs_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2",
    "flagged": "SELECT l_returnflag AS dataset, l_suppkey AS obs_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3",
    "obs": "SELECT s_suppkey AS obs_id, n_regionkey AS label, s_nationkey AS nation, CAST((s_suppkey * 37) % 101 AS DOUBLE) + s_acctbal / 20000.0::DOUBLE AS x, s_acctbal / 100.0::DOUBLE AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "flagged_obs": "SELECT o.*, d.dataset FROM obs o CROSS JOIN (VALUES ('A'), ('N'), ('R')) d(dataset)",
    "features": "SELECT p_partkey AS feature_id, p_brand AS brand, p_type AS ptype, p_brand LIKE 'Brand#1%' AS mt FROM part",
    "dense_ref": "SELECT o.obs_id, o.label, o.x, o.y, f.feature_id, coalesce(c.value, 0) AS value FROM obs o CROSS JOIN features f LEFT JOIN ref c ON c.obs_id = o.obs_id AND c.feature_id = f.feature_id",
    "dense_cand": "SELECT o.obs_id, o.label, o.x, o.y, f.feature_id, coalesce(c.value, 0) AS value FROM obs o CROSS JOIN features f LEFT JOIN cand c ON c.obs_id = o.obs_id AND c.feature_id = f.feature_id",
    "dense": "SELECT o.obs_id, o.label, f.feature_id, coalesce(c.value, 0) AS value FROM obs o CROSS JOIN features f LEFT JOIN counts c ON c.obs_id = o.obs_id AND c.feature_id = f.feature_id",
    "cells_ab": "SELECT a.obs_id, a.label, a.feature_id, a.value AS a, b.value AS b FROM dense_ref a JOIN dense_cand b ON a.obs_id = b.obs_id AND a.feature_id = b.feature_id",
    "points": "SELECT vec_id AS obs_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label, CAST(vec_id % 2 AS INTEGER) AS batch, vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "place_counts": "SELECT obs_id, feature_id, value FROM (SELECT vec_id AS obs_id, CAST(i - 1 AS INTEGER) AS feature_id, CAST(greatest(0.0, round(CAST(embedding[i] AS DOUBLE) * 20.0::DOUBLE)) AS BIGINT) AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) WHERE value > 0",
    "dims": "SELECT DISTINCT CAST(unnest(range(0, len(embedding))) AS INTEGER) AS feature_id FROM embeddings",
    "dense_places": "SELECT o.obs_id, o.label, f.feature_id, coalesce(c.value, 0) AS value FROM points o CROSS JOIN dims f LEFT JOIN place_counts c ON c.obs_id = o.obs_id AND c.feature_id = f.feature_id",
    "comp": "SELECT spot, type, v / CAST(sum(v) OVER (PARTITION BY spot) AS DOUBLE) AS p FROM (SELECT o_custkey AS spot, o_orderpriority AS type, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)",
    "comp0": "SELECT spot, type, v / CAST(sum(v) OVER (PARTITION BY spot) AS DOUBLE) AS p FROM (SELECT o_custkey AS spot, o_orderpriority AS type, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)",
    "comp1": "SELECT spot, type, v / CAST(sum(v) OVER (PARTITION BY spot) AS DOUBLE) AS p FROM (SELECT o_custkey AS spot, o_orderpriority AS type, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)",
    "axis_obs": "SELECT event_id AS obs_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS z, event_type AS label, user_id % 20 AS feature_id, CAST(round(value * 100) AS BIGINT) AS value FROM events",
    "metric_wide": "SELECT label AS method, l_linenumber AS sample, round(avg(l_quantity), 9) AS quantity, round(avg(l_discount), 9) AS discount, round(avg(l_tax), 9) AS tax FROM lineitem JOIN obs ON obs_id = l_suppkey GROUP BY 1, 2",
    "metric_long": "SELECT method, sample, metric, value FROM metric_wide UNPIVOT (value FOR metric IN (quantity, discount, tax))",
    # brute-force neighbours of the 2-D points and of the vectors
    "knn6": "SELECT src, dst, rank, d2 FROM (SELECT a.obs_id AS src, b.obs_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, row_number() OVER (PARTITION BY a.obs_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.obs_id) AS rank FROM points a JOIN points b ON a.obs_id <> b.obs_id) WHERE rank <= 6",
    "knn5": "SELECT * FROM knn6 WHERE rank <= 5",
    "vdist": "SELECT a.obs_id AS src, b.obs_id AS dst, a.label AS la, b.label AS lb, a.batch AS ba, b.batch AS bb, list_distance(a.vec, b.vec) AS d FROM points a CROSS JOIN points b",
    "vknn10": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM vdist WHERE src <> dst) WHERE rank <= 10",
}

_NAME = re.compile(r"[a-z_0-9]+")


def sql(body: str, d: str = "", i: str = "", extra: dict[str, str] | None = None) -> str:
    """Prefix the roles that ``body`` uses; ``d`` / ``i`` name double and integer columns."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in known and name not in open_:
                open_.add(name)
                visit(known[name])
                order.append(name)

    visit(body)
    with_ = "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else ""
    repl = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in d.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    if not repl:
        return with_ + body
    return f"{with_}SELECT * REPLACE ({', '.join(repl)}) FROM ({body}) AS result"


def pear(x: str, y: str, where: str = "") -> str:
    """Guarded Pearson over non-NULL pairs as a SQL aggregate."""
    f = f" FILTER (WHERE {where})" if where else ""
    return (
        f"CASE WHEN count(*){f} >= 2 AND stddev_pop({x}){f} > 1e-9 * (1e-9 + abs(avg({x}){f})) AND stddev_pop({y}){f} > 1e-9 * (1e-9 + abs(avg({y}){f})) "
        f"THEN corr({x}, {y}){f} END"
    )
