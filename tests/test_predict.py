"""Predictions from label means: the rows of a plain join, made by many tasks."""

import importlib
import itertools
import re

from pyspark.sql import functions as F

from tallyscope.operators import transform


def test_one_label_is_predicted_by_many_tasks(spark):
    model = spark.createDataFrame([("a", i, i / 7) for i in range(200)], "label string, feature_id long, prediction double")
    target = spark.createDataFrame([*[(i, "a") for i in range(50)], (None, "a"), (90, "b"), (91, None)], "obs_id long, label string")
    out = transform.predict(model, target, list_rows=8)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, target.join(model, "label").select(*out.columns).collect()), key=str)
    assert out.count() == 51 * 200
    assert len({r[0] for r in out.select(F.spark_partition_id()).collect()}) >= 8


def test_a_list_of_observations_meets_its_features_in_a_row(spark):
    model = spark.createDataFrame([("a", i, i / 7) for i in range(200)], "label string, feature_id long, prediction double")
    target = spark.createDataFrame([(i, "a") for i in range(64)], "obs_id long, label string")
    rows = transform.predict(model, target, list_rows=8, shares=4).withColumn("_p", F.spark_partition_id()).collect()
    lists = [[r.obs_id for r in run] for _, run in itertools.groupby(rows, lambda r: (r._p, r.feature_id))]
    # a written task holds short lists that repeat, not all observations feature by feature
    assert max(map(len, lists)) < 64
    assert sum(a != b for a, b in zip(lists, lists[1:], strict=False)) < 4 * 64
    assert len(rows) == 64 * 200


def test_label_means_are_rounded_before_the_join(spark):
    entry = importlib.import_module("__spark_entry__")
    plan = entry.queries()["tr7_predict_label_means"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the plan is printed from the result down
    assert re.search(r"round\(", plan) and plan.index("Generate") < plan.index("round(")
