"""Slices of the blueprint query: filled, bounded and complete, whatever the keys are."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from catalog import files
from tallyscope.sources import readers


@pytest.mark.parametrize("spots", [1024, 16])
def test_slices_are_filled_and_bounded(spark, monkeypatch, spots, tmp_path):
    # one row to a supplier and an order to a thousand, as in a large table
    wide = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_suppkey", F.monotonically_increasing_id()).withColumn("l_orderkey", F.col("l_suppkey") * 1000)
    wide.write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    monkeypatch.setattr(files, "SLICE_SPOTS", spots)
    monkeypatch.setattr(readers, "read_blueprint", lambda s, path: written.append(s.read.schema(readers.BLUEPRINT_SCHEMA).json(path)) or readers.explode_blueprint(written[0]))
    got = queries()["io8_read_blueprint"](spark, str(tmp_path)).select("age", "j", "i", "k", "region").collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in wide.select("l_returnflag", "l_linenumber", F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int"), "l_linestatus").collect())
    sizes = [r[0] for r in written[0].select(F.explode("slices").alias("s")).select(F.size("s.voxel_i")).collect()]
    assert len(sizes) <= files.AGES_AND_LINES * (-(-len(got) // (files.AGES_AND_LINES * spots)) or 1)
    assert max(sizes) < 8 * spots
