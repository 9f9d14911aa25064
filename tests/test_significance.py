"""Significance of enrichment: what is normalised twice must meet itself."""

import random

from pyspark.sql import functions as F

from tallyscope.operators import enrich


def test_means_of_the_null_are_computed_once(spark, monkeypatch):
    """Sums depend in their last digits on the order in which rows arrive; here each reading of the null differs there."""
    keep, unsteady = enrich.checkpointed, F.udf(lambda v: v * (1 + 1e-12 * random.random()), "double").asNondeterministic()
    monkeypatch.setattr(enrich, "checkpointed", lambda df: keep(df).withColumn("null_es", unsteady("null_es")) if "null_es" in df.columns else keep(df))
    scores = spark.createDataFrame([(f"t{i}", 20, 0.3 + i / 50) for i in range(10)], "term string, n_hits long, es double")
    null = spark.createDataFrame([(20, i, 0.1 + i / 100) for i in range(60)], "n_hits long, permutation int, null_es double")
    rows = enrich.enrichment_significance(scores, null, []).collect()
    assert len(rows) == 10 and all(r.fdr_q is not None for r in rows)
