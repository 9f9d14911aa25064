"""A bounded, repeatable sample of labelled rows, as classifiers take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000


def training_rows(labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label double) of at most ``rows`` labelled ids for which ``usable`` holds.

    An id labelled more than once counts as positive if any label is.  NULL ids
    and labels are left out.  The ids are taken in the order of their hash, so a
    rerun takes the same ones.  The result is small enough to be broadcast: its
    size is bounded by ``rows``.
    """
    per_id = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(usable)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    return per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
