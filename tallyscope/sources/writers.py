"""Sinks: all-or-nothing writes, manifests, append-only metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
    """Write through the job committer; an existing target is refused unless asked.

    Files become visible only when the whole job has succeeded.
    """
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_manifest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "arrival") -> DataFrame:
    """Union of manifests keeping the last arrival per key.

    ``order`` numbers the rows of each side; new rows come after all old ones.  Of
    rows with the same number the one with the smallest other columns stays, in
    their order and NULL last, so that ties have one result.  Tasks keep one row of a key
    before the shuffle, so a key with many versions is no burden.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_side")]
    ties = [F.asc_nulls_last(c) for c in rest if c != order]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc(order), *ties))
    return both.withColumn("_r", last).where("_r = 1").select(*keys, *rest)


def append_metrics(df: DataFrame, path: str, job: str = "job_id") -> None:
    """Add the rows of one or more jobs to a table partitioned by job."""
    df.write.mode("append").partitionBy(job).parquet(path)
