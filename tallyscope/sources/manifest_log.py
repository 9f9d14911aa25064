"""A manifest as a log of appends.

Every append writes files of its own under a batch number that nobody else has,
and then a commit marker of its own.  Readers take the last committed version of
each key; rows without a marker do not exist.  Two writers never touch the same
folder, so none can lose the other's rows.  Compaction is one more batch whose
marker also names the batches it stands for.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed

MARKER = "at long, replaces string"


def _put(df: DataFrame, path: str) -> str:
    batch = f"b{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/rows/_batch={batch}")
    return batch


def _commit(spark: SparkSession, path: str, batch: str, markers: DataFrame) -> None:
    markers.coalesce(1).write.parquet(f"{path}/commits/_batch={batch}")


def append(df: DataFrame, path: str, at: int | None = None) -> str:
    """Add the rows of ``df`` as one batch and return its number.

    ``at`` orders the batches; by default it is the writer's clock in
    microseconds.  A batch becomes visible as a whole with its marker.  Columns
    may differ between batches; an empty ``df`` is a batch without rows.  Columns
    beginning with an underscore are refused, since the log uses them.
    """
    own = [c for c in df.columns if c.startswith("_")]
    if own:
        raise ValueError(f"column names of the log itself: {own}")
    spark = df.sparkSession
    batch = _put(df, path)
    when = time.time_ns() // 1000 if at is None else at
    _commit(spark, path, batch, spark.range(1).select(F.lit(when).cast("long").alias("at"), F.lit(None).cast("string").alias("replaces")))
    return batch


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(_batch, _committed): the committed batches that no compaction stands for."""
    marks = spark.read.schema(f"{MARKER}, _batch string").parquet(f"{path}/commits")
    own = marks.where(F.col("replaces").isNull()).select("_batch", F.col("at").alias("_committed"))
    return own.join(marks.where(F.col("replaces").isNotNull()).select(F.col("replaces").alias("_batch")), "_batch", "left_anti")


def _last(spark: SparkSession, path: str, keys: Sequence[str], order: str | None, live: DataFrame) -> DataFrame:
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/rows").withColumn("_batch", F.col("_batch").cast("string"))
    for name, kind in (("_first_at", "long"), ("_first_batch", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    seen = rows.join(live, "_batch").withColumns({
        "_first_at": F.coalesce("_first_at", "_committed"), "_first_batch": F.coalesce("_first_batch", "_batch"),
    }).drop("_batch", "_committed")
    rest = [c for c in seen.columns if c not in keys]
    version = F.struct("_first_at", "_first_batch", *([order] if order else []), *[c for c in rest if c not in ("_first_at", "_first_batch", order)])
    return seen.groupBy(*keys).agg(F.max(version).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def current(spark: SparkSession, path: str, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The last committed version of every key.

    Later batches win; within a batch the largest ``order`` does, then the
    largest other columns, so that ties have one result.  NULL is a key like
    others.  A path without any commit is an error.  A reduction per key that
    combines before the shuffle, so a key with very many versions is no burden.
    """
    return _last(spark, path, keys, order, commits(spark, path)).drop("_first_at", "_first_batch")


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: str | None = None) -> str:
    """Write the current state as one batch that stands for all batches it was read from.

    Rows keep the place of their first commit, so batches that were committed
    meanwhile, or that carry an earlier ``at``, still win or lose as before.
    """
    live = checkpointed(commits(spark, path))
    batch = _put(_last(spark, path, keys, order, live), path)
    when = F.lit(time.time_ns() // 1000).cast("long").alias("at")
    stands_for = live.select(when, F.col("_batch").alias("replaces"))
    _commit(spark, path, batch, stands_for.unionByName(spark.range(1).select(when, F.lit(None).cast("string").alias("replaces"))))
    return batch
