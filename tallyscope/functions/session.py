"""Session helpers: settings for local runs and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Aggregations and windows over (label, feature) must not inherit a partitioning by
# label alone from a join before them: a label may hold a third of all rows.
SKEW_SETTINGS = {
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_OWN: list[str] = []


def guard_against_skew(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on; safe to repeat."""
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tallyscope", memory: str = "8g") -> SparkSession:
    n = os.cpu_count() if cores == "*" else int(cores)
    return guard_against_skew(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# partitions of a table of cells
SPREAD = 256


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows dealt by all ``keys`` to many partitions that are not merged again.

    Adaptive execution merges partitions by their compressed bytes; an
    aggregation with a row per cell needs some thirty times as much memory.
    """
    return df.repartition(max(SPREAD, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where driver and executors are one process, and no folder is set, is a
    temporary one made; it goes when the process ends.  On a cluster without the
    setting this fails, since executors could not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written once as a table in the shared folder and read back.

    That cuts the lineage, survives lost executors, runs the plan once
    (``Dataset.checkpoint`` runs its last stage twice) and tells the planner the
    true size.  The files stay in the checkpoint folder until it is cleared.
    """
    path = scratch_path(df.sparkSession, "frame")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
