"""The additive statistics as streaming queries.

Feature sums, row sums and label counts are sums, so the batch operators run
unchanged on a stream in complete mode; dividing by the dense cardinality is
left to the reader of the running table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Feed everything available to ``sink`` batch by batch; restarts resume at the checkpoint."""
    return (
        df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
