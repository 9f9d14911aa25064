"""Named queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.session import guard_against_skew

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that both engines print the same figure."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None, is_rounded: bool = False):
    """Registers a query; ``is_rounded`` says that it has put its doubles through ``rounded`` where they were fewer."""
    def keep(fn):
        from catalog.tables import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(guard_against_skew(spark), sf_dir))
            return df if is_rounded else rounded(df)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep
