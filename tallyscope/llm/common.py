"""Small pieces that several of these operators use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word separators of the contracts are space and tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def fold(text_id: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus`` (the folds of the contracts)."""
    return F.pmod(F.crc32(F.coalesce(text_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra columns of the caller cannot clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with marks behind it, so that no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for the jobs run inside; the session's setting comes back afterwards.

    Rows that hold long arrays would otherwise fill a Python worker with
    thousands of them at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
