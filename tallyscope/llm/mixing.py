"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

A budget of equal-sized token blocks is awarded to the sources one by one, the
next block always to the source with the highest quotient target / (2 n + 1).
The n-th award belongs to the shard that n falls into, so every shard has whole
quotas, the shards have equally many blocks (within one), and the quotas of the
first shards together are the apportionment of their joint budget.

The awards are not simulated: two divisors enclose the one that awards ``n``
blocks, what the larger divisor awards is certain, and only the at most two per
source in between are ranked.

A source's documents stand on a line in seeded order, cut into equal blocks.
Its quota takes whole passes over the line, then a run of blocks from a seeded
block on, so few documents are cut.  Positions on the line come from sums per
hash bucket, so no source is ever ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import WORD

BLOCK_WORDS = 16
SHARDS = 16
REPEATS = 3
ROWS_PER_BUCKET = 2048


def source_targets(sizes: DataFrame, weight: Column, repeats: int = REPEATS) -> DataFrame:
    """Per source its weight and target in words.

    ``sizes(source, source_size)`` has one row per source, a dimension of the
    corpus: only this table is ordered as a whole.  ``weight`` may use ``_rank``,
    the source's 0-based place by code point with NULL last.  The weights share
    all words; no target exceeds ``repeats`` times its source, and what is over
    is shared among the rest by weight (water filling: sources are filled in the
    order of capacity per weight).
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("*", weight.cast("double").alias("weight"), (F.col("source_size") * repeats).alias("_cap"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    every = Window.partitionBy()
    level = (F.col("_total") - F.coalesce("_filled", F.lit(0))) / F.col("_open")
    water = ranked.select(
        "*",
        F.row_number().over(by_fill).alias("_place"),
        F.sum("source_size").over(every).alias("_total"),
        F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)).alias("_filled"),
        F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_open"),
    ).withColumn("_level", level)
    first = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.struct("_place", "_level"))).over(every)
    return water.select(
        "source", "source_size", "_rank", "weight", "_total",
        F.least(F.col("_cap").cast("double"), F.coalesce(first["_level"], F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def shard_quotas(targets: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(source, shard, upto): blocks of the source in the shards 0 to ``shard`` together."""
    every = Window.partitionBy()
    t = targets.select(
        "source", "_rank", F.count(F.lit(1)).over(every).alias("_m"),
        F.when(F.col("_total") > 0, F.col("target") / F.col("_total")).otherwise(F.lit(0.0)).alias("_share"),
        F.round(F.col("_total") / block).cast("long").alias("_blocks"),
    )
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    t = t.withColumn("_n", F.floor(F.col("_blocks") * (F.col("shard") + 1) / shards).cast("long"))
    seats = lambda x: F.floor(F.col("_share") * x + 0.5).cast("long")
    t = t.select("*", seats(F.greatest(F.col("_n") - F.col("_m") / 2, F.lit(0.0))).alias("_sure"), seats(F.col("_n") + F.col("_m") / 2).alias("_most"))
    t = checkpointed(t)
    open_ = t.where("_most > _sure").select("source", "_rank", "shard", "_share", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat"))
    left = t.groupBy("shard").agg((F.max("_n") - F.sum("_sure")).alias("_left"))
    order = Window.partitionBy("shard").orderBy((F.col("_share") / (2 * F.col("_seat") - 1)).desc(), "_rank", "_seat")
    won = open_.withColumn("_place", F.row_number().over(order)).join(left, "shard").where("_place <= _left")
    more = won.groupBy("_rank", "shard").agg(F.count(F.lit(1)).alias("_more"))
    return t.join(more, ["_rank", "shard"], "left").select("source", "_rank", "shard", (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("upto"))


def _overlap(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi, end) - F.greatest(lo, start))


def mix_sources(
    docs: DataFrame, weight: Column, seed: int = 7, block: int = BLOCK_WORDS, shards: int = SHARDS, repeats: int = REPEATS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_rows: bool = False,
) -> DataFrame:
    """How much of each document the mix takes.

    One row per row of ``docs``: doc_id, source, size (words; NULL text: 0),
    source_size, target (words of its source), passes (whole passes over the
    document), run_start and run_words (the words from ``run_start`` on, counted
    in the document and wrapping round at its end, that the last, partial pass
    takes), taken = passes * size + run_words, blocks (quota of the source) and
    key (a hash of seed, id and text).  ``with_rows`` adds the whole row of
    ``docs`` as a struct.

    Rows with equal id and text are interchangeable.  NULL ids and sources are
    values like others.  An empty table gives an empty result.  Reruns agree:
    order and run are hashes of seed, id, text and source.
    """
    ident, text, source = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    measured = docs.select(
        ident.alias("doc_id"), source.alias("source"),
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("_sk"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), ident.cast("string"), text).alias("key"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []),
    )
    sized = checkpointed(measured.select("doc_id", "source", "_sk", "size", "key"))
    buckets = max(256, math.ceil(sized.count() / ROWS_PER_BUCKET))
    bucket = F.pmod("key", F.lit(buckets)).alias("_bucket")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(per_source, weight, repeats))
    quotas = shard_quotas(targets, block, shards).where(F.col("shard") == shards - 1)
    plan = targets.join(quotas.select("_rank", "upto"), "_rank").select(
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("_sk"),
        "source", "source_size", "target", F.ceil(F.col("source_size") / block).alias("_line"), F.col("upto").alias("_quota"),
    )
    plan = plan.withColumn("blocks", F.least("_quota", F.col("_line") * repeats))
    some = F.col("_line") > 0
    plan = plan.select(
        "*", F.when(some, F.floor(F.col("blocks") / F.col("_line"))).otherwise(F.lit(0)).cast("long").alias("passes"),
        F.when(some, F.pmod(F.xxhash64(F.lit(seed), "source"), "_line")).otherwise(F.lit(0)).alias("_first"),
    )
    last = F.col("_first") + F.col("blocks") - F.col("passes") * F.col("_line")
    plan = plan.select(
        "_sk", "source_size", "target", "blocks", "passes", (F.col("_first") * block).alias("_lo"),
        (F.least(last, F.col("_line")) * block).alias("_hi"), (F.greatest(last - F.col("_line"), F.lit(0)) * block).alias("_wrap"),
    )
    sums = sized.groupBy("_sk", bucket).agg(F.sum("size").alias("_sum"))
    across = Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_sk", "_bucket", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset")).join(plan, "_sk")
    offsets = checkpointed(offsets)

    rows = measured if with_rows else sized
    inside = Window.partitionBy("_sk", "_bucket").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_bucket", bucket).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = placed.join(offsets, ["_sk", "_bucket"]).withColumn("_start", F.col("_before") + F.col("_offset"))
    at = at.withColumn("_end", F.col("_start") + F.col("size"))
    at = at.withColumn("_late", _overlap(F.col("_lo"), F.least("_hi", "source_size"), F.col("_start"), F.col("_end")))
    at = at.withColumn("_early", _overlap(F.lit(0), F.col("_wrap"), F.col("_start"), F.col("_end")))
    return at.select(
        "doc_id", "source", "size", "source_size", "target", "passes",
        F.when(F.col("_late") > 0, F.greatest(F.col("_lo") - F.col("_start"), F.lit(0))).otherwise(F.lit(0)).alias("run_start"),
        (F.col("_late") + F.col("_early")).alias("run_words"),
        (F.col("passes") * F.col("size") + F.col("_late") + F.col("_early")).alias("taken"), "blocks", "key",
        *(["row"] if with_rows else []),
    )


def mixed_documents(docs: DataFrame, weight: Column, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: ``docs`` with every row as often as the mix takes it.

    Whole passes give whole copies; a document at an end of its source's run is
    cut to the words taken, with the blanks behind them.  Texts without words
    weigh nothing and stay as they are.
    """
    mixed = mix_sources(docs, weight, seed, id_col=id_col, text_col=text_col, source_col=source_col, with_rows=True)
    text = F.col("row").getField(text_col)
    words = F.filter(F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])"), lambda w: w.rlike(WORD))
    first = F.least(F.col("size") - F.col("run_start"), F.col("run_words"))
    piece = F.concat(
        F.slice(words, (F.col("run_start") + 1).cast("int"), first.cast("int")), F.slice(words, F.lit(1), (F.col("run_words") - first).cast("int"))
    )
    run = F.when(F.col("run_words") == 0, F.array().cast("array<string>")).when(F.col("run_words") == F.col("size"), F.array(text)).otherwise(F.array(F.array_join(piece, "")))
    texts = F.when(F.col("size") == 0, F.array(text)).otherwise(F.concat(F.array_repeat(text, F.col("passes").cast("int")), run))
    out = mixed.select("row", F.explode(texts).alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def cyclic_weight(weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The weights in turn by the source's rank, from the first again after the last."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
