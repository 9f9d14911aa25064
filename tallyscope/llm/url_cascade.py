"""Exact URL list membership by a cascade of Bloom filters.

Level 1 encodes the listed keys.  Level 2 encodes the unlisted keys of the
universe that level 1 lets through, level 3 the listed keys that level 2 lets
through, and so on until nothing is let through wrongly.  For every key of the
universe the parity of the first level that rejects it is then its exact
membership: probing needs the bits alone, no join with the list.

Everything is built from DataFrame functions.  Bits are aggregated to 64-bit
words on the executors; a level is a one-row table of words that a probe reads
as a scalar subquery.  One part of the key space holds at most ``keys_per_part``
listed keys, which bounds the words of all levels together to about
``keys_per_part`` * 16 bits (8 MB at the default); longer lists are cut by key
hash into more parts, and each part is probed by the rows whose key falls there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import ascii_lower, fields

KEYS_PER_PART = 4_000_000
LATER_RATE = 1 / 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host with its subdomains below a path prefix."""

    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule of a short policy list and its action, NULL where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: DataFrame

    def passes(self, key: Column) -> Column:
        """Whether every bit of the key is set."""
        words, out = self.words.scalar(), F.lit(True)
        for j in range(self.hashes):
            at = _position(key, self.number, j, self.bits)
            out = out & (F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out


def _position(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits).cast("long"))


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """One filter over ``keys(key)`` with the given false-positive rate."""
    bits = max(64, 64 * math.ceil(count * math.log(1 / rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(math.log2(1 / rate)))
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), number, j, bits) for j in range(hashes)])).alias("_at"))
    filled = at.groupBy(F.shiftright("_at", 6).alias("_w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_at", F.lit(64)).cast("int"))).alias("_bits")
    )
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("_w"))
    dense = every.join(filled, "_w", "left").select("_w", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"))
    row = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("_w", "_bits"))), lambda x: x["_bits"]).alias("words"))
    return Level(number, bits, hashes, checkpointed(row))


def build_cascade(universe: DataFrame, later_rate: float = LATER_RATE, max_levels: int = 64) -> list[Level]:
    """The levels for ``universe(key, listed)``, one row per key.

    No listed key gives no level.  The first rate follows from the share of
    listed keys; each later level keeps ``later_rate`` of what it tests.
    """
    sizes = universe.agg(F.count_if("listed").alias("r"), F.count_if(~F.col("listed")).alias("s")).first()
    count, tested = sizes["r"], sizes["s"]
    encoded, other, levels = F.col("listed"), ~F.col("listed"), []
    rate = min(0.5, math.sqrt(0.5) * count / tested) if count and tested else 0.5
    while count:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade did not close; is a key listed and unlisted at once?")
        level = _level(universe.where(encoded).select("key"), len(levels) + 1, count, rate)
        levels.append(level)
        wrong = other & level.passes(F.col("key"))
        count, rate = universe.where(wrong).count(), later_rate
        encoded, other = wrong, encoded
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """Exact membership of a universe key: the parity of the first level that rejects it."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(levels[i - 1].passes(key), out).otherwise(F.lit(i % 2 == 0))
    return out


def with_membership(rows: DataFrame, key: str, universe: DataFrame, name: str = "listed", keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """``rows`` with a boolean column: is the key among the listed keys of ``universe(key, listed)``.

    Every non-NULL key of ``rows`` must be in the universe; NULL keys are not
    listed.  Extra columns of ``rows`` are kept.
    """
    universe = checkpointed(universe.select(F.col("key"), F.coalesce("listed", F.lit(False)).alias("listed")).where("key is not null"))
    parts = max(1, math.ceil(universe.where("listed").count() / keys_per_part))
    probe, out = F.coalesce(F.col(f"`{key}`"), F.lit("")), None
    for p in range(parts):
        mine = lambda c: F.pmod(F.xxhash64(F.lit("part"), c), F.lit(parts)) == p  # noqa: B023, E731
        levels = build_cascade(universe.where(mine(F.col("key"))) if parts > 1 else universe)
        found = (rows.where(mine(probe)) if parts > 1 else rows).withColumn(name, F.col(f"`{key}`").isNotNull() & is_listed(levels, probe))
        out = found if out is None else out.unionByName(found)
    return out


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], listed_share: float = 0.5, id_col: str = "page_id", url_col: str = "url",
    keys_per_part: int = KEYS_PER_PART,
) -> DataFrame:
    """(id, host, path, rule, verdict) per page.

    The longest fitting rule decides.  Where none fits, the list does, of which
    the page or its host may be a key: listed are the pages (host and path) that
    the rules block, and the hosts of which they block at least ``listed_share``
    of the pages.  One cascade holds the page keys, another the host keys; their
    universes are all pages and all hosts of the corpus.  A NULL url, or one
    without ``://``, has empty host and path, fits no rule and is allowed.
    Repeated rows give repeated results.
    """
    url = F.col(f"`{url_col}`")
    parsed = pages.select(F.col(f"`{id_col}`"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parsed.select("*", rule.alias("rule"), action.alias("_action"))
    hosts = judged.groupBy(F.col("host").alias("key")).agg(
        F.count_if(F.col("_action") == "block").alias("_blocked"), F.count(F.lit(1)).alias("_pages")
    )
    hosts = hosts.select("key", ((F.col("_blocked") > 0) & (F.col("_blocked") >= listed_share * F.col("_pages"))).alias("listed"))
    # a host holds no slash and a path begins with one, so the two together are unique
    page = F.concat("host", "path")
    paths = judged.groupBy(page.alias("key")).agg(F.coalesce(F.bool_or(F.col("_action") == "block"), F.lit(False)).alias("listed"))
    known = with_membership(judged.withColumn("_page", page), "_page", paths, "_page_listed", keys_per_part)
    known = with_membership(known, "host", hosts, "_host_listed", keys_per_part)
    on_list = F.col("_page_listed") | F.col("_host_listed")
    verdict = F.coalesce("_action", F.when(on_list, F.lit("block")).otherwise(F.lit("allow")))
    return fields(known.withColumn("verdict", verdict), id_col, "host", "path", "rule", "verdict")
