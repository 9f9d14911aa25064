"""Benchmark decontamination with a distributed positional inverted index.

``build_postings`` stores where the words of the test items stand in the
training texts: one row (term, row, pos) per token, written without a shuffle and
sorted by term inside every file, so that a list of a rare term is read without
its neighbours.  Words that no item holds cannot take part in a match and are
left out.

A phrase is met by intersecting lists after their offsets are taken off: a word
at place p of an item and at place x of a text puts the item at x - p.  Each
window of an item starts from the list of its rarest word; what is left meets
the list of the second rarest, and only placements that stand both are held
against the other words.  Runs of agreeing words that are as long as a window are
the exact matches.

All of it is DataFrame functions.  Lists are joined on (term, row, pos), so
neither a frequent word nor a passage that a third of all texts share comes
together in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import ascii_lower

WINDOW = 10
# Fixed value: what stands between words once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# No word is empty: this list holds one entry per text, with its id and number of words.
TEXTS = ""


def words_of(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


@dataclass(frozen=True)
class Postings:
    """``lists(term, row, pos, id, n_words)``, of which ``id`` and ``n_words`` are set in the list ``TEXTS`` alone;
    ``items(item, item_id, n, p, term, freq)``: the words of the items with their frequency in the texts."""

    lists: DataFrame
    items: DataFrame

    @property
    def texts(self) -> DataFrame:
        return self.lists.where(F.col("term") == TEXTS).select("row", "id", "n_words")

    @property
    def words(self) -> DataFrame:
        return self.lists.where(F.col("term") != TEXTS).select("term", "row", "pos")


def build_postings(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Postings:
    """The index of all rows of ``docs`` for the words of ``items``.

    Every row is a text of its own, repeated ones too, and a NULL or empty text
    has no words.  Items repeated in id and text count once; items without an id
    or without words take no part.  Empty tables give empty lists.  Other
    columns are not looked at.
    """
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), words_of(F.col(f"`{item_text_col}`").cast("string")).alias("words"))
    asked = asked.where(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct().withColumn("item", F.monotonically_increasing_id())
    asked = checkpointed(asked.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "term")))
    vocabulary = checkpointed(asked.select("term").union(asked.sparkSession.createDataFrame([(TEXTS,)], "term string")).distinct())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    tokens = rows.select("row", "id", "n_words", F.posexplode(F.concat(F.array(F.lit(TEXTS)), F.col("words"))).alias("pos", "term"))
    kept = tokens.join(vocabulary, "term", "left_semi")
    own = F.col("term") == TEXTS
    lists = checkpointed(
        kept.select("term", "row", (F.col("pos") - 1).alias("pos"), F.when(own, F.col("id")).alias("id"), F.when(own, F.col("n_words")).alias("n_words"))
        .sortWithinPartitions("term", "row", "pos")
    )
    freq = lists.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    return Postings(lists, checkpointed(asked.join(freq, "term", "left").select("item", "item_id", "n", "p", "term", F.coalesce("freq", F.lit(0)).alias("freq"))))


def rarest_pairs(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, s, size, p1, t1, p2, t2): each window's rarest and second rarest word, without windows that hold a word no text has.

    An item with fewer words than a window is one window; a window of one word
    has no second.
    """
    size = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - size + 1), F.least(F.col("p"), F.col("n") - size))
    inside = items.select("item", size.alias("size"), F.explode(starts).alias("s"), F.struct("freq", "p", "term").alias("w"))
    # a window holds ``window`` words at most
    by_window = inside.groupBy("item", "s", "size").agg(F.sort_array(F.collect_list("w")).alias("w")).where(F.col("w")[0]["freq"] > 0)
    second = F.when(F.size("w") > 1, F.element_at("w", F.least(F.lit(2), F.size("w"))))
    return by_window.select(
        "item", "s", "size", F.col("w")[0]["p"].alias("p1"), F.col("w")[0]["term"].alias("t1"), second["p"].alias("p2"), second["term"].alias("t2")
    )


def intersect(postings: Postings, pairs: DataFrame) -> DataFrame:
    """(row, item, shift, p1, p2): placements at which a text holds the rarest and the second rarest word of a window."""
    words = postings.words
    two = pairs.select("item", "p1", "t1", "p2", "t2").distinct()
    started = checkpointed(
        words.join(two.withColumnRenamed("t1", "term"), "term").select("row", "item", (F.col("pos") - F.col("p1")).alias("shift"), "p1", "p2", "t2")
    )
    next_lists = words.join(two.select(F.col("t2").alias("term")).distinct(), "term", "left_semi")
    met = started.withColumn("pos", F.col("shift") + F.col("p2")).withColumnRenamed("t2", "term").join(next_lists, ["term", "row", "pos"], "left_semi")
    alone = started.where("p2 is null")
    return met.select("row", "item", "shift", "p1", "p2").unionByName(alone.select("row", "item", "shift", "p1", "p2"))


def phrase_matches(postings: Postings, window: int = WINDOW) -> DataFrame:
    """(row, item_id, start, stop): all runs of words of a text that agree with an item and hold a whole window.

    ``stop`` is the place behind the last word.  Runs of one placement do not
    touch; those of different placements may overlap.
    """
    pairs = checkpointed(rarest_pairs(postings.items, window))
    placed = intersect(postings, pairs)
    windows = pairs.select("item", "p1", F.col("p2").alias("_p2"), "s", "size")
    standing = placed.join(windows, ["item", "p1"]).where(F.col("p2").eqNullSafe(F.col("_p2")))
    places = standing.select("row", "item", "shift", "size", F.explode(F.sequence("s", F.col("s") + F.col("size") - 1)).alias("p")).distinct()
    needed = checkpointed(
        places.join(postings.items.select("item", "p", "term", "item_id"), ["item", "p"]).select("row", "item", "item_id", "shift", "size", "p", "term", (F.col("shift") + F.col("p")).alias("pos"))
    )
    # the words of items only: written, so that its true size decides how it is joined
    wanted = checkpointed(needed.select("term").distinct())
    lists = postings.words.join(wanted, "term", "left_semi")
    agreed = needed.join(lists, ["term", "row", "pos"], "left_semi")
    # a placement has no more rows than its item has words
    run = F.col("p") - F.row_number().over(Window.partitionBy("row", "item", "shift").orderBy("p"))
    spans = agreed.withColumn("_run", run).groupBy("row", "item", "item_id", "shift", "size", "_run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("_n"))
    return spans.where("_n >= size").select("row", "item_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("_n")).alias("stop"))


def proximity_matches(postings: Postings, span: int) -> DataFrame:
    """(row, id, item_id, pos): occurrences of an item's rarest word with all its other words inside some ``span`` words around it.

    Order and repeats of an item's words do not count.  Items with more
    distinct words than ``span`` match nothing.
    """
    terms = postings.items.groupBy("item", "item_id", "term").agg(F.first("freq").alias("freq"))
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("freq", "term"))["term"].alias("rarest"), F.min("freq").alias("least"))
    terms = checkpointed(terms.join(sizes.where((F.col("k") <= span) & (F.col("least") > 0)), "item"))
    words = postings.words
    anchors = terms.where("term = rarest").select("item", "item_id", "k", "term")
    found = checkpointed(words.join(anchors, "term").select("row", "item", "item_id", "k", F.col("pos").alias("at")))
    bucket = F.floor(F.col("at") / span)
    wanted = found.join(terms.where("term <> rarest").select("item", "term"), "item")
    wanted = wanted.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = wanted.join(words.withColumn("_b", F.floor(F.col("pos") / span)), ["row", "term", "_b"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    # fewer than two spans of places for each occurrence
    around = near.groupBy("row", "item", "at").agg(F.collect_list(F.struct("pos", "term")).alias("w"))
    placed = found.join(around, ["row", "item", "at"], "left")

    def held(start: Column) -> Column:
        inside = F.filter("w", lambda x: (x["pos"] >= start) & (x["pos"] < start + span))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["term"]))) == F.col("k") - 1

    whole = (F.col("k") == 1) | F.coalesce(F.exists(F.sequence(F.col("at") - span + 1, F.col("at")), held), F.lit(False))
    return placed.where(whole).join(postings.texts.select("row", "id"), "row").select("row", "id", "item_id", F.col("at").cast("long").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``window``
    consecutive words of an item (all its words, where it has fewer).  A text
    without words has no hits; repeated rows give repeated results; rows and
    items are taken as ``build_postings`` does.
    """
    postings = build_postings(docs, items, id_col, text_col, item_col, item_text_col)
    spans = checkpointed(phrase_matches(postings, window))
    hit = spans.select("row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    found = spans.select("row", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("listed")
    )
    known = checkpointed(hit.join(found, "row"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return postings.texts.join(known, "row", "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
