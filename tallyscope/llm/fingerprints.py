"""Bottom-k sketches of shingle hashes as document fingerprints.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's five-word shingles.  Sketches of parts merge to the sketch of the whole,
and two sketches estimate resemblance, containment and numbers of distinct
shingles.  With fewer than k distinct shingles every estimate is exact.

Everything is column expressions on arrays inside one row; no shingle is ever
shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import word_list

SKETCH = 64
WORDS = 5


def with_sketch(df: DataFrame, text: Column, name: str, k: int = SKETCH, words: int = WORDS) -> DataFrame:
    """Adds the sketch of a text.

    Words are runs of other characters than space and tab to carriage return.
    A text of fewer words than a shingle is one shingle; a text without words,
    and NULL, has an empty sketch.
    """
    w, h = f"_{name}_words", f"_{name}_hashes"
    hashed = df.withColumn(w, F.transform(word_list(text), lambda x: F.xxhash64(x)))
    n = F.size(w)
    many = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(*[F.element_at(F.col(w), i + j) for j in range(words)]))
    hashed = hashed.withColumn(h, F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(F.lit(0), F.col(w)))).otherwise(F.array().cast("array<bigint>")))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(h)), 1, k)).drop(w, h)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, by: Sequence[str], sketch: str, k: int = SKETCH) -> DataFrame:
    """(by…, sketch) over all rows of a group; only k hashes per group and task are shuffled."""
    hashes = df.select(*by, F.explode(sketch).alias("_h")).distinct()
    order = Window.partitionBy(*by).orderBy("_h")
    low = hashes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    low = merged(a, b, k)
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.size(low))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles behind a sketch."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has; NULL for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """A sketch as hex digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def successors(keys: DataFrame) -> DataFrame:
    """(id, k, h, n, next_k, next_h): each distinct key's successor by (id, h), the last one's being the first.

    ``keys(id, k, h, n)`` is dealt by ranges and written, so a range and its
    number belong together; within ranges a window finds the successor, between
    them a table of one row per range.
    """
    ranged = checkpointed(keys.repartitionByRange("id", "h", "k").select("*", F.spark_partition_id().alias("_p")))
    inside = Window.partitionBy("_p").orderBy("id", "h", "k")
    led = ranged.select("*", F.lead("k").over(inside).alias("next_k"), F.lead("h").over(inside).alias("next_h"))
    first = ranged.groupBy("_p").agg(F.min(F.struct("id", "h", "k")).alias("_first"))
    over = Window.orderBy("_p")
    first = first.select("_p", F.coalesce(F.lead("_first").over(over), F.first("_first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    joined = led.join(F.broadcast(first), "_p")
    return joined.select("id", "k", "h", "n", F.coalesce("next_k", F.col("_next.k")).alias("next_k"), F.coalesce("next_h", F.col("_next.h")).alias("next_h"))


def edited_fingerprints(docs: DataFrame, k: int = SKETCH, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document by ascending id; the last
    document is followed by the first.  NULL text is empty, a NULL id comes
    first.  Rows that share an id follow each other by text hash; rows repeated
    in id and text are one document in this order and get equal results.

    Texts are shuffled once; a document's beginning and sketch go to its
    predecessor in a second, smaller shuffle.
    """
    ident = F.col(f"`{id_col}`")
    whole = docs.select(
        ident.alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.coalesce(ident.cast("string"), F.lit("")).alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"),
    )
    keys = whole.select(F.col("doc_id").alias("id"), "k", "h", F.char_length("text").alias("n")).distinct()
    links = checkpointed(successors(keys).select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("take")))
    giving = with_sketch(whole.join(links.hint("shuffle_hash"), ["k", "h"]), F.col("text"), "next_sketch", k, words)
    heads = giving.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("doc_id").alias("next_doc_id"), F.expr("substring(text, 1, take)").alias("head"), "next_sketch")
    heads = heads.groupBy("k", "h").agg(F.first("next_doc_id").alias("next_doc_id"), F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch"))
    both = whole.join(heads.hint("shuffle_hash"), ["k", "h"])
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.col("head")))
    both = with_sketch(with_sketch(both, F.col("text"), "own", k, words), F.col("edited"), "changed", k, words)
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_distinct"), "next_doc_id",
    )
