"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's documents.  All but the
last keep the columns of ``documents``, and extra columns of any name pass through.
An empty table gives an empty table.  Long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.session import checkpointed
from tallyscope.llm.common import fold, free_name
from tallyscope.llm.minmax import without_duplicates
from tallyscope.llm.mixing import cyclic_weight, mixed_documents
from tallyscope.llm.packing import pack_documents
from tallyscope.llm.pii import replace_entities
from tallyscope.llm.toxicity import learn, with_scores

# The key of a real run comes from the caller; this one makes the pipeline repeatable.
SURROGATE_KEY = "public example key"
TOKENIZER = "word_bpe_49k.json"


def measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not call toxic; it learns from the labelled rows outside fold 0 of five.

    NULL and empty texts have a score like others, that of no terms.  Rows
    without an id are scored, not learned from; repeated rows share their fate.
    """
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    name = free_name(docs, "_score")
    return with_scores(docs, machine, name=name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id.

    Repeated rows leave one.  Texts without words are linked with nothing, so
    all of them stay, and so do rows without an id.
    """
    return without_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data, and n_chars of the new text.

    NULL and empty texts stay as they are; repeated rows stay alike.
    """
    return measured(replace_entities(docs, SURROGATE_KEY))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed at 1 : 2 : 3, up to three times each document.

    NULL is a source like others.  Texts without words weigh nothing and stay.
    Repeated rows are counted one by one; ids do not matter.
    """
    return measured(mixed_documents(docs, cyclic_weight()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 2048, one row per piece of a document.

    NULL and empty texts are their closing id alone; repeated rows and rows
    without an id are documents of their own.
    """
    import public_tokenizers

    return pack_documents(docs, str(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

# Scores, surrogates and hashes are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
