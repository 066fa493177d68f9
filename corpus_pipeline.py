"""Training-data pipeline: from ``documents`` to packed token sequences.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` applies
them in turn, writing each result as Parquet to the shared scratch folder and reading it back as the next stage's input,
so a stage's work is done once and a lost executor costs no earlier stage.  All stages but the last return the columns
of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablab.llm.common import write_scratch
from tablab.llm.packing import pack_documents
from tablab.llm.quality_classifier import keep_good
from tablab.llm.queries import table, vocabulary
from tablab.llm.simhash import drop_near_duplicates
from tablab.llm.substrings import remove_repeats
from tablab.llm.toxicity import drop_toxic
from tablab.session import clear_scratch, scratch_mark

#: SQL cannot express the classifiers, the hash components or the packing; tests hold the rows against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: 3-word shingles, at most 2 differing bits."""
    return drop_near_duplicates(docs, shingle=3, max_bits=2, seed=42)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated 35-word windows cover; ``n_chars`` follows the text."""
    left = remove_repeats(docs, window=35)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(left.schema["n_chars"].dataType), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, vocabulary(), capacity=1024, separator=2)


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs, before = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = write_scratch(out, f"stage-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
        clear_scratch(spark, before, keep=(path,))  # what the stage needed on its way, and its input
    return docs
