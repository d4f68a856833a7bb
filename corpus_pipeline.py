"""A training-data pipeline of five of the operators.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns what the next
one reads.  ``run`` writes every stage's result to the shared folder and reads it again.

In all stages ids are integers, a null text counts as an empty one, texts of any length are read
whole, rows that repeat are rows, other columns may have any name and type and stay as they are,
and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.exact_dedup import drop_copies
from tesserae.llm.mixing import mixed_rows
from tesserae.llm.sentencepiece_lattice import encode
from tesserae.llm.simhash import drop_near_duplicates
from tesserae.llm.toxicity import drop_toxic, train
from tesserae.sources.scratch import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of a toxic grade; the model is fitted on the labelled ones among ``docs``.

    A text without words is told by the thresholds alone; equal texts are told alike.
    """
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the row with the largest id; a null id is the smallest, and of rows with equal
    id and text one stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, keep the smallest id, a null one being the largest; texts
    without words are one class."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order of the mix of their sources; null is a source like any other."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives its text again; an empty text has none."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The toxicity model and the encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
