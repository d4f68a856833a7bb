"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .byte_bpe import round_trip
from .collinear import repeated_passages
from .context_tree import score
from .dac import token_files
from .delta_lloyd import cluster
from .divergence import audit
from .exact_dedup import exact_dedup
from .mixing import mix
from .quality_rules import ablations, apply_policy, ledger
from .sentencepiece_lattice import encode_digests
from .simhash import near_duplicates
from .toxicity import severity, train
from .url_filters import filter_captures, url_keys


#: More path segments than a URL has.
ANY_DEPTH = 1 << 30


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("row")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "fail_bits", "kept", "n_lines", "n_letters", "n_upper")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule rejects, from the stored ledger: texts are read once, when it is written."""
    return ablations(materialize(ledger(_table(spark, sf_dir, "documents")), "ledger"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time and come with no list.  Page i counts as fetched i hours, modulo
    a year, after the start of 2024; the list is made of the pages' own keys by their md5: some
    are blocked on a day, some of these come off 60 days later, and some paths are allowed."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(1704067200 + 3600 * (F.col("page_id") % 8760)).alias("fetched_at"))
    keys = pages.select(F.explode(url_keys(F.col("url"), ANY_DEPTH)).alias("k")).select(F.col("k.key").alias("entry"), F.col("k.rank").alias("rank")).distinct()
    number = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("long")
    keys = keys.withColumn("h", number).withColumn("since", F.timestamp_seconds(1704067200 + 86400 * (F.col("h") % 300)))
    block = keys.filter("h % 7 = 0").select("entry", F.lit("block").alias("action"), "since")
    remove = keys.filter("h % 14 = 0").select("entry", F.lit("remove").alias("action"), (F.col("since") + F.expr("interval 60 days")).alias("since"))
    allow = keys.filter("rank > 1000 AND h % 5 = 0").select("entry", F.lit("allow").alias("action"), "since")
    found = filter_captures(pages, block.unionByName(remove).unionByName(allow), "page_id", "url", "fetched_at")
    return found.withColumnsRenamed({"id": "page_id", "fetched": "fetched_at"})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return severity(docs, train(docs, _table(spark, sf_dir, "labels")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("same")


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_simhash": op6_simhash,
    "op7_context_tree": op7_context_tree,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_divergence": op11_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_delta_lloyd": op13_delta_lloyd,
    "quality_ablations": quality_ablations,
}
