"""Queries of the vector index and of document pairs by vector; see ``queries``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..operators.vector_index import VectorIndex, default_probes
from ..sources.scratch import materialize, scratch_path
from .queries import DIMENSIONS, SCALED, pages, query

#: Bands of document vectors, which lie nearer to each other than pages do.
DOCUMENT_BANDS = replace(SCALED, vector_duplicate=0.10, vector_similar=0.02)


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """Even pages are indexed first, odd ones join the cells that these made."""
    p = pages(spark, sf_dir)
    index = VectorIndex.build(p.filter("id % 2 = 0"), scratch_path(spark, "vector_index"), DIMENSIONS)
    index.add(p.filter("id % 2 = 1"))
    return index


@query
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of every page whose id is divisible by 50, among all pages."""
    return _index(spark, sf_dir).search(pages(spark, sf_dir).filter("id % 50 = 0"), 5)


@query
def vector_index_other_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, among pages of other documents."""
    return _index(spark, sf_dir).search(pages(spark, sf_dir).filter("id % 50 = 0"), 3, same_group=False)


@query
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours of each such page a search of some cells finds."""
    index, asked = _index(spark, sf_dir), pages(spark, sf_dir).filter("id % 50 = 0")
    exact = materialize(index.search(asked, 5), "exact")
    some = index.search(asked, 5, probes=default_probes(index)).select("q_id", "r_id", F.lit(1).alias("hit"))
    return exact.join(some, ["q_id", "r_id"], "left").groupBy("q_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("exact"))


@query
def doc_pair_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.document_bands(pages(spark, sf_dir), DIMENSIONS, DOCUMENT_BANDS)


@query
def doc_pair_average_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.document_pairs(pages(spark, sf_dir), DIMENSIONS, 0.001)
