"""Filters, projections, listings and lookups over pages, chunks and requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a check of duplicates alone needs.
PAGE_COLUMNS = ("document_id", "page_number", "title", "content", "vec")


def first_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; rows that agree in ``order`` are alike, and one of them is taken."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def id_contains(id_: Column, part: str) -> Column:
    """Whether an id contains a literal text; a null id doesn't."""
    return F.coalesce(id_.contains(part), F.lit(False))


def page_projection(pages: DataFrame) -> DataFrame:
    """Those of PAGE_COLUMNS that the table has, in that order."""
    return pages.select(*[c for c in PAGE_COLUMNS if c in pages.columns])


def distinct_titles(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "title").distinct()


def reference_chunks(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the similar document of each pair ``document_id, similar_id``."""
    of = chunks.withColumnRenamed("document_id", "_of")
    return pairs.join(of, F.col("similar_id") == F.col("_of")).drop("_of")


def existing_rows(candidates: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Candidates with the first existing row of their key; null columns where there is none."""
    found = first_rows(rows, key, *order)
    return candidates.join(found.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


def aligned_examples(chunks: DataFrame) -> DataFrame:
    """``chunk_id, document_id, other_id, example_id``: chunks aligned with another document, with
    the least chunk of that document as an example."""
    least = chunks.groupBy(F.col("document_id").alias("_of")).agg(F.min("chunk_id").alias("example_id"))
    aligned = chunks.select("chunk_id", "document_id", F.nullif(F.col("aligned_with_document_id"), F.lit("")).alias("other_id")).filter("other_id IS NOT NULL")
    return aligned.join(least, F.col("other_id") == F.col("_of"), "left").drop("_of")


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Relationships of each document with their place, the most frequent first, then by name."""
    order = Window.partitionBy("document_id").orderBy(F.desc("n"), "other_id")
    return edges.withColumn("place", F.row_number().over(order).cast("long"))


def samples(rows: DataFrame, key: str, order: str, text: str, n: int, n_chars: int) -> DataFrame:
    """``key, n, sample_1 to n``: how many rows a key has, and the beginnings of its first ones.

    Counts combine and first rows are chosen before the shuffle, so that a key with many rows is no
    large task.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    first = rows.select(F.col(key).alias("_key"), order, F.substring(text, 1, n_chars).alias("_text")).withColumn("_n", place).filter(F.col("_n") <= n)
    picked = first.groupBy("_key").agg(*[F.max(F.when(F.col("_n") == i, F.col("_text"))).alias(f"sample_{i}") for i in range(1, n + 1)])
    return counts.join(picked, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def frequent_members(rows: DataFrame, key: str, member: str, top: int, n: int) -> DataFrame:
    """The ``top`` keys that occur most, twice at least, each with its first ``n`` members."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = F.broadcast(counts.orderBy(F.desc("n"), key).limit(top))
    members = rows.select(key, member).join(best, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(member))
    few = members.withColumn("_n", place).filter(F.col("_n") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", member))), lambda x: x[member])
    return few.groupBy(key, "n").agg(F.array_join(listed, ",").alias("members"))
