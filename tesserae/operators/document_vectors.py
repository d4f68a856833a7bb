"""Document vectors that are kept up to date by the pages that come and go.

A table holds a row per batch and document: how many of its pages came and went, and the sum of
their unit vectors in whole numbers of 2^-40.  Whole numbers add up to the same in any order, so
that a document's vector equals one made anew from all its pages, bit for bit.  A batch appends its
own documents' rows and reads no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize, valid
from ..sources.tables import append_table, current_version, read_table, replace_table

UNIT = 1 << 40


def _sums(rows: DataFrame, size: int, sign: int) -> DataFrame:
    whole = rows.filter(valid(F.col("vec"), size)).select(F.col("grp").alias("document"), F.transform(normalize(F.col("vec")), lambda x: F.round(x * UNIT).cast("long")).alias("v"))
    return whole.groupBy("document").agg((F.count(F.lit(1)) * sign).alias("pages"), _vector(lambda x: F.sum(x) * sign, "v", size))


def _vector(total, column: str, size: int) -> Column:
    return F.array(*[total(F.col(column)[i]) for i in range(size)]).alias("sums")


def _added_up(rows: DataFrame, size: int) -> DataFrame:
    return rows.groupBy("document").agg(F.sum("pages").alias("pages"), _vector(F.sum, "sums", size))


def change_pages(path: str, size: int, added: DataFrame | None = None, removed: DataFrame | None = None, batch: str | None = None) -> None:
    """Take pages ``grp, vec`` in or out; a page with a new vector is its old row removed and its new one added.

    Vectors that aren't whole count for nothing, in both directions.  ``batch`` names a stream's batch,
    which changes the table once however often it runs.
    """
    parts = [_sums(rows, size, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
    if parts:
        delta = parts[0] if len(parts) == 1 else _added_up(parts[0].unionByName(parts[1]), size)
        append_table(delta, path, batch)


def compact(spark: SparkSession, path: str, size: int) -> None:
    """One row per document that has pages; documents without any go."""
    replace_table(_added_up(read_table(spark, path), size).filter("pages <> 0"), path)


def kept_vectors(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``document, pages, vec``: the mean of the pages' unit vectors, for documents that have pages."""
    if not current_version(spark, path):
        return spark.createDataFrame([], "document long, pages long, vec array<double>")
    found = _added_up(read_table(spark, path), size).filter("pages > 0")
    return found.select("document", "pages", F.transform("sums", lambda x: x / F.lit(UNIT) / F.col("pages")).alias("vec"))
