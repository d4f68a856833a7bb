"""Requirements of new chunks, from reuse to storage.

Copies take the requirements of their originals; chunks that have some are passed over; the others
are extracted, embedded, compared with stored requirements, and only what is new is asked about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import neighbours, valid
from ..operators import requirements
from ..operators.hot_join import drop_keys
from ..operators.model_calls import Client, call_in_batches, verified_duplicates
from ..sources.scratch import materialize
from ..sources.tables import append_table, current_version, read_table
from ..thresholds import DEFAULT, Thresholds

SCHEMA = "requirement_id string, number long, source_chunk_id string, copied_from string, title string, description string, source_text string, embedding array<double>, is_duplicate boolean, duplicate_of string, confidence double, rationale string, is_software_related boolean, software_confidence double, software_error string"
#: What a requirement gets that the model can't be asked about.
NO_ANSWER = (False, 0.5)


def nearest_stored(new: DataFrame, stored: DataFrame, size: int, t: Thresholds) -> DataFrame:
    """New requirements ``requirement_id, number, description, embedding`` with the most similar stored one,
    where that reaches ``requirement_duplicate``: never one of the same batch.

    An exact search of an index would send a new one to each ring that its bound lets pass, and the vectors
    of texts lie close together; in blocks it is sent as often as the stored ones have blocks.  Short vectors
    meet only leaves of a block that can hold a nearer one.
    """
    side = lambda rows: rows.filter(valid(F.col("embedding"), size)).select(F.col("number").alias("id"), F.lit(0).cast("long").alias("grp"), F.col("embedding").alias("vec"))
    near = neighbours(side(new), side(stored), 1, least=t.requirement_duplicate).filter(F.col("similarity") >= t.requirement_duplicate)
    asked = near.join(new.select(F.col("number").alias("q_id"), "requirement_id", F.col("description").alias("new_text")), "q_id")
    held = stored.select(F.col("number").alias("r_id"), F.col("requirement_id").alias("old_id"), F.col("description").alias("old_text"))
    return asked.join(held, "r_id").select(F.col("requirement_id").alias("id"), "new_text", "old_id", "old_text", "similarity")


def extract_new(
    chunks: DataFrame,
    stored: DataFrame,
    extractor: Callable[[Column], Column],
    embedder: Callable[[Column], Column],
    size: int,
    verifier: Callable[[], Client] | None,
    software: Callable[[], Client],
    t: Thresholds = DEFAULT,
    number: Column | None = None,
    **how,
) -> DataFrame:
    """New rows, of the columns of SCHEMA, for ``chunks`` (``chunk_id, chunk_text, duplicate_of``) beside ``stored``.

    A chunk that has stored requirements gives none.  One whose original has some copies these; any
    other is extracted.  A requirement's vector is that of its title and description; it is a
    duplicate of the nearest stored one from ``requirement_certain`` on, and from
    ``requirement_duplicate`` on if the verifier says so.  Duplicates stay, flagged; only the others
    are asked about software, and one without an answer gets (false, 0.5) and the error.  ``number``
    makes a requirement's long id from its row, by default a 64-bit hash of its id; ties of similarity
    go to the smaller one.  Numbers must not repeat.  ``how`` goes to the model calls.
    """
    own = stored.select(F.col("source_chunk_id").alias("chunk_id")).distinct()
    todo = materialize(drop_keys(chunks, "chunk_id", own).select("chunk_id", "chunk_text", "duplicate_of"), "todo")
    copied = requirements.reusable(todo, stored)
    ordinal = F.element_at(F.split("requirement_id", ":"), -1)
    copied = copied.withColumn("requirement_id", F.concat_ws(":", "source_chunk_id", ordinal))
    taken = copied.select(F.col("source_chunk_id").alias("chunk_id")).distinct()
    found = requirements.extract(drop_keys(todo, "chunk_id", taken), extractor)
    numbered = number if number is not None else F.xxhash64("requirement_id")
    found = found.withColumns({"number": numbered, "embedding": embedder(F.concat_ws("\n", "title", "description")).cast("array<double>")})
    found = materialize(found, "found")
    told = verified_duplicates(nearest_stored(found, stored.filter("NOT coalesce(is_duplicate, false)"), size, t), verifier, t.requirement_certain, **how)
    flagged = found.join(told.withColumnRenamed("id", "requirement_id"), "requirement_id", "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    flagged = materialize(flagged, "flagged")
    unique = flagged.filter("NOT is_duplicate")
    asked = call_in_batches(unique.select(F.col("requirement_id").alias("id"), F.col("description").alias("text")), software, "is_software_related boolean, confidence double", **how)
    flags = asked.select(F.col("id").alias("requirement_id"), F.coalesce("result.is_software_related", F.lit(NO_ANSWER[0])).alias("is_software_related"), F.coalesce("result.confidence", F.lit(NO_ANSWER[1])).alias("software_confidence"), F.col("error").alias("software_error"))
    rows = unique.join(flags, "requirement_id").unionByName(flagged.filter("is_duplicate"), allowMissingColumns=True)
    # A copy's vector and flags are those of its original.
    held = stored.select(F.col("source_chunk_id").alias("copied_from"), ordinal.alias("_ordinal"), "title", "source_text", "embedding", "is_duplicate", "duplicate_of", "is_software_related", "software_confidence")
    copied = copied.withColumn("_ordinal", ordinal).join(held, ["copied_from", "_ordinal"], "left").drop("_ordinal").withColumn("number", numbered)
    return _shaped(rows.unionByName(copied, allowMissingColumns=True))


def _shaped(rows: DataFrame) -> DataFrame:
    columns = [c.split() for c in SCHEMA.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in columns])


def store_new(chunks: DataFrame, path: str, *args, batch: str | None = None, **how) -> DataFrame:
    """``extract_new`` beside the table at ``path``, to which the rows are appended, unique ones before duplicates.

    ``batch`` names a stream's batch, which the table takes once however often it runs.
    """
    spark = chunks.sparkSession
    version = current_version(spark, path, batch)
    stored = read_table(spark, path, version) if version else spark.createDataFrame([], SCHEMA)
    new = materialize(extract_new(chunks, stored, *args, **how), "new_requirements")
    append_table(new.repartitionByRange("is_duplicate", "requirement_id").sortWithinPartitions("is_duplicate", "requirement_id"), path, batch)
    return new
