"""Queries of lookups, listings, table operations and reports; see ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.vectors import cosine, cosine_or_nan
from ..operators import chunking, lineage, lookups, reports, versions
from ..sources import tables
from ..sources.scratch import materialize, scratch_path
from .queries import DIMENSIONS, SCALED, _calls, _lineage, documents, pages, query, sentence_chunks, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("content"), F.col("role").alias("title"))


@query
def document_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.first_rows(_turns(spark, sf_dir), "document_id", "page_number", "content")
    return found.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.md5("content").alias("hash"))


@query
def documents_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(lookups.id_contains(F.col("source"), "1")).select("doc_id", "source")


@query
def page_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.page_projection(_turns(spark, sf_dir).withColumn("unused", F.lit(1)))
    return rows.select("document_id", F.col("page_number").cast("long").alias("page_number"), "title", F.md5("content").alias("content"))


@query
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.distinct_titles(table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("title")))


@query
def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document d counts as similar to d - 1 where d is a multiple of ten."""
    pairs = documents(spark, sf_dir).filter("document_id % 10 = 0 AND document_id > 0").select("document_id", (F.col("document_id") - 1).alias("similar_id"))
    return lookups.reference_chunks(pairs, sentence_chunks(spark, sf_dir)).select("document_id", "similar_id", "chunk_id", "chunk_hash")


@query
def existing_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("r"), (F.col("doc_id") % 300).cast("string")).alias("requirement_id"), F.col("doc_id").alias("stored_in"))
    candidates = d.select(F.col("doc_id").alias("candidate"), F.concat(F.lit("r"), (F.col("doc_id") % 400).cast("string")).alias("requirement_id"))
    return lookups.existing_rows(candidates, rows, "requirement_id", "stored_in")


@query
def aligned_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.aligned_examples(_lineage(spark, sf_dir))


@query
def relationship_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.ranked_edges(lineage.relationship_edges(_lineage(spark, sf_dir)))


@query
def hash_members_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent chunk hashes with five members each, a report of its own limits."""
    rows = materialize(sentence_chunks(spark, sf_dir).select("chunk_hash", "chunk_id"), "hashes")
    return lookups.frequent_members(rows, "chunk_hash", "chunk_id", 10, 5)


@query
def missing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentence chunks a document's group has, and the beginnings of three."""
    rows = sentence_chunks(spark, sf_dir).withColumn("key", F.col("document_id") % 10)
    return lookups.samples(rows, "key", "chunk_id", "chunk_text", 3, 200)


@query
def pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page and its original, the page of half its number: both forms of the cosine."""
    p = pages(spark, sf_dir)
    original = p.select(F.col("id").alias("original"), F.col("vec").alias("other"))
    joined = p.join(original, F.floor(F.col("id") / 2) == F.col("original"))
    return joined.select("id", "original", F.round(cosine(F.col("vec"), F.col("other")), 6).alias("similarity"), F.round(cosine_or_nan(F.col("vec"), F.col("other")), 6).alias("or_nan"))


@query
def doc_pair_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.document_extremes(pages(spark, sf_dir), SCALED.vector_similar, DIMENSIONS)


@query
def usage_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage_on(reports.usage_per_day(_calls(spark, sf_dir)), "2024-01-05")


@query
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, of: F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(F.col("n_nationkey") / of) % len(names) + 1).cast("int"))
    tasks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), pick(["openai", "groq", "other"], 1).alias("provider"), pick(["pdf_parsing", "chunking", "naming"], 3).alias("task"), pick(["vision", None], 9).alias("sub_task"))
    return reports.model_for_task(tasks)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("scenario_id"), (F.col("value") > 50).alias("passed"))


@query
def scenario_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scenario_rates(_runs(spark, sf_dir))


@query
def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: a purchase opens a section, clicks name documents, a signup passes, an error fails."""
    name = F.concat(F.lit("Processing d"), (F.col("event_id") % 7).cast("string"), F.lit(".pdf"))
    told = F.when(F.col("event_type") == "click", name).when(F.col("event_type") == "signup", "PASSED").when(F.col("event_type") == "error", "FAILED").otherwise(F.col("event_type"))
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source"), F.col("event_id").alias("line_no"), told.alias("text"))
    return reports.scenario_table(reports.sections(lines, "^purchase$"), r"Processing ([^.]+\.pdf)", "PASSED", "FAILED")


@query
def truncated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.truncate_tokens(F.col("text"), 100)
    return documents(spark, sf_dir).select("document_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut).alias("hash"))


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(path).alias("base_name"), T.extension(path).alias("extension"))


@query
def timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *T.timestamp_forms(F.col("ts")))


@query
def text_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the middle of each document."""
    middle = F.floor(F.length("text") / 2).cast("int")
    return documents(spark, sf_dir).select("document_id", F.md5(T.around(F.col("text"), middle)).alias("hash"))


@query
def table_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored in two appends with different columns, some deleted, and read again."""
    folder = scratch_path(spark, "tables")
    path = f"{folder}/documents"
    d = table(spark, sf_dir, "documents")
    tables.append_table(d.filter("doc_id % 2 = 0").select("doc_id", "lang"), path)
    tables.append_table(d.filter("doc_id % 2 = 1").select("doc_id", "source"), path)
    tables.delete_rows(spark, path, F.col("doc_id") % 10 == 3)
    return tables.read_table(spark, path).select("doc_id", "lang", "source", F.lit(",".join(tables.list_tables(spark, folder))).alias("listed"))


@query
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of even documents that the odd ones of the group beside lack: how many, and three of them."""
    rows = sentence_chunks(spark, sf_dir).withColumn("key", F.col("document_id") % 10)
    newer = rows.filter("document_id % 2 = 1").withColumn("key", F.pmod(F.col("key") - 1, F.lit(10)))
    gone = materialize(chunking.missing_chunks(rows.filter("document_id % 2 = 0"), newer), "missing")
    return lookups.samples(gone, "key", "chunk_id", "excerpt", 3, 200)


@query
def reviewed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions by id: every third chunk loses its original, every fourth gets a replacement."""
    rows, number = _lineage(spark, sf_dir), F.substring("chunk_id", 2, 20).cast("long")
    columns = F.array_compact(F.array(F.when(number % 3 == 0, F.lit("duplicate_of")), F.when(number % 4 == 0, F.lit("replaced_by"))))
    changes = rows.select("chunk_id", F.lit(None).cast("string").alias("duplicate_of"), F.concat(F.lit("r"), "chunk_id").alias("replaced_by"), columns.alias("changed"))
    return lineage.update_rows(rows, changes, "chunk_id", "changed").select("chunk_id", "document_id", "duplicate_of", "replaced_by")


@query
def schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' columns against those that another reader asks for."""
    asked = StructType().add("doc_id", "long").add("text", "string").add("source", "long").add("title", "string")
    return lineage.schema_differences(table(spark, sf_dir, "documents"), asked)


@query
def expected_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of documents that copies change: those that differ from what is expected; a third asserts nothing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first"))
    actual = rows.join(first, "hash").select("doc_id", (F.col("doc_id") != F.col("first")).alias("is_duplicate"), (F.col("doc_id") % 2 == 0).alias("is_even"))
    unasserted = F.when(F.col("doc_id") % 3 != 0, F.lit(False))
    expected = rows.select("doc_id", unasserted.alias("is_duplicate"), F.when(F.col("doc_id") % 10 == 0, F.lit(False)).alias("is_even"))
    return reports.mismatches(expected, actual, "doc_id")


@query
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th page lost its vector: which groups of 25 pages are whole."""
    p = pages(spark, sf_dir).withColumn("grp", F.floor(F.col("id") / 25)).withColumn("vec", F.when(F.col("id") % 97 != 0, F.col("vec")))
    return versions.whole_documents(p, DIMENSIONS)


@query
def lineage_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pages(spark, sf_dir).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("_c"), "vec")
    rows = _lineage(spark, sf_dir)
    return lineage.lineage_cosines(rows.join(vectors, F.col("chunk_id") == F.col("_c"), "left"))


@query
def lineage_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per chunk of a table with lineage."""
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("_c"), F.substring("text", 1, 200).alias("chunk_text"))
    return reports.chunk_summaries(_lineage(spark, sf_dir).join(texts, F.col("chunk_id") == F.col("_c")))
