"""The catalogue of queries over the driver's tables; each runs over whole tables.

Tables stand in for what the engine is made for: a document is a file that arrives in the order
of its id, ``embeddings`` are pages whose label is their document, ``conversations`` are model
calls, ``events`` are log lines.  Vector thresholds are scaled to these vectors' similarities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.diff import diff_lines
from ..functions.models import decide_pair
from ..functions.vectors import neighbours
from ..operators import chunking, ingest, lineage, reports, requirements, versions
from ..streaming.hash_ingest import ingest_available
from ..sources.scratch import materialize, scratch_path
from ..thresholds import DEFAULT

SCALED = replace(DEFAULT, vector_duplicate=0.48, vector_similar=0.40, version=0.30, requirement_duplicate=0.40, requirement_certain=0.45, review_suggestion=0.42, document_final=0.10)
DIMENSIONS = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("vec"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(documents(spark, sf_dir), lambda t: T.pack(T.sentences(t), DEFAULT.max_chunk_chars, " "))


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk hashes with the first occurrence, over a slim table, so that texts are packed once."""
    slim = sentence_chunks(spark, sf_dir).select("document_id", "chunk_index", "chunk_hash")
    return chunking.first_occurrences(materialize(slim, "chunk_keys"))


@query
def file_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup_files(ingest.file_hashes(files(spark, sf_dir)))


@query
def file_hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = ingest.file_hashes(files(spark, sf_dir))
    ledger = hashes.filter("path % 2 = 0").withColumn("seq", F.col("path"))
    return ingest.look_up_hashes(hashes.filter("path % 2 = 1"), ledger)


@query
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_chunks(spark, sf_dir).select("document_id", "chunk_index", "chunk_id", "chunk_hash", F.length("chunk_text").cast("long").alias("n_chars"))


@query
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_statistics(sentence_chunks(spark, sf_dir))


@query
def chunk_dup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_keys(spark, sf_dir)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("is_duplicate").cast("long")).alias("duplicate"))


@query
def document_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_keys(spark, sf_dir).withColumn("status", F.when(F.col("is_duplicate"), "duplicate").otherwise("new"))
    return chunking.document_verdicts(chunking.count_outcomes(rows))


@query
def hash_multiplicity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent chunk hashes, a report of its own limit."""
    counts = sentence_chunks(spark, sf_dir).groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_chunk")).filter("n > 1")
    return counts.orderBy(F.desc("n"), "chunk_hash").limit(10)


@query
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def _sections(docs: DataFrame, splitter: Callable) -> DataFrame:
    return docs.select("document_id", F.posexplode(splitter(F.col("text"))).alias("section", "s")).select("document_id", "section", F.md5("s").alias("hash"), F.length("s").cast("long").alias("n_chars"))


@query
def split_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n# "))
    return _sections(docs, lambda t: T.header_sections(t, 1500))


@query
def split_by_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return _sections(docs, lambda t: T.pack(F.split(t, "\n\n"), 1500, "\n\n"))


@query
def slice_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(documents(spark, sf_dir), lambda t: T.slices(t, 750))


@query
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, then chunks: the whole splitter over texts as they are."""
    return chunking.chunks(documents(spark, sf_dir)).select("document_id", "chunk_index", "chunk_hash", F.length("chunk_text").cast("long").alias("n_chars"))


@query
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return chunking.chunks_with_offsets(docs, lambda t: T.pack(T.sentences(t), DEFAULT.max_chunk_chars, " "))


@query
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return neighbours(p, p, 5)


@query
def page_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return neighbours(p, p, 1).select("q_id", "r_id", "similarity", (F.col("similarity") >= SCALED.vector_similar).alias("is_match"))


@query
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.classify_pages(pages(spark, sf_dir), SCALED)


@query
def version_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_votes(pages(spark, sf_dir), SCALED)


@query
def document_vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.nearest_documents(pages(spark, sf_dir), DIMENSIONS, SCALED)


@query
def two_stage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.document_verdicts(pages(spark, sf_dir), DIMENSIONS, SCALED)


@query
def doc_pair_avg_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.document_pairs(pages(spark, sf_dir), DIMENSIONS)


@query
def orphan_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For chunks that neither repeat nor align, up to five suggestions from other documents."""
    p = pages(spark, sf_dir)
    near = neighbours(p.filter("id % 3 <> 0"), p, SCALED.review_limit, same_group=False)
    return near.filter(F.col("similarity") >= SCALED.review_suggestion)


@query
def requirement_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return neighbours(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), 1).drop("rank")


@query
def requirement_dedup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return versions.classify_requirements(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), SCALED, "requirement_id % 3 = 0")


@query
def word_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.shared_word_pairs(documents(spark, sf_dir).withColumnRenamed("document_id", "id"), 0.8)


@query
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_classes(documents(spark, sf_dir).withColumnRenamed("document_id", "id"))


def _paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentence chunks of documents as references, and edited ones as their new version."""
    rows = sentence_chunks(spark, sf_dir).select("document_id", F.col("chunk_id").alias("id"), F.col("chunk_index").alias("seq"), F.col("chunk_text").alias("text"))
    rows = materialize(rows, "chunks")
    edited = F.when(F.col("seq") % 3 == 1, F.concat("text", F.lit(" It was changed."))).when(F.col("seq") % 3 == 2, F.reverse("text")).otherwise(F.col("text"))
    return rows.withColumn("text", edited), rows


@query
def text_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _paired(spark, sf_dir)
    pairs = chunking.similar_pairs(new, old, "document_id")
    return pairs.select("document_id", "new_id", "old_id", F.round("ratio", 6).alias("ratio"), F.round("words", 6).alias("words"), F.round("similarity", 6).alias("similarity"))


@query
def chunk_align_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _paired(spark, sf_dir)
    return chunking.align_first_match(new, old, "document_id")


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    d = F.col("doc_id")
    return ids.select(
        name(d).alias("chunk_id"),
        F.concat(F.lit("d"), (d % 20).cast("string")).alias("document_id"),
        F.when(d % 7 == 0, name(d + 1)).alias("replaced_by"),
        F.when(d % 5 == 0, name(d - 1)).otherwise(F.lit("")).alias("previous_chunk_id"),
        F.when(d % 3 == 0, name(F.floor(d / 2))).alias("duplicate_of"),
        F.when(d % 11 == 0, F.concat(F.lit("d"), ((d + 3) % 20).cast("string"))).otherwise(F.lit("")).alias("aligned_with_document_id"),
    )


@query
def replacement_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _lineage(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 4 = 1")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    replaced = d.select(name(F.col("doc_id") + 100000).alias("new_id"), name(F.floor(F.col("doc_id") / 2)).alias("old_id"), F.col("doc_id").alias("seq"))
    return lineage.flatten_replacements(chunks, replaced)


@query
def lineage_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_report(_lineage(spark, sf_dir))


@query
def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.relationship_edges(_lineage(spark, sf_dir))


@query
def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.related_documents(lineage.relationship_edges(_lineage(spark, sf_dir)), "d3")


@query
def requirement_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _lineage(spark, sf_dir).select("chunk_id", "duplicate_of")
    reqs = _lineage(spark, sf_dir).filter("substring(chunk_id, 2) % 2 = 0").select(F.concat(F.lit("r"), "chunk_id").alias("requirement_id"), F.col("chunk_id").alias("source_chunk_id"), F.col("document_id").alias("description"))
    return requirements.reusable(chunks, reqs)


@query
def requirement_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _lineage(spark, sf_dir).select("chunk_id", "duplicate_of")
    return requirements.pending(chunks, chunks.filter("substring(chunk_id, 2) % 2 = 0").select(F.col("chunk_id").alias("source_chunk_id")))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.floor(F.length("text") / 4).cast("long")
    names = [p[0] for p in reports.PRICES] + ["gpt-4.5-preview", "unheard-of"]
    model = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("conv_id") % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("date"), model.alias("model"), "role", tokens.alias("n"))
    return rows.select("date", "model", F.when(F.col("role") == "user", F.col("n")).otherwise(F.lit(0)).alias("input_tokens"), F.when(F.col("role") == "assistant", F.col("n")).otherwise(F.lit(0)).alias("output_tokens"))


@query
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage_per_day(_calls(spark, sf_dir))


@query
def usage_cost_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_prices(reports.usage_per_day(_calls(spark, sf_dir)))


@query
def usage_tier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tier_limits(reports.usage_per_day(_calls(spark, sf_dir)))


@query
def pages_to_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("content"))
    return ingest.document_text(turns, "\n\n", trailing=True).select("document_id", F.md5("text").alias("hash"), F.length("text").cast("long").alias("n_chars"))


@query
def json_pages_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as parsed documents in four shapes by number, and read again."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("page_number"), F.col("text").alias("md_content"))
    page = F.struct("page_number", "md_content")
    by = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("ps"))
    keyed = F.map_from_entries(F.transform("ps", lambda p: F.struct(F.format_string("page_%03d", p["page_number"]), p)))
    shape = F.col("conv_id") % 4
    told = F.when(shape == 0, F.to_json(F.struct(F.col("ps").alias("pages")))).when(shape == 1, F.to_json(F.struct(keyed.alias("pages")))).when(shape == 2, F.to_json(keyed)).otherwise(F.to_json(F.col("ps")[0]))
    rows = ingest.read_pages_json(by.select(F.col("conv_id").alias("document_id"), told.alias("json")))
    return rows.select("document_id", F.col("page_number").cast("long").alias("page_number"), F.md5("content").alias("hash"))


@query
def page_field_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("content"), F.col("source").alias("text"))
    return rows.select("doc_id", ingest.non_empty("content", "text").alias("content"))


@query
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_no"), F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("cells"))
    return reports.markdown_table(sheet).select("row_no", F.col("part").cast("long").alias("part"), "line")


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.column_profile(table(spark, sf_dir, "lineitem"))


@query
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source"), F.col("event_id").alias("line_no"), F.col("event_type").alias("text"))
    found = reports.sections(lines, "^purchase$")
    return found.groupBy("source", "section").agg(F.count(F.lit(1)).alias("lines"))


@query
def log_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source"), F.col("event_id").alias("line_no"), F.col("event_type").alias("text"))
    return reports.log_flags(reports.sections(lines, "^purchase$"), {"has_click": "click", "has_view": "view"})


@query
def scenario_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("scenario_id"), F.col("event_id").alias("ts"), (F.col("value") > 50).alias("passed"))
    return reports.latest_runs(runs)


@query
def latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("document_id"), F.floor(F.col("doc_id") / 40 % 5).alias("page_number"), F.col("doc_id").alias("ts"), "lang")
    return ingest.latest_pages(copies)


@query
def extract_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.extract(sentence_chunks(spark, sf_dir))
    return requirements.with_software_flag(found).select("requirement_id", "source_chunk_id", F.md5("description").alias("hash"), "is_software_related", "software_confidence")


@query
def doc_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    edited = d.withColumn("new", F.regexp_replace("text", r"^[^\n]*\n?", "A changed line\n"))
    return edited.select("document_id", F.inline(diff_lines("text", "new"))).groupBy("document_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    bar = F.concat(F.repeat(F.lit("#"), (F.length("text") % 10).cast("int")), F.repeat(F.lit("."), (F.lit(10) - F.length("text") % 10).cast("int")))
    return d.select("document_id", T.approx_tokens(F.col("text")).cast("long").alias("tokens"), F.size(T.word_set(F.col("text"))).cast("long").alias("words"), T.sentence_boundary(F.col("text"), F.lit(20)).alias("boundary"), bar.alias("bar"), F.substring("text", 101, 200).alias("slice"))


@query
def stream_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "stream")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.parquet(f"{folder}/source")
    ledger = ingest_available(spark, f"{folder}/source", "doc_id long, text string", f"{folder}/ledger", f"{folder}/checkpoint", lambda b: b.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))
    return ledger.select("md5", "sha256", "size")


@query
def doc_max_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.nearest_page_documents(pages(spark, sf_dir), DIMENSIONS, SCALED)


@query
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.page_outcomes(versions.page_bands(pages(spark, sf_dir), SCALED))


@query
def chunk_classify_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd pages arrive, even ones are stored; every third pair of neighbours has equal hashes."""
    half = F.floor(F.col("id") / 2)
    p = pages(spark, sf_dir).withColumn("hash", F.md5(F.when(half % 3 == 0, F.concat(F.lit("p"), half.cast("string"))).otherwise(F.col("id").cast("string"))))
    return versions.classify_chunks(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), SCALED)


@query
def page_update_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    near = neighbours(p, p, 1).select("q_id", "r_id", "similarity")
    at = lambda c: (F.col(c) % 7, F.floor(F.col(c) / 100), F.col(c))
    (d, g, t), (md, mg, mt) = at("q_id"), at("r_id")
    rows = near.select("q_id", d.alias("document"), g.alias("page"), t.alias("ts"), md.alias("match_document"), mg.alias("match_page"), mt.alias("match_ts"), "similarity")
    return versions.update_status(rows, SCALED).select("q_id", "status")


@query
def orphan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.orphans(_lineage(spark, sf_dir)).select("chunk_id", "document_id")


@query
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_chunks(spark, sf_dir).withColumn("key", F.col("document_id") % 10)
    return chunking.missing_chunks(rows.filter("document_id % 2 = 0"), rows.filter("document_id % 2 = 1").withColumn("key", F.pmod(F.col("key") - 1, F.lit(10))))


@query
def word_count_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_difference(documents(spark, sf_dir).select(F.col("document_id").alias("key"), F.col("text").alias("a"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("b")))


@query
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _paired(spark, sf_dir)
    pairs = chunking.similar_pairs(new, old, "document_id")
    return chunking.decide_pairs(pairs, decide_pair).select("new_id", "old_id", F.round("similarity", 6).alias("similarity"), "decision")


@query
def overlap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlap_fallback(documents(spark, sf_dir), sentence_chunks(spark, sf_dir))


@query
def required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for required files, and labelled ones for those that are available."""
    required, available = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ingest.missing_files(required.select(F.col("doc_id").alias("name")), available.select(F.col("doc_id").alias("name")))


@query
def requirement_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("requirement_id"))
    return requirements.verification_batches(rows)


@query
def requirement_id_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    # lpad cuts what is longer.
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, padded).otherwise(F.concat(F.lit("R"), number)).alias("requirement_id"))
    return requirements.offset_ids(rows, 5)


@query
def title_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("content"))
    return ingest.title_inputs(turns, 3, 100)


@query
def combined_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one object each, read again from it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("content"))
    return ingest.read_pages_json(ingest.combined_json(turns)).select("document_id", F.col("page_number").cast("long").alias("page_number"), F.md5("content").alias("hash"))


@query
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_summaries(sentence_chunks(spark, sf_dir))


@query
def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    return reports.upsert_usage(reports.usage_per_day(calls.filter("date < '2024-01-16'")), calls.filter("date >= '2024-01-10'"))


def _log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("New unique chunks: "), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit(" duplicate chunks"))).otherwise(F.lit("nothing"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("section"), kind.alias("text"))


@query
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_counts(_log_texts(spark, sf_dir))


@query
def capability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.capability_summary(reports.log_counts(_log_texts(spark, sf_dir)))


@query
def pages_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("role").alias("roles"))


from . import flow_queries, lookup_queries, vector_queries  # noqa: E402, F401  (they register their queries here)
