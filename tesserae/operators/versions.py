"""Pages, documents and chunks by vector: duplicates, versions, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band
from ..functions.vectors import BLOCK_ROWS, below, dot, mean_vector, neighbours, normalize, valid
from ..sources.scratch import materialize
from ..thresholds import DEFAULT, Thresholds
from .vector_index import similar_groups


def classify_pages(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Pages ``id, grp, vec`` against all others: best match, its similarity and band."""
    best = neighbours(pages, pages, 1).select(F.col("q_id").alias("_id"), "r_id", "similarity")
    joined = pages.join(best, F.col("id") == F.col("_id"), "left")
    status = F.coalesce(band(F.col("similarity"), t.vector_duplicate, t.vector_similar), F.lit("new"))
    return joined.select("id", F.col("r_id").alias("match_id"), "similarity", status.alias("status"))


def page_bands(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Pages ``id, grp, vec`` against all others: ``id, grp, status``, the band of the best match, which isn't sought itself."""
    known = pages.filter(F.col("id").isNotNull())
    n, ids = known.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if ids < n:
        # Rows of one id aren't each other's matches and share their best one.
        return known.join(classify_pages(known, t).select("id", "status").distinct(), "id").select("id", "grp", "status")
    short = below(known.select("id", "vec"), [t.vector_duplicate, t.vector_similar]).select(F.col("id").alias("_id"), "level")
    whole = known.select("id", "grp", valid(F.col("vec")).alias("whole"))
    level = F.coalesce("level", F.when(F.col("whole"), 0))
    status = F.when(level == 0, "duplicate").when(level == 1, "similar").otherwise("new")
    return whole.join(short, F.col("id") == F.col("_id"), "left").select("id", "grp", status.alias("status"))


def version_votes(pages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Per document the most similar other document, by its first pages' nearest pages.

    Of each sampled page the best similarity per other document within the nearest ones
    counts; documents average over the pages in which they occur.
    """
    sample = pages.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).filter(F.col("_n") <= t.sample_pages).drop("_n")
    near = neighbours(sample, pages, t.top_k)
    group = pages.select(F.col("id").alias("_id"), F.col("grp").alias("other"))
    own = pages.select(F.col("id").alias("_q"), F.col("grp").alias("document"))
    known = near.join(group, F.col("r_id") == F.col("_id")).join(own, F.col("q_id") == F.col("_q")).filter("document <> other")
    per_page = known.groupBy("document", "q_id", "other").agg(F.max("similarity").alias("s"))
    mean = per_page.groupBy("document", "other").agg(F.round(F.avg("s"), 6).alias("s"))
    best = mean.groupBy("document").agg(F.max(F.struct("s", (-F.col("other")).alias("o"))).alias("b"))
    similar = (F.col("b.s") >= t.version) & (F.col("b.s") < t.vector_duplicate)
    return best.select("document", (-F.col("b.o")).alias("best_document"), F.col("b.s").alias("similarity"), similar.alias("is_new_version"))


def document_vectors(pages: DataFrame, size: int) -> DataFrame:
    """``document, vec``: one vector per document, the mean of its valid pages' unit vectors."""
    units = pages.filter(valid(F.col("vec"), size)).select(F.col("grp").alias("document"), normalize(F.col("vec")).alias("vec"))
    return units.groupBy("document").agg(mean_vector("vec", size).alias("vec"))


def whole_documents(pages: DataFrame, size: int | None = None) -> DataFrame:
    """``document, pages, whole``: whether all vectors of a document are whole; one that isn't rules it out."""
    of = pages.groupBy(F.col("grp").alias("document"))
    return of.agg(F.count(F.lit(1)).alias("pages"), F.bool_and(valid(F.col("vec"), size)).alias("whole"))


def document_pairs(pages: DataFrame, size: int, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Average cosine over all page pairs of two documents: the dot product of their mean unit vectors.

    With ``least`` only pairs of at least that average are made: their documents' vectors have a cosine
    as high, as means of unit vectors are no longer than 1.  Without, the report has a row for each pair,
    made in a grid of blocks.
    """
    means = document_vectors(pages, size)
    value = F.round(dot(F.col("va"), F.col("vb")), 6).alias("avg_similarity")
    if least is not None:
        means = materialize(means, "means")
        near = similar_groups(means.select(F.col("document").alias("id"), F.col("document").alias("grp"), "vec"), size, least)
        both = near.join(means.select(F.col("document").alias("a"), F.col("vec").alias("va")), "a").join(means.select(F.col("document").alias("b"), F.col("vec").alias("vb")), "b")
        return both.select(F.col("a").alias("document"), F.col("b").alias("other"), value).filter(F.col("avg_similarity") >= least)
    means = materialize(means, "means")
    blocks = -(-means.count() // block_rows) or 1
    block = F.pmod(F.xxhash64("document"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    side = lambda i, j: means.select(F.col("document").cast("long").alias("document"), F.col("vec").alias("vec"), i.alias("i"), j.alias("j"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(a) and len(b):
            (of_a, x), (of_b, y) = ((t.column("document").to_numpy(), t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(t), -1)) for t in (a, b))
            for at in range(0, len(of_a), 256):
                s = np.round(x[at : at + 256] @ y.T, 6)
                i, j = np.nonzero(of_a[at : at + 256, None] < of_b[None, :])
                for held, part in zip(out, (of_a[at + i], of_b[j], s[i, j])):
                    held.append(part)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["document", "other", "avg_similarity"])

    return side(block, every).groupBy("i", "j").cogroup(side(every, block).groupBy("i", "j")).applyInArrow(cell, "document long, other long, avg_similarity double")


def document_extremes(pages: DataFrame, least: float, size: int) -> DataFrame:
    """``document, other, best, average, n``: over all page pairs of two documents, where the best
    similarity is above ``least``.

    Blocks of pages that lie near enough meet and pass on the best of two documents; only for the pairs
    found, the average comes from the documents' sums of unit vectors.
    """
    pages = pages.filter(valid(F.col("vec"), size))
    near = similar_groups(pages, size, least).withColumn("best", F.round("best", 6)).filter(F.col("best") > least)
    means = document_vectors(pages, size).join(pages.groupBy(F.col("grp").alias("document")).agg(F.count(F.lit(1)).alias("pages")), "document")
    means = materialize(means, "means")
    side = lambda s: means.select(F.col("document").alias(s), F.col("vec").alias(f"v{s}"), F.col("pages").alias(f"n{s}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    return both.select(F.col("a").alias("document"), F.col("b").alias("other"), "best", F.round(dot(F.col("va"), F.col("vb")), 6).alias("average"), (F.col("na") * F.col("nb")).alias("n"))


def document_bands(pages: DataFrame, size: int, t: Thresholds = DEFAULT) -> DataFrame:
    """``document, other, similarity, status``: pairs of documents whose vectors are similar or duplicate, by band."""
    docs = document_vectors(pages, size).select(F.col("document").alias("id"), F.col("document").alias("grp"), "vec")
    near = similar_groups(materialize(docs, "document_vectors"), size, t.vector_similar).select("a", "b", F.round("best", 6).alias("similarity"))
    return near.filter(F.col("similarity") >= t.vector_similar).select(F.col("a").alias("document"), F.col("b").alias("other"), "similarity", band(F.col("similarity"), t.vector_duplicate, t.vector_similar).alias("status"))


def nearest_documents(pages: DataFrame, size: int, t: Thresholds = DEFAULT) -> DataFrame:
    """Document-level match: the most similar other document vector, with its band."""
    docs = document_vectors(pages, size).select(F.col("document").cast("long").alias("id"), F.col("document").alias("grp"), "vec")
    best = neighbours(docs, docs, 1).filter("rank = 1")
    return best.select(F.col("q_id").alias("document"), F.col("r_id").alias("best_document"), "similarity", band(F.col("similarity"), t.vector_duplicate, t.vector_similar).alias("status"))


def document_verdicts(pages: DataFrame, size: int, t: Thresholds = DEFAULT) -> DataFrame:
    """Two-stage check: the document vectors, then the pages; the higher one names the method."""
    doc = nearest_documents(pages, size, t).select("document", F.col("best_document").alias("d_doc"), F.col("similarity").alias("d_sim"))
    page = version_votes(pages, t).select(F.col("document").alias("_doc"), F.col("best_document").alias("p_doc"), F.col("similarity").alias("p_sim"))
    by_page = F.coalesce((F.col("d_sim") <= t.document_short_circuit) & (F.col("p_sim") > F.col("d_sim")), F.lit(False))
    joined = doc.join(page, F.col("document") == F.col("_doc"), "left")
    sim = F.when(by_page, F.col("p_sim")).otherwise(F.col("d_sim"))
    return joined.select("document", F.when(by_page, F.col("p_doc")).otherwise(F.col("d_doc")).alias("most_similar"), sim.alias("similarity"), F.when(by_page, "page").otherwise("document").alias("method"), (sim > t.document_final).alias("is_duplicate"))


def classify_requirements(new: DataFrame, stored: DataFrame, t: Thresholds = DEFAULT, verified: str = "similarity >= 0") -> DataFrame:
    """New requirements ``id, grp, vec`` against stored ones, never against each other.

    From ``requirement_certain`` on a match is a duplicate; from ``requirement_duplicate`` on
    it is one if ``verified``, a predicate over the row, holds.
    """
    best = neighbours(new, stored, 1).filter("rank = 1")
    flag = (F.col("similarity") >= t.requirement_certain) | ((F.col("similarity") >= t.requirement_duplicate) & F.expr(verified))
    joined = new.select(F.col("id").alias("requirement_id")).join(best, F.col("requirement_id") == F.col("q_id"), "left")
    return joined.select("requirement_id", F.col("r_id").alias("nearest_id"), "similarity", F.coalesce(flag, F.lit(False)).alias("is_duplicate"), F.when(flag, F.col("r_id")).alias("duplicate_of"), F.coalesce((F.col("similarity") >= t.requirement_duplicate) & (F.col("similarity") < t.requirement_certain), F.lit(False)).alias("needs_check"))




def nearest_page_documents(pages: DataFrame, size: int, t: Thresholds = DEFAULT) -> DataFrame:
    """A document's vector against all pages of other documents: the document of the nearest page."""
    docs = document_vectors(pages, size).select(F.col("document").cast("long").alias("id"), F.col("document").alias("grp"), "vec")
    tagged = pages.select((F.col("id") + F.lit(1 << 40)).alias("id"), "grp", "vec")
    best = neighbours(docs, tagged, 1, same_group=False)
    owner = pages.select((F.col("id") + F.lit(1 << 40)).alias("_id"), F.col("grp").alias("best_document"))
    return best.join(owner, F.col("r_id") == F.col("_id")).select(F.col("q_id").alias("document"), "best_document", "similarity", (F.col("similarity") >= t.vector_similar).alias("is_similar"))


def page_outcomes(classified: DataFrame) -> DataFrame:
    """Counters and verdict per document of pages ``grp, status``."""
    of = lambda *s: F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0)).cast("long")
    counted = classified.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), of("duplicate").alias("duplicate"), of("similar", "update").alias("updated"), of("new").alias("new"))
    verdict = F.when(F.col("updated") > 0, "new version").when(F.col("duplicate") == F.col("total"), "complete duplicate").when(F.col("duplicate") > 0, "partial duplicate").otherwise("completely new")
    return counted.withColumn("verdict", verdict)


def classify_chunks(new: DataFrame, stored: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Chunks ``id, grp, hash, vec``: an equal hash is a duplicate of the first such chunk, else the
    nearest vector's band decides; a chunk without a valid vector is new."""
    first = stored.groupBy(F.col("hash").alias("_hash")).agg(F.min("id").alias("same"))
    hashed = new.join(first, F.col("hash") == F.col("_hash"), "left")
    near = neighbours(hashed.filter("same IS NULL").select("id", "grp", "vec"), stored.select("id", "grp", "vec"), 1).select(F.col("q_id").alias("_q"), "r_id", "similarity")
    joined = hashed.join(near, F.col("id") == F.col("_q"), "left")
    by_vector = F.when(F.col("similarity") >= t.vector_duplicate, "duplicate").when(F.col("similarity") >= t.vector_similar, "update").otherwise("new")
    status = F.when(F.col("same").isNotNull(), "duplicate").otherwise(F.coalesce(by_vector, F.lit("new")))
    return joined.select("id", status.alias("status"), F.coalesce("same", "r_id").alias("match_id"), F.when(F.col("same").isNotNull(), F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"))


def update_status(matches: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Status of matches ``document, page, ts, match_document, match_page, match_ts, similarity``: the
    same page is an update if it is newer, else a duplicate; another page is one by similarity."""
    same = (F.col("document") == F.col("match_document")) & (F.col("page") == F.col("match_page"))
    status = F.when(same & (F.col("ts") > F.col("match_ts")), "update").when(same | (F.col("similarity") >= t.vector_duplicate), "duplicate").otherwise("new")
    return matches.withColumn("status", F.coalesce(status, F.lit("new")))
