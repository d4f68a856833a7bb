"""Exact deduplication by two-pass Bloom filtering, with SQL functions only.

Pass 1 inserts every row's digest into a word-blocked Bloom filter whose words are dealt
over the reducers: what crosses the network is a 16-byte address and a count, combined on
the map side, never the row.  An address that is set twice goes to the filter of possibly
repeated digests.  Pass 2 probes that filter; only the rows that hit shuffle, and all others
pass straight through as unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import bloom_address, bloom_hit, bloom_words
from ..operators.hot_join import BROADCAST_WORDS, join_counted
from ..sources.scratch import materialize

def _text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def repeat_filter(digests: DataFrame, words: int) -> DataFrame:
    """Pass 1: the filter ``(word_id, bits)`` of the digests that are set twice or more."""
    word, mask = bloom_address(F.col("text_sha256"), words)
    twice = digests.select(word, mask).groupBy("word_id", "mask").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bloom_words(twice)


def probe(rows: DataFrame, repeats: DataFrame, words: int, small: bool) -> DataFrame:
    """Pass 2: ``rows`` with ``maybe``, whether their digest may be repeated."""
    word, mask = bloom_address(F.col("text_sha256"), words)
    joined = rows.withColumns({"word_id": word, "mask": mask}).join(F.broadcast(repeats) if small else repeats, "word_id", "left")
    return joined.withColumn("maybe", bloom_hit()).drop("word_id", "mask", "bits")


class _Plan:
    """Materialized digests and the repeat filter of one input."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        ids = docs.select(F.col(id_col).alias("doc_id"), _text_digest(F.col(text_col)).alias("text_sha256"))
        self.digests = materialize(ids.withColumn("row_id", F.monotonically_increasing_id()), "digests")
        self.total = self.digests.count()
        self.words = max(self.total // 2, 64)
        self.repeats = materialize(repeat_filter(self.digests, self.words), "repeats", self.total)
        self.small = self.repeats.count() <= BROADCAST_WORDS

    def decisions(self) -> DataFrame:
        probed = probe(self.digests, self.repeats, self.words, self.small)
        maybe = probed.filter("maybe").drop("maybe")
        groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        matched = join_counted(maybe, groups, "text_sha256", "group_size", self.total)
        repeated = matched.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256")
        once = probed.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        return once.unionByName(repeated)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the
    largest id stays, a null id being the smallest; of rows repeated with the same id and
    text exactly one has ``kept``.  An empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    return _Plan(docs, id_col, text_col).decisions()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the repeat filter rules out pass straight through with their text; only
    possible copies shuffle.  Of rows that repeat both id and text one stays.
    """
    plan = _Plan(docs, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), _text_digest(F.col(text_col)).alias("text_sha256"))
    probed = probe(packed, plan.repeats, plan.words, plan.small)
    through = probed.filter(~F.col("maybe")).select("row")
    maybe = probed.filter("maybe").select("row", "doc_id", "text_sha256")
    losers = plan.decisions().filter("NOT kept").select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id"), F.col("keep_id").alias("_keep"))
    lost = losers.filter(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_sha", "_id").distinct()
    left = maybe.join(lost, (F.col("text_sha256") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    one = left.groupBy("text_sha256", "doc_id").agg(F.first("row").alias("row")).select("row")
    return through.unionByName(one).select("row.*")
