"""Divergence between the sources of a language, from counts of its kept terms, in exact integers.

One pass over the texts counts terms per language and source.  These counts are dealt into
chunks by ranges of (language, term), so that a chunk has all counts of its terms: there the kept
terms are one sorted array, and a term's id is its place in it (``searchsorted``).  Ids follow the
order of UTF-8 bytes, within a chunk and from chunk to chunk.  A group's counts become a dense
vector by ``bincount``, a few thousand ids at a time, and vectors of one language are compared
column by column; sums over chunks give the pairs, the best ids of each chunk the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import byte_runs, distinct, spans
from ..functions.worker import release_memory
from ..sources.scratch import materialize

#: Bytes that end a term: all of ASCII but letters.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Probabilities are counted in parts of this, smoothed by so many occurrences of each term.
UNIT, SMOOTHED = 1_000_000_000, 2
#: Bytes of text that are counted together: arrays of a run's words take about 25 times as much.
RUN_BYTES = 4_000_000
#: Rows of counts in a chunk.
CHUNK_ROWS = 400_000
#: Numbers of a dense slice: sources x ids.
SLICE = 1 << 20


def _count(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """For each (group, term): group, term, documents and occurrences."""
    data = b"\0".join(texts).translate(_LOWER)
    starts, ends = spans(data, SEPARATORS)
    full = ends > starts
    starts, ends = starts[full], ends[full]
    codes, words = distinct(data, starts, ends)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    of = np.searchsorted(begins, starts, "right") - 1
    n = max(len(words), 1)
    seen, times = np.unique(of * n + codes, return_counts=True)
    pairs, place = np.unique(group[seen // n] * n + seen % n, return_inverse=True)
    return pairs // n, [words[i] for i in (pairs % n).tolist()], np.bincount(place, minlength=len(pairs)), np.bincount(place, times, len(pairs)).astype(np.int64)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, docs, n``: in how many rows a term occurs, and how often.

    Every group has a row with the empty term besides, which says how many rows it has.
    """
    names = ["lang", "source", "term", "docs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_runs(batch.column(2), RUN_BYTES):
                langs, sources, texts = (batch.column(i).slice(a, b - a) for i in range(3))
                keys = list(zip(langs.to_pylist(), sources.to_pylist()))
                groups = {k: i for i, k in enumerate(dict.fromkeys(keys))}
                group = np.array([groups[k] for k in keys], np.int64)
                at, words, in_docs, n = _count(texts.cast(pa.binary()).to_pylist(), group)
                all_groups = np.arange(len(groups))
                own = pa.array(np.r_[all_groups, at])
                known = list(groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(pa.array([k[0] for k in known], pa.string()), own),
                        pc.take(pa.array([k[1] for k in known], pa.string()), own),
                        pa.array([b""] * len(groups) + words, pa.binary()).cast(pa.string()),
                        pa.array(np.r_[np.bincount(group, minlength=len(groups)), in_docs].astype(np.int64)),
                        pa.array(np.r_[0 * all_groups, n].astype(np.int64)),
                    ],
                    names,
                )
        release_memory()

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, docs long, n long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _encode(least: int):
    """A chunk's counts, in order of language and term, as ids: a row per language and source, and one
    per language, without a source, that holds the kept terms themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        chunk = TaskContext.get().partitionId()
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        of_lang = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = rows.filter(pa.array(of_lang == i))
            terms = own.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
            in_docs = np.bincount(terms.indices.to_numpy(), own.column("docs").to_numpy(), len(terms.dictionary))
            every = np.array([*terms.dictionary.to_pylist(), None], object)[:-1]
            kept = np.sort(every[in_docs >= least])
            place = np.searchsorted(kept, every)
            known = np.zeros(len(every), bool)
            inside = place < len(kept)
            known[inside] = kept[place[inside]] == every[inside]
            ids = np.where(known, place, -1)[terms.indices.to_numpy()]
            n = own.column("n").to_numpy()
            sources = own.column("source").combine_chunks().dictionary_encode()
            of_source = sources.indices.to_numpy()
            order = np.lexsort((ids, of_source))
            order = order[ids[order] >= 0]
            cuts = np.searchsorted(of_source[order], np.arange(len(sources.dictionary) + 1))
            told = [(lang, chunk, None, [], [], kept.tolist(), len(kept))]
            for source, a, b in zip(sources.dictionary.to_pylist(), cuts, cuts[1:]):
                if b > a:
                    told.append((lang, chunk, source, ids[order[a:b]], n[order[a:b]], [], 0))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int32()]
            names = ["lang", "chunk", "source", "ids", "counts", "terms", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*told), kinds)], names)

    return run


def encoded_chunks(counts: DataFrame, chunk_rows: int = CHUNK_ROWS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, chunk, source, ids, counts, terms, kept``: each source's counts in a chunk by id, and in a
    row without source the chunk's kept terms in order.  Chunk numbers follow the order of terms."""
    rows = counts.filter("term <> ''")
    chunks = -(-max(rows.count(), 1) // chunk_rows)
    dealt = rows.repartitionByRange(chunks, "lang", "term")
    return dealt.mapInArrow(_encode(least), "lang string, chunk int, source string, ids array<int>, counts array<long>, terms array<binary>, kept int")


def parts(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), by long division so that nothing overflows."""
    whole, rest = np.divmod(counts + SMOOTHED, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    """A chunk's dense vectors: sums for each pair of sources, and the best ids of each source.

    Rows are ``lang, chunk, source, ids, counts, terms, kept, total``; ``total`` is N + 2 V of the
    source, or in the row without one that of the language.
    """
    kinds = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64(), "chunk": pa.int32(), "id": pa.int32()}

    def run(table: pa.Table) -> pa.Table:
        source = table.column("source").to_pylist()
        total = table.column("total").to_numpy()
        lang, chunk = table.column("lang")[0].as_py(), table.column("chunk")[0].as_py()
        at = source.index(None)
        terms = table.column("terms")[at].as_py()
        own = [i for i, s in enumerate(source) if s is not None]
        names = [source[i] for i in own]
        ids = [np.array(table.column("ids")[i].values or [], np.int64) if table.column("ids")[i].is_valid else np.zeros(0, np.int64) for i in own]
        times = [np.array(table.column("counts")[i].values or [], np.int64) if table.column("counts")[i].is_valid else np.zeros(0, np.int64) for i in own]
        k, totals = len(own), total[own].astype(np.int64)
        sums, best = np.zeros((k, k), np.int64), [[] for _ in own]
        width = max(SLICE // max(k, 1), 1)
        for a in range(0, len(terms), width):
            b = min(a + width, len(terms))
            dense = np.zeros((k, b - a), np.int64)
            for i in range(k):
                x, y = np.searchsorted(ids[i], (a, b))
                dense[i] = np.bincount(ids[i][x:y] - a, times[i][x:y], b - a)
            p, q = parts(dense, totals[:, None]), parts(dense.sum(0), total[at])
            for i in range(k - 1):
                found = gap(p[i], p[i + 1 :]).sum(1)
                sums[i, i + 1 :] += found
                sums[i + 1 :, i] += found
            for i in range(k):
                able = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = gap(p[i, able], q[able])
                first = np.lexsort((able, -value))[:top]
                best[i] = sorted(best[i] + [(-int(value[j]), int(able[j]) + a) for j in first])[:top]
        out = [(lang, s, "pair", o, int(sums[i, j]), chunk, 0) for i, s in enumerate(names) for j, o in enumerate(names) if i != j]
        out += [(lang, s, "term", terms[t].decode(), -v, chunk, t) for s, of in zip(names, best) for v, t in of]
        columns = list(zip(*out)) or [[] for _ in kinds]
        return pa.table([pa.array(list(x), kind) for x, kind in zip(columns, kinds.values())], list(kinds))

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", chunk_rows: int = CHUNK_ROWS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) of the rows.

    Part ``pair`` compares a source with each other source of its language, part ``term`` gives the
    up to ten terms that set it apart from the language.  Null language, source or text count as ''.
    Texts of any length are read whole.  A source without terms is compared too; a language that keeps
    no term gives 0 for all pairs.  Repeated rows count as often as they occur, equal values go by the
    item's bytes, an empty table gives no row, and other columns are not read.
    """
    counts = materialize(term_counts(docs, lang_col, source_col, text_col), "term_counts")
    groups = counts.filter("term = ''").select("lang", "source")
    chunks = materialize(encoded_chunks(counts, chunk_rows, least), "encoded_chunks")
    n = F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    of_source = chunks.filter("source IS NOT NULL").groupBy("lang", "source").agg(F.sum(n).alias("n"))
    of_lang = chunks.groupBy("lang").agg(F.sum(n).alias("all"), F.sum("kept").alias("v"))
    sized = groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    totals = sized.select("lang", "source", (F.coalesce("n", F.lit(0)) + SMOOTHED * F.coalesce("v", F.lit(0))).alias("total"))
    totals = materialize(totals.unionByName(of_lang.select("lang", F.lit(None).cast("string").alias("source"), (F.col("all") + SMOOTHED * F.col("v")).alias("total"))), "totals")
    # Every source has a vector in every chunk of its language that keeps a term.
    cells = chunks.filter("source IS NULL AND kept > 0").select("lang", "chunk")
    full = totals.join(cells, "lang").select(F.col("lang").alias("_l"), F.col("chunk").alias("_c"), F.col("source").alias("_s"), "total")
    same = (F.col("lang") == F.col("_l")) & (F.col("chunk") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_s"))
    vectors = full.join(chunks, same, "left").select(F.col("_l").alias("lang"), F.col("_c").alias("chunk"), F.col("_s").alias("source"), "ids", "counts", "terms", "total")
    told = vectors.groupBy("lang", "chunk").applyInArrow(_compare(TOP_TERMS), "lang string, source string, part string, item string, value long, chunk int, id int")
    told = materialize(told, "compared")
    pairs = told.filter("part = 'pair'").groupBy("lang", "source", F.col("item")).agg(F.sum("value").alias("value"))
    other = groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"))
    every = groups.join(other, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))).select("lang", "source", "item")
    pairs = every.join(pairs, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    pairs = _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"), F.col("item"))
    terms = told.filter("part = 'term'").select("lang", "source", "part", "item", "value", F.struct("chunk", "id").alias("place"))
    return pairs.unionByName(_ranked(terms, F.col("place")).drop("place").filter(F.col("rank") <= TOP_TERMS))


def _ranked(rows: DataFrame, then: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), then)))
