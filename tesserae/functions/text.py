"""Text expressions: words, sentences, packing, similarity."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType

from ..thresholds import DEFAULT, Thresholds
from .lets import let

WORD = r"[\p{L}\p{N}_]+"


def word_set(text: Column) -> Column:
    """Distinct lower-cased words, Unicode letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def pack(parts: Column, limit: int, separator: str) -> Column:
    """Join neighbours greedily while the result and a separator stay within ``limit`` characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc: Column, part: Column) -> Column:
        held = acc["held"]
        fits = F.length(held) + F.length(part) + len(separator) <= limit
        return F.struct(
            F.when(fits | (held == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(held))).alias("done"),
            F.when(fits & (held != ""), F.concat(held, F.lit(separator), part)).otherwise(part).alias("held"),
        )

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))


def slices(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))


def header_sections(text: Column, limit: int) -> Column:
    """Cut before headers and pack without a separator: the sections join to the text."""
    return pack(F.filter(F.split(text, r"(?=\n#{1,6}\s+[^\n])"), lambda s: s != ""), limit, "")


def paragraph_sections(text: Column, limit: int) -> Column:
    """Pack paragraphs; what is still too long is cut at half the limit."""
    packed = pack(F.split(text, "\n\n"), limit, "\n\n")
    return F.flatten(F.transform(packed, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(slices(s, limit // 2))))


def split_sections(text: Column, limit: int = DEFAULT.max_section_chars) -> Column:
    """Sections of a long text: by headers if that gives several, else by paragraphs."""
    by_header = let(header_sections(text, limit), lambda s: F.when(F.size(s) > 1, s).otherwise(paragraph_sections(text, limit)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(by_header)


def repair_chunk(text: Column, limit: int = DEFAULT.max_chunk_chars) -> Column:
    """An oversized chunk as packed paragraphs, and those too long as packed sentences."""
    by_paragraph = F.when(F.length(text) * 2 > limit * 3, pack(F.split(text, "\n\n"), limit, "\n\n")).otherwise(F.array(text))
    by_sentence = F.flatten(F.transform(by_paragraph, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(pack(sentences(p), limit, " "))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(by_sentence)


def chunk_text(text: Column, t: Thresholds = DEFAULT) -> Column:
    """A document's chunks; a blank one has none."""
    sections = F.flatten(F.transform(split_sections(text, t.max_section_chars), lambda s: repair_chunk(s, t.max_chunk_chars)))
    chunks = F.filter(sections, lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) != "")
    return F.when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == "", F.array().cast("array<string>")).otherwise(chunks)


def offsets(text: Column, chunks: Column) -> Column:
    """Start of each chunk: from the last end on, else anywhere, else the last end."""

    def step(acc: Column, chunk: Column) -> Column:
        after = F.call_function("locate", chunk, text, acc["at"] + 1)
        anywhere = F.call_function("locate", chunk, text, F.lit(1))
        start = F.when(after > 0, after - 1).when(anywhere > 0, anywhere - 1).otherwise(acc["at"])
        return let(start, lambda s: F.struct(F.concat(acc["starts"], F.array(s)).alias("starts"), (s + F.length(chunk)).alias("at")))

    return F.aggregate(chunks, F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")), step, lambda acc: acc["starts"])


@pandas_udf(DoubleType())
def sequence_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    """difflib's ratio of (new, old), in this order; null gives null."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(new, old)], dtype="float64")


def blended(ratio: Column, words: Column, t: Thresholds = DEFAULT) -> Column:
    """Text similarity: the ratio if nearly identical, else blended with the words' Jaccard."""
    return F.when(ratio >= t.near_identical, ratio).otherwise(0.7 * ratio + 0.3 * words)


def may_be_similar(new: Column, old: Column, words: Column) -> Column:
    """Exact prefilter of a similarity of 0.75 or more, from lengths and the words' Jaccard."""
    lengths = F.least(F.length(new), F.length(old)) / F.greatest(F.length(new), F.length(old))
    return (lengths >= 9 / 19) & ((words >= 0.19) | (lengths >= 0.98))


def sentence_boundary(text: Column, at: Column) -> Column:
    """Whether a sentence ends before position ``at`` (0-based): false at both ends."""
    around = F.substring(text, F.greatest(at - 1, F.lit(1)), F.lit(3))
    two = F.substring(text, at, F.lit(2))
    inside = (at > 0) & (at < F.length(text))
    return F.coalesce(inside & (two.rlike(r"^[.!?]\s") | ((at > 1) & around.rlike(r"^[.!?][\"')\]]\s"))), F.lit(False))


def band(similarity: Column, duplicate: float, similar: float) -> Column:
    return F.when(similarity >= duplicate, "duplicate").when(similarity >= similar, "similar").otherwise("new")


def around(text: Column, at: Column, reach: int = 100) -> Column:
    """The characters from ``reach`` before position ``at`` (0-based) to ``reach`` after it."""
    start = F.greatest(at - reach, F.lit(0))
    return F.substring(text, start + 1, at + reach - start)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, in lower case; empty without a dot inside it."""
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]*)$", 1))


def timestamp_forms(at: Column) -> list[Column]:
    """A time as text: plain, ISO with microseconds, and ISO with the zone UTC."""
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return [F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("plain"), iso.alias("iso"), F.concat(iso, F.lit("+00:00")).alias("iso_utc")]


def token_counter(encode) -> Callable[[Column], Column]:
    """Exact token counts: ``encode`` gives the ids of a text, as a tokenizer does; null counts as none."""

    @pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def truncate_tokens(text: Column, limit: int = 32_768) -> Column:
    """About the first ``limit`` tokens, at four characters each."""
    return F.substring(text, 1, 4 * limit)


def token_truncator(encode, decode, limit: int = 32_768) -> Callable[[Column], Column]:
    """Exactly the first ``limit`` tokens, decoded again; a text of no more tokens stays as it is."""

    @pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or len(ids := encode(t)) <= limit else decode(ids[:limit]))

    return cut
