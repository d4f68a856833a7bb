"""Word-blocked Bloom filters as relations, built and probed with SQL functions only.

A filter is a table ``(word_id, bits)`` of 64-bit words.  A key chooses one word and a few
bits in it, so that a probe is one equi-join on ``word_id`` and one bit test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word that a key sets.
BITS_PER_KEY = 4


def bloom_address(key: Column, words: int) -> tuple[Column, Column]:
    """``(word_id, mask)`` of a 64-bit key; ``words`` is the number of words of the filter."""
    word = F.pmod(F.xxhash64(key, F.lit("word")), F.lit(words)).alias("word_id")
    spread = F.xxhash64(key, F.lit("mask"))
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        six = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), six))
    return word, mask.alias("mask")


def bloom_words(addresses: DataFrame) -> DataFrame:
    """The filter's table from rows of ``(word_id, mask)``; empty words are absent."""
    return addresses.groupBy("word_id").agg(F.bit_or("mask").alias("bits"))


def bloom_hit() -> Column:
    """Whether a row joined with the filter's table on ``word_id`` may be in it."""
    return F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
