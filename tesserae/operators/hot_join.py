"""Joins and filters that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import bloom_address, bloom_hit, bloom_words
from ..sources.scratch import materialize

#: A key with more than 1/HOT_SHARE of the rows is hot: there are fewer than HOT_SHARE such keys.
HOT_SHARE = 512
#: A filter of more words than this (16 bytes each) is joined by shuffle, not broadcast.
BROADCAST_WORDS = 2_000_000
#: Ids of a filter for each of its 64-bit words: one row in a hundred passes it by chance.
IDS_PER_WORD = 4
#: Up to so many ids are broadcast themselves (8 bytes each).
BROADCAST_IDS = 2_000_000


def fresh(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_counted(rows: DataFrame, counted: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Equi-join of ``rows`` with ``counted`` (unique in ``key``) without a hot task.

    ``counted[size]`` holds how many of the ``total`` rows have the key.  Keys with over
    ``total / HOT_SHARE`` rows number below HOT_SHARE, so they are broadcast; each of the
    others holds a bounded share, and is shuffled.
    """
    mark = fresh(rows, "_hot")
    is_hot = F.col(size) > F.lit(max(total // HOT_SHARE, 1))
    hot = counted.filter(is_hot)
    tagged = rows.join(F.broadcast(hot.select(F.col(key).alias(mark))), F.col(key) == F.col(mark), "left")
    to_hot = tagged.filter(F.col(mark).isNotNull()).drop(mark).join(F.broadcast(hot), key)
    to_rest = tagged.filter(F.col(mark).isNull()).drop(mark).join(counted.filter(~is_hot), key)
    return to_hot.unionByName(to_rest)


def _packed(rows: DataFrame, id_col: str, words: int) -> DataFrame:
    """Whole rows as ``row``, and the address of their id in a filter."""
    address = bloom_address(F.col(f"`{id_col}`").cast("long"), words)
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), *address)


def drop_ids(rows: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose id is in ``dropped`` (one column of integers, same name as ``id_col``).

    Up to BROADCAST_IDS ids are broadcast, and nothing shuffles.  Up to IDS_PER_WORD ids for each of
    BROADCAST_WORDS words, a Bloom filter of the dropped ids lets all other rows pass straight through;
    only rows that hit it shuffle to the exact anti-join.  Beyond, all rows shuffle.  A null id is never
    dropped.  Other columns may have any name.
    """
    name = fresh(rows, "_id")
    ids = dropped.select(F.col(id_col).cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct()
    n = ids.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
    ids = materialize(ids.withColumnRenamed(name, "_id"), "dropped")
    words = max(-(-n // IDS_PER_WORD), 64)
    exact = lambda part: part.join(ids, F.col("own_id") == F.col("_id"), "left_anti").select("row")
    packed = _packed(rows, id_col, words)
    if words > BROADCAST_WORDS:
        return exact(packed).select("row.*")
    filter_ = F.broadcast(bloom_words(ids.select(*bloom_address(F.col("_id"), words))))
    probed = packed.join(filter_, "word_id", "left").withColumn("maybe", bloom_hit())
    return probed.filter(~F.col("maybe")).select("row").unionByName(exact(probed.filter("maybe"))).select("row.*")


def drop_keys(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``dropped`` (one column of that name); a null key stays.

    Up to BROADCAST_IDS keys, their hashes are broadcast, and rows of other hashes pass; of the rest only
    keys are compared, so that no whole row shuffles.  Beyond, all rows shuffle.
    """
    name = fresh(rows, "_hash")
    keys = materialize(dropped.select(key).filter(F.col(key).isNotNull()).distinct(), "dropped_keys")
    n = keys.count()
    if n == 0:
        return rows
    if n > BROADCAST_IDS:
        return rows.join(keys, key, "left_anti")
    hashes = F.broadcast(keys.select(F.xxhash64(key).alias(name)).distinct())
    same = F.col(key).isNotNull() & (F.xxhash64(key) == F.col(name))
    # Keys that only share a hash: hardly ever one.
    others = rows.select(key).join(hashes, same, "left_semi").join(keys, key, "left_anti").distinct()
    return rows.join(hashes, same, "left_anti").unionByName(rows.join(F.broadcast(others), key, "left_semi").select(*rows.columns))


def likely_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose id may be in ``ids`` (one long column): those themselves or a Bloom filter
    where that is small enough to broadcast, as in ``drop_ids``, else all rows.  It saves a join's
    shuffle, which must follow."""
    name = fresh(rows, "_id")
    known = ids.select(F.col(ids.columns[0]).cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct()
    n = known.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(known), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_semi")
    words = max(-(-n // IDS_PER_WORD), 64)
    if words > BROADCAST_WORDS:
        return rows
    address = bloom_address(F.col(name), words)
    filter_ = F.broadcast(bloom_words(materialize(known, "wanted").select(*address)))
    return _packed(rows, id_col, words).join(filter_, "word_id").filter(bloom_hit()).select("row.*")
