"""URL filters by a temporal list join.

Dated list entries (listed with a verdict, or taken off) become validity intervals per entry.
Each capture asks for the keys of its URL, its host's suffixes and the host with its path's
beginnings, and an as-of join finds the entries that were active when it was fetched.  The
most specific active key decides; what is listed later doesn't act on earlier captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot_join import join_counted, likely_ids
from ..sources.scratch import materialize

#: Host suffixes of fewer labels aren't keys, unless a list has such an entry.
MIN_LABELS = 2
#: Path beginnings of up to so many segments are keys, unless told otherwise.
PATH_SEGMENTS = 2
#: What an entry's event does; of events of the same entry and time the first in this order acts.
ACTIONS = ("allow", "block", "remove")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_keys(url: Column, segments_limit: int = PATH_SEGMENTS, least_labels: int = MIN_LABELS) -> Column:
    """Keys of a URL with their specificity: ``array<struct<key, rank>>``; null or without host: none.

    A host gives its suffixes of ``least_labels`` labels and more; an address, with dots or in brackets,
    is one key, as its parts are no domains.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?", 1)
    labels = F.split(host, r"\.")
    address = host.startswith("[") | host.rlike(r"^\d+(\.\d+){3}$")
    suffixes = F.when(
        (F.size(labels) >= least_labels) & ~address,
        F.transform(F.sequence(F.lit(least_labels), F.size(labels)), lambda n: F.struct(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("key"), n.alias("rank"))),
    ).otherwise(F.array(F.struct(host.alias("key"), F.lit(1).alias("rank"))))
    segments = _segments(path)
    depth = F.least(F.size(segments), F.lit(segments_limit))
    paths = F.when(
        depth >= 1, F.transform(F.sequence(F.lit(1), depth), lambda n: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/")).alias("key"), (n + 1000).alias("rank")))
    ).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))
    return F.when(url.isNull() | (host == ""), F.array().cast("array<struct<key:string,rank:int>>")).otherwise(F.concat(suffixes, paths))


def normal_entry(entry: Column) -> Column:
    """An entry as URLs are asked for: its host in lower case, its path as it is, without empty segments."""
    host = F.substring_index(entry, "/", 1)
    return F.array_join(F.concat(F.array(F.lower(host)), _segments(F.substring(entry, F.length(host) + 1, F.length(entry)))), "/")


def validity(entries: DataFrame) -> DataFrame:
    """``entry, periods`` from events ``entry, action, since``.

    A period is ``(since, until, verdict)``: from an event that allows or blocks to the entry's
    next event; ``until`` is null while none follows.  Of events of an entry at one time the first
    in the order of ``ACTIONS`` acts.  Events without entry, date or known action are ignored.
    """
    order = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    known = entries.filter(F.col("entry").isNotNull() & F.col("since").isNotNull() & F.col("action").isin(*ACTIONS))
    one = known.groupBy(normal_entry(F.col("entry")).alias("entry"), "since").agg(F.min_by("action", order).alias("action"))
    spans = one.withColumn("until", F.lead("since").over(Window.partitionBy("entry").orderBy("since"))).filter(F.col("action") != "remove")
    return spans.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("since", "until", F.col("action").alias("verdict")))).alias("periods"))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """``id, fetched, verdict, matched, listed_since`` for every capture.

    ``verdict`` is ``block`` or ``allow`` by the most specific key that is listed at the time
    of the fetch, ``pass`` without one; path keys are more specific than hosts, and of one host and
    path each depth is one key, so that there are no ties.  A null URL or time, and a URL without
    host, passes.  Path beginnings are asked for down to the list's deepest entry, however long the
    URL, and suffixes of one label where the list has such an entry.  Rows that repeat give rows that repeat; an empty list passes all; an empty table gives an
    empty result; other columns are not read.

    Only keys that the list may hold are joined.  Keys with a large share of these rows are few and
    are broadcast with their periods, the others shuffle; what is found returns to the captures by
    their row number, which no two share.
    """
    listed = materialize(validity(entries), "listed")
    labels = F.size(F.split(F.substring_index("entry", "/", 1), r"\."))
    deepest, shortest = (x or 0 for x in listed.agg(F.max(F.size(F.split("entry", "/")) - 1), F.min(labels)).first())
    rows = captures.select(F.col(id_col).alias("id"), F.col(time_col).cast("timestamp").alias("fetched"), F.col(url_col).cast("string").alias("url"))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "captures")
    asked = rows.select("rid", "fetched", F.inline(url_keys(F.col("url"), deepest, max(min(shortest, MIN_LABELS), 1)))).withColumn("hashed", F.xxhash64("key"))
    asked = likely_ids(asked, "hashed", listed.select(F.xxhash64("entry").alias("hashed"))).drop("hashed")
    per_key = asked.groupBy(F.col("key").alias("entry")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(listed.join(per_key, "entry").withColumnRenamed("entry", "key"), "counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    active = F.get(F.filter("periods", lambda p: (p["since"] <= F.col("fetched")) & (p["until"].isNull() | (F.col("fetched") < p["until"]))), F.lit(0))
    found = join_counted(asked, counted, "key", "n", total).withColumn("p", active).filter(F.col("p").isNotNull())
    best = found.groupBy(F.col("rid").alias("_rid")).agg(F.max(F.struct("rank", "key", F.col("p.verdict").alias("verdict"), F.col("p.since").alias("since"))).alias("hit"))
    joined = rows.join(best, F.col("rid") == F.col("_rid"), "left")
    return joined.select("id", "fetched", F.coalesce("hit.verdict", F.lit("pass")).alias("verdict"), F.col("hit.key").alias("matched"), F.col("hit.since").alias("listed_since"))
