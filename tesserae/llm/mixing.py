"""Mixing sources to target weights by Pfair scheduling of source blocks.

Each source's rows form blocks.  Block i (from 0) of a source of weight w is released at slot
floor(i / w) and due at slot ceil((i + 1) / w); in every slot the released block that is due
first runs.  As the weights sum to one, every block meets its window, so that after any number
of slots each source is less than one block away from its share.

Weights are exact ratios of the given numbers.  The driver schedules whole blocks, of which there
are MAX_BLOCKS at most: in larger tables blocks hold more rows.  When a source runs out, a new
phase starts: the remaining sources go on with their weights scaled to sum to one, and no row is
dropped or repeated.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize

#: Rows of a block, unless there would be more than MAX_BLOCKS blocks (24 bytes each in the schedule).
BLOCK_ROWS, MAX_BLOCKS = 16, 1 << 20
#: Sources whose share of the rows is p get a weight in proportion to p ** SMOOTHING by default.
SMOOTHING = 0.7
#: A source's rows are ordered within buckets of the id's hash: about this many rows each, and
#: at most MAX_BUCKETS buckets for a source.
BUCKET_ROWS, MAX_BUCKETS = 256, 65_536

Source = str | None


def exact_shares(weights: dict[Source, float]) -> dict[Source, int]:
    """Integers in the exact ratio of the weights, which must be positive."""
    if odd := [s for s, w in weights.items() if not 0 < w < float("inf")]:
        raise ValueError(f"weights must be positive: {sorted(map(str, odd))}")
    ratios = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(r.denominator for r in ratios.values()))
    return {s: int(r * common) for s, r in ratios.items()}


def schedule(blocks: dict[Source, int], weights: dict[Source, float]) -> list[tuple[Source, int, int, int]]:
    """``source, block, slot, phase`` of every block, by earliest deadline first, ties by name."""
    order = {s: k for k, s in enumerate(sorted(blocks, key=lambda s: (s is None, s or "")))}
    left, done = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    out: list[tuple[Source, int, int, int]] = []
    phase = 0
    while left:
        share = exact_shares({s: weights[s] for s in left})
        total, now = sum(share.values()), 0
        # (release, name's place, block, source) and (deadline, name's place, block, source)
        waiting = [(0, order[s], 0, s) for s in left]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int, Source]] = []
        ended = False
        while not ended:
            while waiting and waiting[0][0] <= now:
                _, place, i, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // share[s]), place, i, s))
            _, place, i, s = heapq.heappop(ready)
            out.append((s, done[s] + i, len(out), phase))
            ended = i + 1 == left[s]
            heapq.heappush(waiting, ((i + 1) * total // share[s], place, i + 1, s))
            now += 1
        for _, _, i, s in [*waiting, *ready]:
            left[s] -= i
            done[s] += i
        left = {s: n for s, n in left.items() if n}
        phase += 1
    return out


def default_weights(counts: dict[str | None, int]) -> dict[str | None, float]:
    """Each source's share of the rows to the power SMOOTHING."""
    return {s: float(n) ** SMOOTHING for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[Source, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None) -> DataFrame:
    """All columns of ``docs`` as ``row``, with ``doc_id, source, phase, block, slot, position``.

    ``position`` is ascending in the mixed order, with gaps where a source's last block is not
    full.  Within a source, rows are ordered by a hash of the id, then the id, then a hash of the
    whole row, so that rows that repeat an id have their places too; a null id's place is that of
    its row's hash.  ``weights`` must name every source that occurs, null included; by default they
    follow the row counts.  The table of sources must fit the driver, as their weights do.  With
    ``block_rows`` given, all blocks of that size are scheduled, however many.  Long texts are only
    hashed; an empty table gives an empty result; other columns may have any name.
    """
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`").cast("string").alias("source")
    counts = {r["source"]: r["n"] for r in docs.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = weights or default_weights(counts)
    if missing := counts.keys() - weights.keys():
        raise ValueError(f"no weight for sources {sorted(map(str, missing))}")
    total = sum(counts.values())
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MAX_BLOCKS))
    buckets = min(max(total // BUCKET_ROWS, 1), MAX_BUCKETS)
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, weights)

    own, whole = F.col(f"`{id_col}`"), F.xxhash64(*[_hashable(f) for f in docs.schema.fields])
    key = F.when(own.isNull(), whole).otherwise(F.xxhash64(own))
    bucket = (F.shiftrightunsigned(key, 33) * buckets / F.lit(1 << 31)).cast("long").alias("_bucket")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("doc_id"), source, key.alias("_key"), whole.alias("_whole"), bucket)
    sizes = docs.select(source, bucket).groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select("source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")), "offsets", buckets * len(counts))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_bucket").orderBy(F.shiftrightunsigned("_key", 33), "_key", "doc_id", "_whole")) - 1)
    of = offsets.select(F.col("source").alias("_source"), F.col("_bucket").alias("_of"), "_offset")
    numbered = ranked.join(of, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of"))).withColumn("rank", F.col("_offset") + F.col("_rank"))
    numbered = numbered.select("row", "doc_id", "source", "rank", F.expr(f"rank div {block_rows}").alias("block"))

    slots = F.broadcast(spark.createDataFrame(plan, "_of string, _block long, slot long, phase int"))
    timed = numbered.join(slots, F.col("source").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block")))
    return timed.select("row", "doc_id", "source", "phase", "block", "slot", (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"))


def _hashable(field: T.StructField) -> Column:
    """A column that can be hashed: maps are none, and are told as JSON."""
    column, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
    return F.to_json(F.struct(column.alias("x"))) if "map<" in kind or "variant" in kind else column


def mixed_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, **options: object) -> DataFrame:
    """``docs`` with its own columns, in the mixed order over ascending partitions."""
    return mix(docs, weights, **options).select("position", "row").repartitionByRange("position").sortWithinPartitions("position").select("row.*")
