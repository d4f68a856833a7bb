"""An inverted-file index of vectors in a folder: exact search by triangle bounds, or a few cells only.

Centroids are fitted once, on a bounded sample.  Every vector goes to its nearest centroid's cell and,
by its distance to it, to a ring of the cell; rings are cut into blocks of bounded size, so that a
cell that holds a third of all rows is many blocks.  New vectors go to the same cells, in new blocks.

Distances are those of unit vectors, so that d^2 = 2 - 2 cos, and a query at distance d of a centroid
is at least max(d - hi, lo - d) from each vector of a ring with distances lo to hi.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import valid
from ..sources.scratch import materialize, scratch_path
from ..sources.tables import append_table, read_table, replace_table

#: Cells: the root of the number of rows, up to this, and up to so many numbers of all centroids.
MAX_CELLS, CENTROID_VALUES = 1024, 1 << 20
#: Numbers of the sample that centroids are fitted on, and rounds of the fit.
SAMPLE_VALUES, FIT_ROUNDS = 4_000_000, 8
#: Rings of a unit of distance; distances end at 2.
RINGS = 8
BLOCK_ROWS = 4096
#: Queries that are sent to a ring in one row.
QUERY_ROWS = 1024
#: Similarities are rounded to 6 places; a bound must not cut what rounds up.
MARGIN = 2e-6
#: Stands for a null group.
NO_GROUP = -(1 << 63)
#: The nearest cells of a query, which give its bound.
FIRST_PROBES = 2
#: Share of the cells that an approximate search looks into.
PROBED_SHARE = 0.75

_BLOCKS = "cell int, ring int, number int, n long, lo double, hi double, ids binary, grps binary, vectors binary"


def units(vectors: list | np.ndarray) -> np.ndarray:
    m = np.asarray(vectors, np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1 - 2 * unit @ centroids.T + (centroids * centroids).sum(1), 0))


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from the first rows of a sample of unit vectors; an empty cell stays where it is."""
    centroids = sample[:cells].copy()
    for _ in range(FIT_ROUNDS):
        owner = np.concatenate([_distances(sample[a : a + 8192], centroids).argmin(1) for a in range(0, len(sample), 8192)])
        count = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


def _rows(rows: DataFrame, size: int) -> DataFrame:
    """Whole vectors of ``size`` numbers; rows without an id can't be found, nor ask."""
    finite = ~F.exists("vec", lambda x: F.abs(x.cast("double")) == float("inf"))
    own = rows.filter(F.col("id").isNotNull() & valid(F.col("vec"), size) & F.coalesce(finite, F.lit(False)))
    return own.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), F.col("vec").cast("array<double>").alias("vec"))


class VectorIndex:
    """The index of one folder: ``centroids`` and ``blocks`` below it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        told = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r["vec"] for r in told], np.float64)
        self.size, self.width = self.centroids.shape[1], told[0]["rings"]

    @classmethod
    def build(cls, rows: DataFrame, folder: str, size: int, cells: int | None = None, rings: int = RINGS) -> VectorIndex:
        """Index ``id, grp, vec``: long ids and groups, vectors of ``size`` numbers; 0 ``rings`` make a cell one ring.

        Vectors that are null, of another size, all zero or not finite are left out, as are null ids;
        a repeated id is several vectors.  Of an empty table the one centroid is zero.
        """
        spark = rows.sparkSession
        own = _rows(rows, size)
        n = own.count()
        bound = min(MAX_CELLS, max(CENTROID_VALUES // size, 1))
        cells = min(cells or round(n**0.5), bound) or 1
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_VALUES // size).select("vec")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [units(_matrix(b.column(0))) for b in batches if len(b)]
            found = fit(np.concatenate(parts), cells) if parts else np.zeros((1, size))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([rings] * len(found), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["cell", "rings", "vec"])

        sample.coalesce(1).mapInArrow(run, "cell int, rings int, vec array<double>").write.mode("errorifexists").parquet(f"{folder}/centroids")
        index = cls(spark, folder)
        replace_table(spark.createDataFrame([], _BLOCKS), f"{folder}/blocks")
        index.add(rows)
        return index

    def blocks(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/blocks")

    def rings(self) -> list[tuple[int, int, int, float, float]]:
        """``cell, ring, blocks, lo, hi``: 17 rings of each cell at most."""
        of = self.blocks().groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("blocks"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return [tuple(r) for r in of.orderBy("cell", "ring").collect()]

    def add(self, rows: DataFrame) -> None:
        """Put more rows into the cells there are; nothing that is stored is read but the rings' counts."""
        centroids, width = self.centroids, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    distance = _distances(units(_matrix(batch.column(2))), centroids)
                    cell = distance.argmin(1)
                    near = distance[np.arange(len(cell)), cell]
                    told = [pa.array(cell.astype(np.int32)), pa.array((near * width).astype(np.int32)), pa.array(near)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *told], ["id", "grp", "vec", "cell", "ring", "near"])

        placed = _rows(rows, self.size).mapInArrow(run, "id long, grp long, vec array<double>, cell int, ring int, near double")
        placed = materialize(placed, "placed")
        first = {(c, r): b for c, r, b, _, _ in self.rings()}
        counts = placed.groupBy("cell", "ring").count().collect()
        table = [(c, r, first.get((c, r), 0), -(-n // BLOCK_ROWS)) for c, r, n in counts]
        known = self.spark.createDataFrame(table, "cell int, ring int, first int, parts int")
        dealt = placed.join(F.broadcast(known), ["cell", "ring"]).withColumn("number", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

        def pack(t: pa.Table) -> pa.Table:
            near = t.column("near").to_numpy()
            grp = t.column("grp").combine_chunks()
            held = grp.fill_null(NO_GROUP).to_numpy()
            values = [t.column(c)[0].as_py() for c in ("cell", "ring", "number")] + [len(t), near.min(), near.max()]
            values += [t.column("id").to_numpy().astype("<i8").tobytes(), held.astype("<i8").tobytes(), _matrix(t.column("vec")).astype("<f8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _BLOCKS.split(", ")])

        slim = dealt.select("cell", "ring", "number", "near", "id", "grp", "vec")
        append_table(slim.groupBy("cell", "ring", "number").applyInArrow(pack, _BLOCKS), f"{self.folder}/blocks")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, same_group: bool = True) -> DataFrame:
        """The ``k`` most similar rows of each query ``id, grp, vec``: ``q_id, r_id, similarity, rank``.

        Similarities are cosines rounded to 6 places, ties go to the smaller id, and a query never meets
        its own id nor, with ``same_group`` false, its group.  With ``probes`` only so many of the nearest
        cells are looked into.  Without, the result is exact.  The nearest cells give a bound for each
        query; of the others, only rings that can hold something as near are looked into, and only what
        is as near is passed on.  A query's id must not repeat.
        """
        own = _rows(queries, self.size)
        near = _best(self._meet(own, (0, min(FIRST_PROBES, probes or FIRST_PROBES)), None, k, same_group), k)
        if probes is not None and probes <= FIRST_PROBES:
            return near
        near = materialize(near, "nearest_cells")
        reached = near.filter(F.col("rank") == k).select(F.col("q_id").alias("_q"), F.col("similarity").alias("reached"))
        bounded = own.join(reached, F.col("id") == F.col("_q"), "left").drop("_q")
        return _best(near.drop("rank").unionByName(self._meet(bounded, (FIRST_PROBES, probes), "reached", k, same_group)), k)

    def _meet(self, queries: DataFrame, probes: tuple[int, int | None], bound: str | None, k: int, same_group: bool) -> DataFrame:
        """Best rows per query and block: of the cells from the first to the second place by distance, or from
        there on, and with a column ``bound`` only those that reach it."""
        rings, centroids = self.rings(), self.centroids
        of_cell = np.array([r[0] for r in rings], np.int64)
        of_ring, lo, hi = (np.array([r[i] for r in rings]) for i in (1, 3, 4))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Cells without rows aren't looked into, so they don't count as probes.
            full, made = np.unique(of_cell), 0
            for batch in batches:
                for a in range(0, len(batch), QUERY_ROWS):
                    part = batch.slice(a, QUERY_ROWS)
                    vectors = _matrix(part.column(2))
                    distance = _distances(units(vectors), centroids)
                    nearest = full[np.argsort(distance[:, full], axis=1, kind="stable")[:, probes[0] : probes[1]]]
                    probed = np.zeros((len(part), len(centroids)), bool)
                    np.put_along_axis(probed, nearest, True, 1)
                    wanted, reached = probed[:, of_cell], np.full(len(part), -2.0)
                    if bound is not None:
                        d = distance[:, of_cell]
                        least = np.maximum(np.maximum(d - hi, lo - d), 0)
                        reached = part.column(3).fill_null(-2.0).to_numpy(zero_copy_only=False)
                        wanted &= 1 - least * least / 2 >= reached[:, None] - MARGIN
                    ids, grps = part.column(0).to_numpy(), part.column(1).fill_null(NO_GROUP).to_numpy()
                    for r in np.flatnonzero(wanted.any(0)).tolist():
                        own = wanted[:, r]
                        row = [int(of_cell[r]), int(of_ring[r]), (TaskContext.get().partitionId() << 32) + made]
                        row += [x[own].astype(k).tobytes() for x, k in ((ids, "<i8"), (grps, "<i8"), (vectors, "<f8"), (reached, "<f8"))]
                        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["cell", "ring", "slice", "q_ids", "q_grps", "q_vectors", "q_reached"])
                    made += 1

        found = "cell int, ring int, slice long, q_ids binary, q_grps binary, q_vectors binary, q_reached binary"
        if not rings:
            return self.spark.createDataFrame([], "q_id long, r_id long, similarity double")
        asked = queries.select("id", "grp", "vec", *([bound] if bound else [])).mapInArrow(choose, found)
        asked = materialize(asked, "asked")
        asking = {(c, r): n for c, r, n in asked.groupBy("cell", "ring").agg(F.sum(F.octet_length("q_ids") / 8)).collect()}
        table = [(c, r, b, -(-int(asking[c, r]) // BLOCK_ROWS)) for c, r, b, _, _ in rings if (c, r) in asking]
        known = F.broadcast(self.spark.createDataFrame(table, "cell int, ring int, blocks int, parts int"))
        part = F.pmod(F.xxhash64("slice"), F.col("parts")).cast("int").alias("part")
        left = asked.join(known, ["cell", "ring"]).select("cell", "ring", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"), "q_ids", "q_grps", "q_vectors", "q_reached")
        right = self.blocks().join(known, ["cell", "ring"]).select("cell", "ring", "number", "ids", "grps", "vectors", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        by = ("cell", "ring", "number", "part")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_nearest(k, same_group), "q_id long, r_id long, similarity double")

    def group_pairs(self, least: float) -> DataFrame:
        """``a, b, best``: groups a < b that have rows with a cosine of ``least`` or more, and the highest one.

        Blocks of two cells meet if their centroids and radii allow such a pair; blocks pass on the best
        of each pair of groups that reaches it.  Rows without a group are in none.
        """
        rings, centroids = self.rings(), self.centroids
        if not rings:
            return self.spark.createDataFrame([], "a long, b long, best double")
        c, hi = centroids[[r[0] for r in rings]], np.array([r[4] for r in rings])
        apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None, :], 0))
        nearest = np.maximum(apart - hi[:, None] - hi[None, :], 0)
        i, j = np.nonzero(np.triu(1 - nearest * nearest / 2 >= least - MARGIN))
        # At most MAX_CELLS ^ 2 / 2 rows where rings are one a cell.
        of = {name: np.array([r[k] for r in rings], np.int32) for k, name in enumerate(("cell", "ring", "blocks"))}
        told = {f"{name}_{s}": of[name][at] for s, at in (("a", i), ("b", j)) for name in of}
        pairs = self.spark.createDataFrame(pa.table({k: pa.array(v) for k, v in told.items()}))
        for s in ("a", "b"):
            pairs = pairs.withColumn(f"number_{s}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{s}") - 1)))
        same = (F.col("cell_a") == F.col("cell_b")) & (F.col("ring_a") == F.col("ring_b"))
        pairs = pairs.filter(~same | (F.col("number_a") <= F.col("number_b")))
        by = [f"{c}_{s}" for s in ("a", "b") for c in ("cell", "ring", "number")]
        pairs = materialize(pairs.select(*by), "block_pairs")
        blocks = self.blocks()

        def side(s: str) -> DataFrame:
            own = blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "ring", "number")], F.col("grps").alias("grps"), F.col("vectors").alias("vectors"))
            joined = pairs.join(own, [f"{c}_{s}" for c in ("cell", "ring", "number")])
            return joined.select(*[F.col(c).alias(c) for c in by], F.col("grps").alias("grps"), F.col("vectors").alias("vectors"))

        met = side("a").groupBy(*by).cogroup(side("b").groupBy(*by)).applyInArrow(_group_best(least), "a long, b long, best double")
        return met.groupBy("a", "b").agg(F.max("best").alias("best"))


def _group_best(least: float):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            (x, of_x), (y, of_y) = ((units(np.frombuffer(t.column("vectors")[0].as_py(), "<f8").reshape(len(g), -1)), g) for t in (left, right) for g in [np.frombuffer(t.column("grps")[0].as_py(), "<i8")])
            for at in range(0, len(x), 256):
                s = x[at : at + 256] @ y.T
                i, j = np.nonzero(s >= least - MARGIN)
                a, b = of_x[at + i], of_y[j]
                apart = (a != b) & (a != NO_GROUP) & (b != NO_GROUP)
                found.append(_highest(np.minimum(a, b)[apart], np.maximum(a, b)[apart], s[i, j][apart]))
        # Groups are long: they must not pass through floats.
        a, b, best = (np.concatenate([np.zeros(0, kind), *[f[k] for f in found]]) for k, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
        a, b, best = _highest(a, b, best)
        return pa.table([pa.array(a), pa.array(b), pa.array(best)], ["a", "b", "best"])

    return cell


def _highest(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with its highest value."""
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], s[first]


def _unpacked(rows: pa.Table, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, groups and unit vectors of packed rows."""
    ids, grps, vectors = (np.frombuffer(b"".join(rows.column(f"{prefix}{c}").to_pylist()), k) for c, k in (("ids", "<i8"), ("grps", "<i8"), ("vectors", "<f8")))
    return ids, grps, units(vectors.reshape(len(ids), -1))


def _nearest(k: int, same_group: bool):
    def cell(q: pa.Table, blocks: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(q) and len(blocks):
            (q_id, q_grp, unit), (r_id, r_grp, right) = (_unpacked(q, "q_"), _unpacked(blocks, ""))
            reached = np.frombuffer(b"".join(q.column("q_reached").to_pylist()), "<f8")
            order = np.argsort(r_id, kind="stable")
            r_id, r_grp, right = r_id[order], r_grp[order], right[order]
            for a in range(0, len(q_id), 256):
                s = np.round(unit[a : a + 256] @ right.T, 6)
                s[q_id[a : a + 256, None] == r_id[None, :]] = -np.inf
                if not same_group:
                    s[(q_grp[a : a + 256, None] == r_grp[None, :]) & (r_grp != NO_GROUP)[None, :]] = -np.inf
                s[s < reached[a : a + 256, None]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, best, 1)
                i, j = np.nonzero(value > -np.inf)
                for x, y in zip(out, (q_id[a + i], r_id[best[i, j]], value[i, j])):
                    x.append(y)
        columns = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c) for c in columns], ["q_id", "r_id", "similarity"])

    return cell


def _best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "r_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def default_probes(index: VectorIndex) -> int:
    """So many cells that a search finds nine of ten neighbours, as tests measure."""
    return max(round(len(index.centroids) * PROBED_SHARE), 1)


def similar_groups(rows: DataFrame, size: int, least: float) -> DataFrame:
    """``a, b, best`` of ``id, grp, vec``: see ``VectorIndex.group_pairs``; the index is a scratch one of cells
    as large as blocks."""
    cells = -(-max(rows.count(), 1) // BLOCK_ROWS) * 2
    return VectorIndex.build(rows, scratch_path(rows.sparkSession, "cells"), size, cells, rings=0).group_pairs(least)
