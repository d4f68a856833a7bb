"""Centroid clustering in exact integers: Lloyd's rounds that pay for what has changed.

Vectors lie in blocks of a bucketed table that is written once.  What a round decides, a block's
owners and distances, is a second table with the same buckets, so that the two meet without a
shuffle.  A vector whose centroid stayed meets the changed centroids only, as its distance to
its own is stored and all others were no nearer before; one whose centroid changed meets all.
Vectors that change hands give signed transfers: minus from the old owner, plus to the new one.
The driver holds sums, counts and centroids, k x 64 integers, and no vector but the first k.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: Components beyond are taken as this: a squared distance then fits a long.
LARGEST = 1 << 27
#: Below this, products of components are exact in double precision.
EXACT = 1 << 22
BLOCK_ROWS = 4096
#: Blocks of a bucket: 64 MB of vectors; and the most buckets that Spark allows, beyond which they grow.
BUCKET_BLOCKS, MAX_BUCKETS = 64, 100_000
#: Distances that are computed at once, per centroid.
AT_ONCE = 1024


def whole(vec: Column, size: int = SIZE) -> Column:
    """Exactly ``size`` components, none null or non-finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vec) == size) & ~F.exists(vec, odd), F.lit(False))


def integers(vec: Column) -> Column:
    """floor(1024 x) of each component."""
    bounded = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vec, lambda x: F.when(F.abs(x.cast("double")) > LARGEST, F.signum(x.cast("double")) * LARGEST).otherwise(bounded(x)).cast("int"))


def _pack(size: int):
    """Rows ``id, vec`` as blocks: ids, which of them are null, and an array of 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held, n
            rows = pa.Table.from_batches(held).combine_chunks()
            at = 0
            while n - at >= BLOCK_ROWS or (last and at < n):
                some = rows.slice(at, BLOCK_ROWS)
                at += len(some)
                ids, vecs = some.column(0).combine_chunks(), some.column(1).combine_chunks()
                null = ids.is_null().to_numpy(zero_copy_only=False)
                values = np.ascontiguousarray(vecs.flatten().to_numpy(zero_copy_only=False).astype("<i4"))
                row = [(part << 32) + made, len(some), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(null).tobytes(), values.tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "n", "ids", "nulls", "vectors"])
            held, n = (rows.slice(at).to_batches() if at < n else []), n - at

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield from blocks(False)
        if n:
            yield from blocks(True)

    return run


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column per centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        out[:] = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
        return out
    for at in range(0, len(vectors), AT_ONCE):
        for j, c in enumerate(centroids):
            gap = vectors[at : at + AT_ONCE].astype(np.int64) - c
            out[at : at + AT_ONCE, j] = (gap * gap).sum(1)
    return out


def assign(vectors: np.ndarray, owner: np.ndarray, near: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after ``changed`` centroids moved; ties go to the smaller number.

    Owners below 0 are none yet.  What a vector keeps, it keeps without being compared.
    """
    owner, near = owner.copy(), near.copy()
    moved = (owner < 0) | np.isin(owner, changed)
    if moved.any():
        found = distances(vectors[moved], centroids)
        owner[moved] = found.argmin(1)
        near[moved] = found.min(1)
    rest = np.flatnonzero(~moved)
    if len(rest) and len(changed):
        order = np.sort(changed)
        found = distances(vectors[rest], centroids[order])
        best, least = order[found.argmin(1)], found.min(1)
        won = (least < near[rest]) | ((least == near[rest]) & (best < owner[rest]))
        owner[rest[won]], near[rest[won]] = best[won], least[won]
    return owner, near


def transfers(vectors: np.ndarray, old: np.ndarray, new: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centroid the signed count and sums of the vectors that came or went."""
    out = {}
    moved = np.flatnonzero(old != new)
    for c in np.union1d(old[moved], new[moved]).tolist():
        if c >= 0:
            came, went = moved[new[moved] == c], moved[old[moved] == c]
            sums = vectors[came].sum(0, dtype=np.int64) - vectors[went].sum(0, dtype=np.int64)
            out[c] = len(came) - len(went), sums.tolist()
    return out


_STATE = "block long, owners binary, near binary, inertia array<long>, moved array<struct<c: int, n: long, sums: array<long>>>"


def _round(centroids: list[list[int]], changed: list[int], size: int):
    points, moved = np.array(centroids, np.int64).reshape(-1, size), np.array(changed, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, size)
                old = np.frombuffer(row["owners"], "<i2").astype(np.int64) if row["owners"] else np.full(row["n"], -1, np.int64)
                near = np.frombuffer(row["near"], "<i8") if row["near"] else np.zeros(row["n"], np.int64)
                new, near = assign(vectors, old, near, points, moved)
                inertia = [int(near[new == c].sum()) for c in range(len(points))]
                told = [{"c": c, "n": n, "sums": sums} for c, (n, sums) in transfers(vectors, old, new).items()]
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))]
                values = [row["block"], new.astype("<i2").tobytes(), near.astype("<i8").tobytes(), inertia, told]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "owners", "near", "inertia", "moved"])

    return run


class _Buckets:
    """Tables bucketed by block in one way, so that joins on it don't shuffle."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex}"
        self.names.append(table)
        path = scratch_path(self.spark, name)
        rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def forget(self) -> None:
        """Drop the names; the files stay in the shared folder until the driver ends."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[: row["n"]].astype(bool)
            ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=null)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(row["owners"], "<i2").astype(np.int32)), pa.array(np.frombuffer(row["near"], "<i8"))], ["vec_id", "cluster", "distance"])


def first_centroids(vectors: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``3:<id>``, in its order; of a repeated id the smaller vector first."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    return [list(r["vec"]) for r in vectors.select(key.alias("key"), "vec").orderBy("key", "vec").limit(clusters).collect()]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every whole vector.

    One row per row that has exactly ``size`` finite components; others give none.  Ids are longs,
    may be null and may repeat: each row counts.  Equal distances go to the smaller number, an empty
    cluster keeps its centroid, and fewer vectors than ``clusters`` make as many centroids.  Values
    beyond 131,072 count as that.  An empty table gives no row; other columns are not read.  When no
    centroid has changed, later rounds would change nothing and are left out.
    """
    spark = vectors.sparkSession
    vec = F.col(f"`{vec_col}`")
    rows = vectors.filter(whole(vec, size)).select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(vec).alias("vec"))
    centroids = first_centroids(rows, clusters)
    wanted = -(-max(rows.count(), 1) // (BLOCK_ROWS * BUCKET_BLOCKS)) + spark.sparkContext.defaultParallelism
    buckets = _Buckets(spark, min(wanted, MAX_BUCKETS))
    packed = rows.mapInArrow(_pack(size), "block long, n long, ids binary, nulls binary, vectors binary")
    blocks = buckets.write(packed.repartition(buckets.buckets, "block"), "blocks")
    held = blocks.select("block", "n", "vectors")
    sums, counts = [[0] * size for _ in centroids], [0] * len(centroids)
    changed, state, done = list(range(len(centroids))), None, 0
    while True:
        if state is None:
            known = held.withColumns({"owners": F.lit(None).cast("binary"), "near": F.lit(None).cast("binary")})
        else:
            known = held.join(state.select("block", "owners", "near").hint("merge"), "block")
        state = buckets.write(known.mapInArrow(_round(centroids, changed, size), _STATE), f"round_{done}")
        if done == rounds:
            break
        gone = state.select(F.inline("moved")).groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
        for c, n, total in gone.collect():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], total)]
        new = [[s // n for s in of] if n else old for of, n, old in zip(sums, counts, centroids)]
        changed = [c for c, (a, b) in enumerate(zip(centroids, new)) if a != b]
        centroids, done = new, done + 1
        if not changed:
            break
    inertia = [r[0] or 0 for r in state.select(F.posexplode("inertia").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x")).orderBy("c").select("x").collect()]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = blocks.select("block", "n", "ids", "nulls").join(state.select("block", "owners", "near").hint("merge"), "block").drop("block")
    result = found.mapInArrow(_unpack, "vec_id long, cluster int, distance long")
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit(None)), F.col("cluster") + 1).cast(kind)
    result = result.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))
    result.schema  # noqa: B018  (names are resolved before they are dropped)
    buckets.forget()
    return result
