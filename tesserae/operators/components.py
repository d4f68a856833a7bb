"""Connected components of an edge table.

Each partition contracts its edges to stars.  Few stars are contracted once more by one task;
more go through alternating large-star and small-star rounds, each two joins and two
aggregations over edges.  Nothing but a count or a flag reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

_EDGES = "u long, v long"
#: Up to so many star edges (16 bytes each) are contracted by one task.
ONE_TASK_EDGES = 200_000
#: Edges of a task that contracts, about.
TASK_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (node, smallest node) of the components within one partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    us = [x for x in parent if root(x) != x]
    for at in range(0, len(us), 50_000):
        part = us[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent that has none."""
    both = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return both.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 OR (c > 0 AND p > 0)").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    best = large.groupBy("u").agg(F.min("v").alias("m"))
    others = large.join(best, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(best.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)`` (longs) that has another
    node in its component and is not its root; the root is the smallest node.

    Loops and repeated edges are allowed; null ends are ignored; no edges give no rows.
    """
    pairs = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    own = materialize(pairs.mapInArrow(_contract, _EDGES).distinct(), "edges")
    n = own.count()
    if n <= ONE_TASK_EDGES:
        return own.coalesce(1).mapInArrow(_contract, _EDGES).toDF("node", "root")
    stars = materialize(own.repartition(n // TASK_EDGES + 1, "v").mapInArrow(_contract, _EDGES), "stars")
    while not _is_forest_of_stars(stars):
        stars = materialize(_round(stars), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
