"""The vector index against plain products, and document pairs by pruned blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.vectors import neighbours
from tesserae.operators import vector_index, versions
from tesserae.plans.queries import QUERIES
from tesserae.sources.scratch import scratch_path

ROWS = "id long, grp long, vec array<double>"


def clustered(seed, n, size=8, around=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(around, size))
    return [(i, i % 9 if i % 11 else None, (middle[i % around] + rng.normal(size=size) / 6).tolist()) for i in range(n)]


ODD = [(None, 1, [1.0] * 8), (901, 1, None), (902, 1, [0.0] * 8), (903, 2, [float("nan")] * 8), (904, 2, [float("inf")] + [1.0] * 7), (905, 2, [1.0] * 7), (906, 3, [None] + [1.0] * 7)]


@pytest.mark.parametrize("block_rows, rings", [(4096, 8), (7, 16), (5, 0)])
def test_exact_search_equals_plain_products(spark, monkeypatch, block_rows, rings):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", block_rows)
    rows = clustered(1, 160)
    rows += [(3, 4, rows[3][2])] * 20  # copies under one id, more than a block
    df = spark.createDataFrame(rows + ODD, ROWS)
    index = vector_index.VectorIndex.build(df.filter("id IS NULL OR id < 60"), scratch_path(spark, "ix"), 8, cells=5, rings=rings)
    index.add(df.filter("id >= 60"))
    again = vector_index.VectorIndex(spark, index.folder)
    assert again.blocks().agg(F.sum("n"), F.max("n")).first()[0] == len(rows)
    asked = df.filter("id % 7 = 1 OR id > 900 OR id IS NULL")
    ids, grps = np.array([r[0] for r in rows]), [r[1] for r in rows]
    unit = vector_index.units([r[2] for r in rows])
    for same_group in (True, False):
        want = set()
        for i in [k for k, r in enumerate(rows) if r[0] % 7 == 1]:
            s = np.round(unit[i] @ unit.T, 6)
            able = [(-s[j], ids[j]) for j in range(len(rows)) if ids[j] != ids[i] and (same_group or grps[i] is None or grps[j] != grps[i])]
            want |= {(int(ids[i]), int(r), -v, n + 1) for n, (v, r) in enumerate(sorted(able)[:4])}
        found = [tuple(x) for x in again.search(asked, 4, same_group=same_group).collect()]
        assert set(found) == want and len(found) == len(want)
    assert again.search(asked, 4, probes=5).count() == again.search(asked, 4).count()


def test_bounds_spare_far_cells(spark):
    df = spark.createDataFrame(clustered(2, 300), ROWS)
    index = vector_index.VectorIndex.build(df, scratch_path(spark, "ix"), 8, cells=6)
    asked = df.filter("id % 10 = 0").withColumn("reached", F.lit(0.9))
    looked = index._meet(asked, (1, None), "reached", 3, True)
    assert looked.select("q_id").distinct().count() < 15  # of 30 queries, few look beyond their own cell
    assert {tuple(x) for x in index.search(asked, 3).collect()} == {tuple(x) for x in neighbours(asked.select("id", "grp", "vec"), df, 3).collect()}


def test_empty_index(spark):
    none = spark.createDataFrame([], ROWS)
    index = vector_index.VectorIndex.build(none, scratch_path(spark, "ix"), 8)
    asked = spark.createDataFrame(clustered(3, 5), ROWS)
    assert index.search(asked, 2).count() == 0 and index.group_pairs(0.5).count() == 0
    index.add(asked)
    assert index.search(asked, 2).count() == 10


def test_recall_of_probed_search(spark):
    rows = QUERIES["vector_index_recall"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 40 and sum(x["found"] for x in rows) >= 0.9 * sum(x["exact"] for x in rows)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_group_pairs_equal_plain_products(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", block_rows)
    rows = [(i, (1 << 60) + i % 13 if i % 17 else None, v) for i, _, v in clustered(4, 150, around=9)]
    unit = vector_index.units([r[2] for r in rows])
    s = unit @ unit.T
    for least in (0.97, 0.5, -2.0):
        want = {}
        for i, x in enumerate(rows):
            for j, y in enumerate(rows):
                if x[1] is not None and y[1] is not None and x[1] < y[1] and s[i, j] >= least:
                    want[x[1], y[1]] = max(want.get((x[1], y[1]), -2), s[i, j])
        found = vector_index.similar_groups(spark.createDataFrame(rows + ODD, ROWS), 8, least).collect()
        assert {(x["a"], x["b"]): pytest.approx(x["best"]) for x in found if x["best"] >= least} == want


def test_document_pairs_with_and_without_a_threshold(spark):
    pages = spark.createDataFrame([(i, i % 12, v) for i, _, v in clustered(5, 240, around=12)], ROWS)
    every = {(x["document"], x["other"]): x["avg_similarity"] for x in versions.document_pairs(pages, 8, block_rows=5).collect()}
    assert len(every) == 66
    some = {(x["document"], x["other"]): x["avg_similarity"] for x in versions.document_pairs(pages, 8, 0.3).collect()}
    assert some == {k: v for k, v in every.items() if v >= 0.3} and 0 < len(some) < 66
    plan = versions.document_pairs(pages, 8)._jdf.queryExecution().executedPlan().toString() + versions.document_extremes(pages, 0.5, 8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
