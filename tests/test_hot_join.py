"""Dropping and finding rows by id: broadcast, filter and shuffle give the same rows."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import hot_join


@pytest.mark.parametrize("limits, in_plan", [((2_000_000, 2_000_000), "none"), ((10, 2_000_000), "filter"), ((10, 64), "shuffle")])
def test_rows_without_dropped_ids(spark, monkeypatch, limits, in_plan):
    monkeypatch.setattr(hot_join, "BROADCAST_IDS", limits[0])
    monkeypatch.setattr(hot_join, "BROADCAST_WORDS", limits[1])
    rows = spark.range(6000).select(F.when(F.col("id") % 100 != 99, F.col("id")).alias("id"), F.lit("t").alias("_id"), F.lit(1).alias("word_id"), F.lit(2).alias("_hot"), F.col("id").alias("place"))
    dropped = spark.range(0, 6000, 3).toDF("id")
    left = hot_join.drop_ids(rows, "id", dropped)
    assert left.columns == rows.columns
    assert sorted(x["place"] for x in left.collect()) == [i for i in range(6000) if i % 100 == 99 or i % 3]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert ("bits" in plan) == (in_plan == "filter")
    likely = {x["place"] for x in hot_join.likely_ids(rows, "id", dropped).collect()}
    assert likely >= {i for i in range(0, 6000, 3) if i % 100 != 99}
    if in_plan != "shuffle":
        assert len(likely) < 2300  # few pass the filter by chance


def test_counted_join_with_clashing_names(spark):
    rows = spark.range(1000).select((F.col("id") % 7 % 3).alias("k"), F.col("id").alias("_hot"), F.lit("x").alias("_Id"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = hot_join.join_counted(rows, counted, "k", "n", 1000)
    assert joined.count() == 1000 and sum(r["_hot"] for r in joined.collect()) == 499500
