"""Tables whose other columns have the names that operators use inside, and types that can't be hashed."""

import pytest
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, mixing, quality_rules, simhash, toxicity, url_filters
from tesserae.operators import hot_join

NAMES = ["_id", "_again", "_fp", "_hot", "row", "key", "own_id", "word_id", "mask", "maybe", "bits", "keep", "keep_fp", "rank", "block", "source_", "_key", "_bucket", "text_sha256"]
TEXT = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, TEXT, "a"), (2, TEXT, "b"), (2, "other words " * 20, "a"), (2, TEXT, None), (3, None, "a"), (None, "", "b"), (4, TEXT + " x", "a"), (5, "w" * 200_000 + " z" * 100, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)], F.create_map(F.lit("k"), F.lit(1)).alias("tags"), F.array(F.create_map(F.lit("k"), F.col("doc_id"))).alias("more"))


def ids(df):
    return sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["text"] or "") for x in df.collect())


@pytest.mark.parametrize("broadcast_ids", [2_000_000, 0])
def test_near_duplicates_are_dropped_whatever_the_columns(spark, clashing, monkeypatch, broadcast_ids):
    monkeypatch.setattr(hot_join, "BROADCAST_IDS", broadcast_ids)
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.schema["tags"].dataType == clashing.schema["tags"].dataType
    plain = simhash.drop_near_duplicates(clashing.select("doc_id", "text", "source"))
    assert ids(kept) == ids(plain) and len(ids(kept)) == 5
    assert simhash.drop_near_duplicates(clashing.limit(0)).count() == 0


def test_mixing_keeps_all_rows_whatever_the_columns(clashing):
    mixed = mixing.mixed_rows(clashing)
    assert mixed.columns == clashing.columns and ids(mixed) == ids(clashing)
    assert mixing.mix(clashing).select("position").distinct().count() == 8


def test_copies_are_dropped_whatever_the_columns(clashing):
    # TEXT stays once with the largest id, and null and empty texts are one.
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert ids(kept) == ids(clashing.filter("doc_id > 1 OR doc_id IS NULL").filter("NOT (text = '' AND doc_id IS NULL)").dropDuplicates(["doc_id", "text"]))


def test_ledger_and_severity_give_each_row(spark, clashing):
    told = {(x["doc_id"], x["n_words"]) for x in quality_rules.ledger(clashing).collect()}
    assert told == {(1, 10), (2, 10), (2, 40), (3, 0), (None, 0), (4, 11), (5, 101)}
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.severity(clashing, toxicity.train(clashing, labels)).count() == 8


def test_hosts_that_are_addresses_and_entries_of_one_label(spark):
    urls = ["http://[2001:db8::1]:80/a", "http://[2001:db8::2]/", "http://10.3.5.6/x", "http://a.evil/x", "http://5.6/", "http://evil/", None]
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string").withColumn("at", F.lit("2024-02-01").cast("timestamp"))
    entries = [("[2001:db8::1]", "block"), ("5.6", "block"), ("[2001", "block"), ("evil", "block")]
    listed = spark.createDataFrame(entries, "entry string, action string").withColumn("since", F.lit("2024-01-01").cast("timestamp"))
    found = {x["id"]: x["matched"] for x in url_filters.filter_captures(captures, listed, "id", "url", "at").collect()}
    assert found == {0: "[2001:db8::1]", 1: None, 2: None, 3: "evil", 4: "5.6", 5: "evil", 6: None}
    two = listed.filter("entry <> 'evil'")
    assert {x["id"] for x in url_filters.filter_captures(captures, two, "id", "url", "at").filter("verdict = 'block'").collect()} == {0, 4}
