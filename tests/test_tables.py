"""Tables whose writers die, and changes that touch only what they must."""

from pyspark.sql import functions as F

from tesserae.sources import tables
from tesserae.sources.scratch import scratch_path


def test_a_dead_writers_version_is_stepped_over(spark):
    path = scratch_path(spark, "t")
    rows = spark.createDataFrame([(1, "a")], "id long, x string")
    tables.replace_table(rows, path)
    # A writer that died left the next version without its end.
    spark.createDataFrame([("lost",)], "value string").coalesce(1).write.text(f"{path}/v=2")
    fs, at = tables._fs(spark, f"{path}/v=2/_SUCCESS")
    assert fs.delete(at, False)
    assert tables.current_version(spark, path) == "v=1" and tables.read_table(spark, path).count() == 1
    assert tables.append_table(rows, path) == "v=3" and tables.read_table(spark, path).count() == 2
    assert tables.append_table(rows, path) == "v=4" and tables.read_table(spark, path).count() == 3


def test_only_folders_that_hold_the_rows_are_written_anew(spark):
    path = scratch_path(spark, "t")
    for i in range(4):
        tables.append_table(spark.range(10 * i, 10 * i + 10).withColumn("x", F.lit("a")), path)
    before = tables._parts(spark, path, tables.current_version(spark, path))
    tables.delete_rows(spark, path, F.col("id").isin(3, 14))
    after = tables._parts(spark, path, tables.current_version(spark, path))
    assert len(set(before) & set(after)) == 2 and len(set(after) - set(before)) == 1
    tables.replace_keys(spark.range(25, 27).withColumn("y", F.lit(1)), path, "id", spark.createDataFrame([(25,), (26,), (99,)], "id long"))
    last = tables._parts(spark, path, tables.current_version(spark, path))
    assert len(set(after) & set(last)) == 2 and len(set(last) - set(after)) == 2
    rows = {r["id"]: (r["x"], r["y"]) for r in tables.read_table(spark, path).collect()}
    assert set(rows) == set(range(40)) - {3, 14} and rows[25] == (None, 1) and rows[27] == ("a", None)
    tables.delete_rows(spark, path, F.col("id") > 100)
    assert tables.read_table(spark, path).count() == 38


def test_pages_without_a_file_are_empty(spark, tmp_path):
    from tesserae.sources.readers import page_markdown

    (tmp_path / "page_001.md").write_text("\n  # Title\n\n")
    (tmp_path / "page_002.txt").write_text("no")
    keys = spark.createDataFrame([("page_001",), ("page_002",), ("page_003",), (None,)], "k string")
    assert sorted(map(str, ((r["key"], r["content"]) for r in page_markdown(spark, f"file://{tmp_path}", keys).collect()))) == sorted(map(str, [("page_001", "# Title"), ("page_002", ""), ("page_003", ""), (None, "")]))


def test_kept_versions_tell_by_what_they_were_replaced(spark):
    from tesserae.plans.ingestion import Policy, run

    root = scratch_path(spark, "kept")
    text = "The valve shall close within two seconds of the signal, and the pump shall stop at once, version {}."
    for n in (1, 2, 3):
        files = spark.createDataFrame([("a", text.format(n)), ("b", f"Another file, number {n * 7}, that says something else in each of its versions.")][: 3 - n or 1], "path string, content string")
        run(files, root, policy=Policy(on_missing_content="keep"), extractor=lambda t: F.array(F.struct(t.alias("title"), t.alias("description"), t.alias("source_text"))))
    rows = {r["chunk_id"]: r for r in tables.read_table(spark, f"{root}/document_chunks").collect()}
    first, *later = sorted((r for r in rows.values() if r["document_id"] == "a"), key=lambda r: r["chunk_text"])
    assert first["chunk_id"] == "a_chunk_0001" and all(r["chunk_id"].startswith("a_chunk_0001@") for r in later) and len(later) == 2
    # The second version replaced the first, and so did the third: all point to the last one.
    assert first["is_replaced"] and first["replaced_by"] == later[1]["chunk_id"] and not later[1]["is_replaced"]
    assert {r["status"] for r in later} == {"updated"} and tables.read_table(spark, f"{root}/documents").filter("document_id = 'a'").count() == 3
