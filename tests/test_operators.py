import collections
import difflib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.functions import text as T
from tesserae.functions.diff import diff_lines
from tesserae.functions.vectors import cosine, neighbours, normalize, valid
from tesserae.operators import chunking, ingest, lineage, reports, requirements, versions
from tesserae.operators.components import connected_components
from tesserae.operators.hot_join import drop_ids, join_counted
from tesserae.sources import tables
from tesserae.sources.scratch import materialize, scratch_path
from tesserae.thresholds import DEFAULT


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_sections_join_to_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["# head\n", "\n## sub\n", "word ", "\n\n", "."]) for _ in range(80)) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.header_sections(F.col("t"), 100).alias("s")).collect()
    assert all("".join(r["s"]) == r["t"] for r in rows)


def test_chunks_are_bounded_unless_one_sentence(spark):
    rng = random.Random(2)
    texts = [" ".join("x" * rng.randint(1, 60) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.chunk_text(F.col("t")).alias("c")).collect()
    for r in rows:
        assert all(len(c) <= 900 or not re.search(r"(?<=[.!?])\s+", c) for c in r["c"])


def test_blank_and_null_texts_have_no_chunks(spark):
    rows = spark.createDataFrame([(1, " \n "), (2, None), (3, "")], "document_id int, text string")
    assert chunking.chunks(rows).count() == 0


def test_offsets_find_verbatim_chunks(spark):
    row = spark.createDataFrame([("ab cd ab zz", ["ab", "ab", "no", "cd"])], "t string, c array<string>")
    assert row.select(T.offsets(F.col("t"), F.col("c")).alias("x")).first()["x"] == [0, 6, 8, 3]


def test_similarity_is_the_published_blend(spark):
    rng = random.Random(3)
    words = "the system shall store every record within two seconds of arrival".split()
    pairs = []
    for _ in range(60):
        a = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        b = [w if rng.random() < 0.8 else rng.choice(words) for w in a]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("r", T.sequence_ratio("a", "b"))
    df = df.withColumn("j", T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b")))).withColumn("s", T.blended(F.col("r"), F.col("j"))).withColumn("kept", T.may_be_similar(F.col("a"), F.col("b"), F.col("j")))
    for row in df.collect():
        r = difflib.SequenceMatcher(None, row["a"], row["b"]).ratio()
        x, y = set(row["a"].split()), set(row["b"].split())
        s = r if r >= 0.99 else 0.7 * r + 0.3 * len(x & y) / len(x | y)
        assert row["s"] == pytest.approx(s)
        assert row["kept"] or s < 0.75


def test_first_match_wins_over_a_better_later_one(spark):
    base = "The pump shall start within five seconds after the start signal has been received by it."
    new = spark.createDataFrame([(1, "n", 0, base)], "d int, id string, seq int, text string")
    old = spark.createDataFrame([(1, "far", 0, base.replace("five", "nine")), (1, "same", 1, base)], "d int, id string, seq int, text string")
    assert chunking.align_first_match(new, old, "d").first()["matched_chunk_id"] == "far"
    assert chunking.align_first_match(new, old.filter("seq = 1"), "d").first()["status"] == "duplicate"
    assert chunking.align_first_match(new, old.limit(0), "d").first()["status"] == "new"


def test_sha_wins_over_md5(spark):
    ledger = spark.createDataFrame([("p1", "m", "other", 1), ("p2", "zz", "s", 2)], "path string, md5 string, sha256 string, seq int")
    incoming = spark.createDataFrame([("q", "m", "s"), ("r", "m", "no"), ("t", "n", "n")], "path string, md5 string, sha256 string")
    found = {r["path"]: r["existing_path"] for r in ingest.look_up_hashes(incoming, ledger).collect()}
    assert found == {"q": "p2", "r": "p1", "t": None}


def test_invalid_vectors(spark):
    rows = [(None,), ([],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0, 2.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in df.select(valid(F.col("v"), 2)).collect()] == [False, False, False, False, True]
    assert df.filter(F.size("v") == 2).select(normalize(F.col("v"))).first()[0] == [0.0, 0.0]
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in pair.select(cosine(F.col("a"), F.col("b"))).collect()] == [round(1 / math.sqrt(2), 6), 0.0]


def test_neighbours_don_t_depend_on_blocks(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, i % 3, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)], "id long, grp long, vec array<double>")
    whole, cut = neighbours(rows, rows, 3).collect(), neighbours(rows, rows, 3, block_rows=20).collect()
    assert sorted(whole) == sorted(cut)


def test_requirements_within_a_batch_are_kept(spark):
    new = spark.createDataFrame([(1, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0])], "id long, grp long, vec array<double>")
    assert [r["is_duplicate"] for r in versions.classify_requirements(new, new.limit(0)).collect()] == [False, False]
    stored = spark.createDataFrame([(2, 0, [1.0, 0.0])], "id long, grp long, vec array<double>")
    assert [r["duplicate_of"] for r in versions.classify_requirements(new, stored).collect()] == [2, 2]


def test_flattening_equals_one_at_a_time(spark):
    rng = random.Random(5)
    chunks = [(f"c{i}", rng.choice([None, "", f"c{rng.randrange(20)}"])) for i in range(20)]
    replaced = [(f"n{k}", f"c{rng.randrange(20)}", k) for k in range(12)]
    state = {c: r or None for c, r in chunks}
    for new, old, _ in replaced:
        for c, r in state.items():
            if r == old:
                state[c] = new
        state[old] = new
    df = lineage.flatten_replacements(spark.createDataFrame(chunks, "chunk_id string, replaced_by string"), spark.createDataFrame(replaced, "new_id string, old_id string, seq int"))
    assert {r["chunk_id"]: r["replaced_by"] for r in df.collect()} == state


def test_components(spark):
    rng = random.Random(6)
    for chain in (False, True):
        edges = [(i, i + 1) for i in range(300)] if chain else [(rng.randrange(400), rng.randrange(400)) for _ in range(200)]
        root = {x: x for e in edges for x in e}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert found == {x: top(x) for x in root if top(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_keys_and_dropped_ids(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    counted = materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "counted")
    joined = join_counted(rows, counted, "k", "n", 3000)
    assert joined.count() == 3000 and joined.filter("k = 'hot' AND n = 2000").count() == 2000
    left = drop_ids(rows, "id", spark.range(0, 3000, 2).toDF("id"))
    assert sorted(r["id"] for r in left.collect()) == list(range(1, 3000, 2)) and left.columns == ["id", "k"]


def test_usage_counts_each_call_once(spark):
    calls = spark.createDataFrame([("2024-01-01", "gpt-4o", 10, 5)] * 3, "date string, model string, input_tokens long, output_tokens long")
    row = reports.with_prices(reports.usage_per_day(calls)).first()
    assert (row["input_tokens"], row["total_tokens"], row["tier"]) == (30, 45, "high") and row["cost"] == pytest.approx((30 * 2.5 + 15 * 10) / 1e6)


def test_mismatches(spark):
    e = spark.createDataFrame([(1, True, None), (2, False, True)], "k int, a boolean, b boolean")
    a = spark.createDataFrame([(1, True, True), (2, True, True)], "k int, a boolean, b boolean")
    assert [tuple(r) for r in reports.mismatches(e, a, "k").collect()] == [(2, "a", "false", "true")]


def test_markdown_table(spark):
    sheet = spark.createDataFrame([(1, ["a", "long\nname"]), (2, [None])], "row_no int, cells array<string>")
    lines = [r["line"] for r in reports.markdown_table(sheet).orderBy("row_no", "part").collect()]
    assert lines == ["| a | long name |", "| - | --------- |", "|   |           |"]


def test_pages_beyond_999_keep_their_order(spark):
    pages = spark.createDataFrame([("d", 1000, "b"), ("d", 999, "a"), ("d", None, "c")], "document_id string, page_number int, content string")
    assert ingest.document_text(pages, " ").first()["text"] == "a b c"


def test_extraction_ids_don_t_collide(spark):
    chunks = spark.createDataFrame([("c1", "It shall run. It must stop."), ("c2", "It shall run."), ("c3", None)], "chunk_id string, chunk_text string")
    found = requirements.with_software_flag(requirements.extract(chunks)).collect()
    assert sorted(r["requirement_id"] for r in found) == ["c1:0001", "c1:0002", "c2:0001"]


def test_diff(spark):
    row = spark.createDataFrame([("a\nb\nc", "a\nx\nc")], "o string, n string").select(diff_lines("o", "n").alias("d")).first()
    assert [(x["tag"], x["line"]) for x in row["d"]] == [(" ", "a"), ("-", "b"), ("+", "x"), (" ", "c")]


def test_versions_of_a_table(spark):
    path = scratch_path(spark, "t")
    tables.append_table(spark.range(3), path)
    tables.append_table(spark.range(2).withColumn("x", F.lit("y")), path)
    assert tables.read_table(spark, path).count() == 5 and "x" in tables.read_table(spark, path).columns
    tables.clear_table(spark, path)
    assert tables.read_table(spark, path).count() == 0
    schema = StructType().add("id", "long").add("z", "string")
    assert tables.migrate(spark.range(1), schema, {"z": F.lit("d")}).first()["z"] == "d"
    assert lineage.verify_schema(spark.range(1).withColumn("q", F.lit(1)), schema) == {"missing": ["z"], "extra": ["q"]}


def test_ingestion_stops_early_and_aligns_versions(spark):
    from tesserae.plans.ingestion import Stage, run

    root = scratch_path(spark, "tables")
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    first = "The valve shall close within two seconds of the signal, and the pump shall stop at once."
    dry = run(files(("a", first)), root, stop_after=Stage.CHUNK, dry_run=True)
    assert set(dry.made) == {"file_hashes", "documents", "document_verdicts", "document_chunks"} and tables.current_version(spark, f"{root}/documents") == ""
    run(files(("a", first), ("b", first)), root)
    assert tables.read_table(spark, f"{root}/file_hashes").count() == 1
    again = run(files(("a", first)), root)
    assert again.made["document_chunks"].count() == 0
    changed = run(files(("a", first.replace("two seconds", "ninety minutes"))), root)
    status = {r["status"] for r in changed.made["document_chunks"].collect()}
    assert "updated" in status and "new" not in status
    assert tables.read_table(spark, f"{root}/document_chunks").filter("document_id = 'a'").count() == changed.made["document_chunks"].count()


def test_json_shapes(spark):
    rows = [("l", '{"pages": [{"text": "x"}, null, {"md_content": "y", "page_number": 7}]}'), ("m", '{"pages": {"page_002": {"summary": "b"}, "page_001": {"content": "", "text": "a"}}}'), ("s", '{"document_title": "t", "md_content": "one"}'), ("n", None)]
    found = {(r["document_id"], r["page_number"], r["content"]) for r in ingest.read_pages_json(spark.createDataFrame(rows, "document_id string, json string")).collect()}
    assert found == {("l", 1, "x"), ("l", 7, "y"), ("m", 1, "a"), ("m", 2, "b"), ("s", 1, "one")}


def test_stream_equals_batch(spark):
    from tesserae.streaming.hash_ingest import ingest_available

    folder = scratch_path(spark, "stream")
    told = lambda b: b.select(F.col("path"), F.col("content"))
    for k, rows in enumerate(([("a", "x"), ("b", "x"), ("c", "y")], [("d", "y"), ("e", "z")])):
        spark.createDataFrame(rows, "path string, content string").write.mode("append").parquet(f"{folder}/in")
        ledger = ingest_available(spark, f"{folder}/in", "path string, content string", f"{folder}/ledger", f"{folder}/cp", told)
        assert sorted(r["path"] for r in ledger.collect()) == (["a", "c"] if k == 0 else ["a", "c", "e"])


def test_tables_are_listed_deleted_recreated_and_restored(spark):
    from pyspark.sql.types import LongType, StructField, StructType

    folder = scratch_path(spark, "some")
    path = f"{folder}/a"
    schema = StructType([StructField("id", LongType())])
    assert tables.list_tables(spark, folder) == [] and tables.create_table(spark, path, schema) and tables.create_table(spark, path, schema)
    assert not tables.create_table(spark, path, StructType([StructField("x", LongType())]))
    for k in range(3):
        tables.append_table(spark.range(4 * k, 4 * k + 4), path)
    tables.delete_rows(spark, path, F.col("id") == 5)
    tables.append_table(spark.createDataFrame([(None,)], "id long"), path)
    assert tables.read_table(spark, path).count() == 12
    tables.delete_rows(spark, path, F.col("id") > 7)
    ids = {r["id"] for r in tables.read_table(spark, path).collect()}
    assert ids == {None, 0, 1, 2, 3, 4, 6, 7}
    with pytest.raises(ValueError):
        tables.change_table(spark, path, lambda df: df.limit(0), lambda df: df.count() == 8)
    assert tables.read_table(spark, path).count() == 8
    tables.change_table(spark, path, lambda df: df.withColumn("vec", F.array_repeat(F.lit(0.0), 3)))
    assert tables.read_table(spark, path).columns == ["id", "vec"] and tables.read_table(spark, path).count() == 8
    tables.append_table(spark.range(1), f"{folder}/b")
    assert tables.clear_tables(spark, folder) == ["a", "b"] and tables.read_table(spark, path).count() == 0
    assert tables.recreate_tables(spark, folder, {"c": schema}) == ["a", "b"] and tables.list_tables(spark, folder) == ["c"]
    assert tables.drop_table(spark, f"{folder}/c") and not tables.drop_table(spark, f"{folder}/c")


def test_requirements_of_a_document_and_model_usage(spark, tmp_path):
    path = scratch_path(spark, "req")
    tables.append_table(spark.createDataFrame([("a", "x"), ("b' OR '1'='1", "y")], "document_id string, d string"), path)
    assert tables.requirements(spark, path).count() == 2
    assert [r["d"] for r in tables.requirements(spark, path, "b' OR '1'='1").collect()] == ["y"]
    (tmp_path / "m.json").write_text('{"m1": {"input": 5, "output": 7},\n "m2": {"input": 1, "output": 0}}')
    found = {tuple(r) for r in tables.read_model_usage(spark, f"file://{tmp_path}/m.json").collect()}
    assert found == {("m1", 5, 7), ("m2", 1, 0)}
    (tmp_path / "u.csv").write_text("date,model,input_tokens,output_tokens,total_tokens,cost\n2024-01-01,m,1,2,3,0.5\nodd line\n")
    rows = tables.read_usage_csv(spark, f"file://{tmp_path}/u.csv").collect()
    assert len(rows) == 2 and [r["malformed"] for r in rows] == [None, "odd line"]


def test_token_functions_and_cosines(spark):
    from tesserae.functions import text, vectors

    df = spark.createDataFrame([("a b c d", [1.0, 0.0], [1.0, 1.0]), ("", [0.0, 0.0], [1.0, 1.0]), (None, [1.0], [1.0, 1.0])], "t string, a array<double>, b array<double>")
    words = lambda t: t.split()
    got = df.select(text.token_counter(words)("t").alias("n"), text.token_truncator(words, " ".join, 2)("t").alias("cut"), vectors.cosine_or_nan(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["n"] for r in got] == [4, 0, 0] and [r["cut"] for r in got] == ["a b", "", None]
    assert got[0]["c"] == pytest.approx(0.5**0.5) and got[1]["c"] != got[1]["c"] and got[2]["c"] is None


def test_pages_without_a_number_come_last(spark):
    rows = [("d", 10000, "b"), ("d", None, "c"), ("d", 2, "a")]
    df = spark.createDataFrame(rows, "document_id string, page_number int, content string")
    assert ingest.document_text(df, "|").first()["text"] == "a|b|c"
