"""Streams, batched model calls, kept vectors and exact tokens."""

import datetime
import json
import os
import types

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from tesserae.functions import tokens
from tesserae.operators import document_vectors, model_calls
from tesserae.plans import ingestion
from tesserae.plans.queries import QUERIES
from tesserae.sources import tables
from tesserae.sources.scratch import scratch_path
from tesserae.streaming import hash_ingest, usage, watch

SF = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = ["The valve shall close within two seconds of the signal. The pump must stop at once.", "Operators should read the software manual.", "The data interface shall answer."]
TABLES = ("documents", "document_chunks", "requirements", "file_hashes")


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def watched(spark, folder):
    source = spark.readStream.schema("path string, content string").parquet(f"{folder}/in")
    return watch.watch(spark, source, f"{folder}/tables", f"{folder}/checkpoint", lambda b: b).awaitTermination()


def stored(spark, folder):
    rows = {n: tables.read_table(spark, f"{folder}/tables/{n}") for n in TABLES}
    return {n: sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect()))) for n, df in rows.items()}


BATCHES = ([("a", TEXTS[0]), ("b", TEXTS[1]), ("c", TEXTS[0])], [("a", TEXTS[0].replace("two", "nine")), ("d", TEXTS[2]), ("e", TEXTS[1])])


@pytest.mark.parametrize("writes", [2, 7])
def test_a_batch_that_dies_between_tables_runs_again(spark, monkeypatch, writes):
    """The stream is stopped after so many tables' writes, before and within the commit of one, and goes on."""
    plain, broken = scratch_path(spark, "plain"), scratch_path(spark, "broken")
    for rows in BATCHES:
        for folder in (plain, broken):
            arrive(spark, folder, rows)
        watched(spark, plain)
        commit, done = tables._commit, []

        def dies(*args, commit=commit, done=done):
            done.append(1)
            if len(done) == (writes - 1) % 4 + 1 and len(done) <= writes:
                if writes > 4:
                    commit(*args)
                raise RuntimeError("killed")
            return commit(*args)

        monkeypatch.setattr(tables, "_commit", dies)
        with pytest.raises(Exception, match="killed"):
            watched(spark, broken)
        monkeypatch.setattr(tables, "_commit", commit)
        watched(spark, broken)
    assert stored(spark, plain) == stored(spark, broken)
    assert len(stored(spark, plain)["file_hashes"]) == 4


def test_watched_batches_equal_the_plan_run_by_hand(spark):
    folder, root = scratch_path(spark, "watched"), scratch_path(spark, "by_hand")
    for rows in BATCHES:
        arrive(spark, folder, rows)
        watched(spark, folder)
        ingestion.run(spark.createDataFrame(rows, "path string, content string"), f"{root}/tables")
    assert stored(spark, folder) == stored(spark, root)
    watched(spark, folder)  # nothing new
    assert stored(spark, folder) == stored(spark, root)


def test_a_batch_opens_only_its_buckets(spark):
    ledger = scratch_path(spark, "ledger")
    frame = lambda names: spark.createDataFrame([(n, f"text {n}") for n in names], "path string, content string")
    hash_ingest.append_batch(frame([f"p{i:03d}" for i in range(200)]), ledger, 0)
    assert hash_ingest.read_ledger(spark, ledger).count() == 200
    from tesserae.operators.ingest import file_hashes

    for few in (["p001"], ["p001", "p002", "new"]):
        opened = hash_ingest.known_hashes(spark, ledger, file_hashes(frame(few)), 9).inputFiles()
        assert len(opened) <= len(few)
    assert len(hash_ingest.known_hashes(spark, ledger, file_hashes(frame([f"p{i:03d}" for i in range(100)])), 9).inputFiles()) > 50
    for _ in range(2):  # a batch that runs again
        hash_ingest.append_batch(frame(["p001", "new", "newer"]), ledger, 1)
    assert sorted(r["path"] for r in hash_ingest.read_ledger(spark, ledger).collect())[:2] == ["new", "newer"] and hash_ingest.read_ledger(spark, ledger).count() == 202


def test_usage_stream_drops_late_and_repeated_calls(spark):
    folder = scratch_path(spark, "usage")
    day = lambda d, h=0: datetime.datetime(2024, 5, d, h)
    parts = [
        [("a", day(1, 5), "m", 1, 2), ("a", day(1, 5), "m", 1, 2), ("b", day(1, 7), None, None, 4), ("x", None, "m", 50, 50)],
        [("c", day(3, 1), "m", 10, 0), ("d", day(2, 23), "m", 100, 0), ("a", day(1, 5), "m", 1, 2)],
        [("late", day(1, 9), "m", 1000, 0), ("e", day(5, 2), "n", 7, 7)],
        [("f", day(9), "n", 1, 1)],
    ]
    for rows in parts:
        spark.createDataFrame(rows, usage.CALLS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        usage.write_daily_usage(spark.readStream.schema(usage.CALLS).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = {(str(r["date"]), r["model"]): (r["calls"], r["input_tokens"], r["output_tokens"]) for r in usage.read_daily_usage(spark, f"{folder}/out").collect()}
    assert found == {("2024-05-01", "m"): (1, 1, 2), ("2024-05-01", None): (1, 0, 4), ("2024-05-02", "m"): (1, 100, 0), ("2024-05-03", "m"): (1, 10, 0), ("2024-05-05", "n"): (1, 7, 7)}


def log(path, items):
    with open(path, "a") as f:
        f.write(json.dumps([x["text"] for x in items]) + "\n")


def client_of(path, mode):
    """Answers in one of the shapes or fails in one of the ways; each call is a line of a file."""

    def make():
        def client(items):
            log(path, items)
            bad = [x for x in items if "bad" in x["text"]]
            told = [{"id": x["id"], "n": len(x["text"])} for x in items if x not in bad]
            if mode == "json":
                return json.dumps({"results": told})
            if mode == "object":
                return types.SimpleNamespace(results=[types.SimpleNamespace(**x) for x in told])
            if mode == "backwards":
                return {"results": told[::-1] + [{"id": "99", "n": -1}]}
            if mode == "short" and len(items) > 1:
                return {"results": told[1:]}
            if mode == "fails" and bad or mode == "never":
                raise TimeoutError("no")
            if mode == "shapeless" and len(items) > 1:
                return ["?"]
            return {"results": told}

        return client

    return make


@pytest.mark.parametrize("mode", ["dict", "json", "object", "backwards", "short", "fails", "never", "shapeless"])
def test_no_row_is_lost_whatever_the_client_does(spark, tmp_path, mode):
    path = str(tmp_path / "calls")
    texts = ["a", "bb", "bad", "dddd", "eeeee", None, "", "a"]
    df = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    rows = model_calls.call_in_batches(df, client_of(path, mode), "n long", retries=2, delay=0).collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4, 5, 0, 1]
    sizes = [r["result"] and r["result"]["n"] for r in rows]
    if mode == "never":
        assert sizes == [None] * 8 and all(r["error"] for r in rows)
    else:
        assert sizes == [1, 2, None, 4, 5, None, 0, 1]
        assert [bool(r["error"]) for r in rows] == [False, False, True, False, False, True, False, False]
    calls = [json.loads(x) for x in open(path)]
    batches, singles = [c for c in calls if len(c) > 1], [c for c in calls if len(c) == 1]
    if mode == "never":
        assert len(batches) == 3 * 2 and len(singles) == 3 + 6  # 7 texts: batches of 3, 3 and 1 with three calls each, then one for each of six
    if mode in ("dict", "json", "object", "backwards"):
        assert sorted(map(len, calls)) == [1, 1, 3, 3]  # the last batch, and the marked text's own call
    assert rows[5]["calls"] == 0


def test_retries_wait_longer_each_time(monkeypatch):
    waited, tries = [], []
    monkeypatch.setattr(model_calls.time, "sleep", waited.append)

    def client(items):
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return {"results": [{"id": "0"}]}

    assert model_calls.ask(client, [{"id": "0", "text": "x"}], "results", 3, 2.0)[1] == 4 and waited == [2, 4, 8]
    with pytest.raises(ValueError):
        model_calls.ask(lambda items: {"other": []}, [], "results", 1, 0)


def test_chunks_and_verification_by_a_model(spark):
    docs = spark.createDataFrame([("a", "one. two."), ("b", " "), ("c", None), ("d", "bad")], "document_id string, text string")

    def splitting():
        def client(items):
            if "bad" in items[0]["text"]:
                return '{"parts": []}'
            return json.dumps({"chunks": items[0]["text"].split(" ")})

        return client

    found = {r["document_id"]: (r["chunks"], r["calls"], bool(r["error"])) for r in model_calls.chunks_from_model(docs, splitting, delay=0).collect()}
    assert found == {"a": (["one.", "two."], 1, False), "b": ([], 0, False), "c": ([], 0, False), "d": ([], 4, True)}
    pairs = spark.createDataFrame([(1, "x", 9, "y", 0.995), (2, "same", 8, "same", 0.98), (3, "p", 7, "q", 0.975), (4, "#", 6, "q", 0.975)], "id long, new_text string, old_id long, old_text string, similarity double")

    def judging():
        def client(items):
            told = [(x["id"], json.loads(x["text"])) for x in items]
            if any(t["new"] == "#" for _, t in told):
                raise OSError("down")
            return {"results": [{"id": i, "is_duplicate": t["new"] == t["old"], "confidence": 0.9, "rationale": "compared"} for i, t in told]}

        return client

    said = {r["id"]: (r["is_duplicate"], r["duplicate_of"], r["rationale"]) for r in model_calls.verified_duplicates(pairs, judging, 0.99, delay=0).collect()}
    assert said == {1: (True, 9, "similarity"), 2: (True, 8, "compared"), 3: (False, None, "compared"), 4: (False, None, "OSError: down")}
    assert [r["id"] for r in model_calls.verified_duplicates(pairs, None, 0.99).filter("is_duplicate").collect()] == [1]


def test_kept_vectors_equal_a_full_recomputation(spark):
    p = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("vec"))
    odd = spark.createDataFrame([(1, 3, None), (2, 3, [0.0] * 64), (3, 77, [float("nan")] * 64)], "id long, grp long, vec array<float>")
    path, whole = scratch_path(spark, "kept"), scratch_path(spark, "whole")
    document_vectors.change_pages(path, 64, p.filter("id < 200").unionByName(odd))
    document_vectors.change_pages(path, 64, p.filter("id >= 150"), p.filter("id >= 150 AND id < 200"))
    document_vectors.change_pages(path, 64, None, p.filter("grp = 4 OR id = 0").unionByName(odd))
    document_vectors.change_pages(whole, 64, p.filter("grp <> 4 AND id <> 0"))
    value = lambda at: sorted(map(tuple, document_vectors.kept_vectors(spark, at, 64).collect()))
    assert value(path) == value(whole) and len(value(path)) == 9
    document_vectors.compact(spark, path, 64)
    assert value(path) == value(whole) and tables.read_table(spark, path).count() == 9
    assert document_vectors.kept_vectors(spark, scratch_path(spark, "none"), 64).count() == 0


def with_special(tmp_path):
    t = Tokenizer.from_file(BYTE)
    t.post_processor = processors.TemplateProcessing(single="<|endoftext|> $A <|endoftext|>", special_tokens=[("<|endoftext|>", 50256)])
    t.save(str(tmp_path / "special.json"))
    return str(tmp_path / "special.json")


@pytest.mark.parametrize("piece", [100_000, 40])
def test_tokens_equal_the_library(spark, monkeypatch, tmp_path, piece):
    monkeypatch.setattr(tokens, "SLICE", piece)
    texts = ["", "a", "😀😀 é", "don't  stop\n\n now " * 30, "x" * 500, " lead", "end ", "a b c d e f " * 40, "<|endoftext|> a b"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    for path in (BYTE, public_tokenizers.path("word_bpe_49k.json"), with_special(tmp_path)):
        library, own = Tokenizer.from_file(path), tokens.Tokens(path)
        assert own.sliced
        for text in texts:
            for special in (True, False):
                assert own.counts([text], special)[0] == len(library.encode(text, add_special_tokens=special).ids)
            told = library.encode(text, add_special_tokens=False)
            for limit in (0, 1, 2, 7, 60, 10_000):
                first = own.first(text, limit, False)
                assert text.startswith(first)
                if path == BYTE:
                    assert first == (library.decode(told.ids[:limit], skip_special_tokens=False).rstrip("�") if limit < len(told.ids) else text)
                assert own.first(text, limit + own.special, True) == first
    assert tokens.Tokens(with_special(tmp_path)).special == 2


def test_token_query_equals_the_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in QUERIES["token_counts"](spark, SF).collect():
        ids = byte.encode(texts[r["document_id"]], add_special_tokens=False).ids
        assert r["byte_tokens"] == len(ids) and r["word_tokens"] == len(word.encode(texts[r["document_id"]]).ids)
        assert r["first_chars"] == len(byte.decode(ids[:100]).rstrip("�"))
    none = spark.createDataFrame([(None,)], "t string").select(tokens.token_count(BYTE, False)(F.col("t")).alias("n"), tokens.first_tokens(BYTE, 3)(F.col("t")).alias("f")).first()
    assert tuple(none) == (0, None) and os.path.exists(BYTE)
