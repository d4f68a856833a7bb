"""What reviews found: queries on small tables that earlier versions got wrong."""

import difflib
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions import ratio_kernel, vectors
from tesserae.functions.words import byte_runs
from tesserae.llm import collinear, divergence
from tesserae.operators import chunking, hot_join
from tesserae.plans.extraction import nearest_stored
from tesserae.plans.oracles import ORACLES
from tesserae.plans.queries import QUERIES
from tesserae.sources.scratch import materialize
from tesserae.thresholds import DEFAULT

from .oracle import same


def test_ids_of_four_digits_are_offset_whole(spark, tmp_path):
    spark.createDataFrame([(n,) for n in (0, 8, 94, 995, 996, 1000, 1001, 9994, 9996, 123456)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(QUERIES["requirement_id_offset"](spark, str(tmp_path)), con, ORACLES["requirement_id_offset"]) == 10


def test_terms_are_counted_in_runs_of_bounded_memory():
    words = [f"{'abcdefgh'[i % 8]}{'klmnop'[i % 6]}{'qrst'[i // 7 % 4]}" for i in range(500)]
    texts = pa.array([" ".join(words)] * 16_000, pa.binary())
    first = [texts.slice(a, b - a).to_pylist() for a, b in byte_runs(texts, divergence.RUN_BYTES)[:1]][0]
    tracemalloc.start()
    divergence._count(first, np.zeros(len(first), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000


def _rounded_cosines(left, right):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(unit(left) @ unit(right).T, 6)


def test_best_rows_of_many_tiles_are_those_of_all_cosines(monkeypatch):
    monkeypatch.setattr(vectors, "TILE", (50, 70))
    rng = np.random.default_rng(5)
    for size, k, copies in ((2, 3, 1), (8, 5, 40), (64, 1, 3), (3, 700, 2)):
        # Few directions in two dimensions: most cosines of a tile are within single precision of the best.
        rows = np.repeat(rng.normal(size=(600 // copies, size)), copies, axis=0)
        rows = rows[rng.permutation(len(rows))]
        ids, grps = np.sort(rng.permutation(10_000)[: len(rows)]), rng.integers(0, 5, len(rows))
        units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        for apart in (None, (grps, grps)):
            s = _rounded_cosines(rows, rows)
            s[np.eye(len(rows), dtype=bool) if apart is None else grps[:, None] == grps[None, :]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            expected = {(i, j, s[i, j]) for i in range(len(rows)) for j in best[i] if s[i, j] > -np.inf}
            found = vectors._top(units, units, k, ids, ids, apart)
            assert len(found[0]) == len(expected) and {(int(i), int(j), v) for i, j, v in zip(*found)} == expected


def test_few_cosines_are_computed_twice(monkeypatch):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(4 * vectors.TILE[1], 16))
    units, whole = rows / np.linalg.norm(rows, axis=1, keepdims=True), []
    monkeypatch.setattr(vectors, "_whole_tile", lambda *args, of=vectors._whole_tile: whole.append(1) or of(*args))
    vectors._top(units[:1000], units, 5, np.arange(1000), np.arange(len(units)), None)
    # One tile in four for each 512 queries.
    assert len(whole) == 2


def test_one_comparison_of_two_blocks_gives_the_best_of_both(monkeypatch):
    rng = np.random.default_rng(7)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for tile, bound in (((50, 70), 30), ((40, 40), 9), ((1024, 1024), 512)):
        monkeypatch.setattr(vectors, "BOTH_TILE", tile)
        monkeypatch.setattr(vectors, "BOUND_ROWS", bound)
        for size, k, copies in ((2, 3, 1), (8, 5, 40), (64, 1, 1), (64, 1, 3), (16, 1, 200), (3, 250, 2)):
            rows = np.repeat(rng.normal(size=(600 // copies, size)), copies, axis=0)
            rows[:5] = -rows.mean(axis=0)
            rows = unit(rows[rng.permutation(len(rows))])
            ids = np.sort(rng.permutation(10_000)[: len(rows)])
            s = _rounded_cosines(rows, rows)
            s[np.eye(len(rows), dtype=bool)] = -np.inf
            at = rng.random(len(rows)) < 0.4
            a, b = np.flatnonzero(at), np.flatnonzero(~at)
            own = vectors._top_both(rows, None, k, ids, ids)
            both = vectors._top_both(rows[a], rows[b], k, ids[a], ids[b])
            assert len(own) == 1 and len(both) == 2
            for found, cosines in ((own[0], s), (both[0], s[np.ix_(a, b)]), (both[1], s[np.ix_(b, a)])):
                best = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
                expected = {(i, j, cosines[i, j]) for i in range(len(cosines)) for j in best[i] if cosines[i, j] > -np.inf}
                assert len(found[0]) == len(expected) and {(int(i), int(j), v) for i, j, v in zip(*found)} == expected


def test_a_table_meets_itself_once(spark):
    rng = np.random.default_rng(9)
    vecs = [*rng.normal(size=(60, 4)).tolist(), [1e-300] * 4, [0.0] * 4, None, [float("nan")] * 4]
    rows = spark.createDataFrame([(3 * i, 0, v) for i, v in enumerate(vecs + vecs[:9])], "id long, grp long, vec array<double>")
    n = rows.count()
    for k in (1, 4):
        # Two equal tables are compared as two, in cells of ordered pairs; with as many blocks as rows some have none.
        two = {tuple(r) for r in vectors.neighbours(rows, rows.select("*"), k, block_rows=20).collect()}
        for block_rows in (n, 20, 7):
            df = vectors.neighbours(rows, rows, k, block_rows=block_rows)
            found = df.collect()
            assert len(found) == len(two) and {tuple(r) for r in found} == two
            assert "FlatMapCoGroupsInArrow" not in df._jdf.queryExecution().toString()


def test_copies_of_vectors_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(10)
    vecs = rng.normal(size=(25, 3)).tolist()
    # Copies, a zero of either sign, a parallel vector (no copy, but a cosine of 1), and lengths that can't be squared.
    vecs = vecs[:20] * 3 + vecs + [[0.0, 1.0, 2.0], [-0.0, 1.0, 2.0], [2 * x for x in vecs[3]]] + [[1e-300] * 3, [1e300] * 3, None] * 2
    order = rng.permutation(len(vecs))
    rows = spark.createDataFrame([(5 * i, 0, vecs[j]) for i, j in enumerate(order)], "id long, grp long, vec array<double>")
    compared = []
    monkeypatch.setattr(vectors, "_pairs_within", lambda rows, *a, of=vectors._pairs_within: compared.append(rows.count()) or of(rows, *a))
    for k in (1, 3):
        two = {tuple(r) for r in vectors.neighbours(rows, rows.select("*"), k).collect()}
        found = vectors.neighbours(rows, rows, k, block_rows=11).collect()
        assert len(found) == len(two) and {tuple(r) for r in found} == two
    # 25 vectors, one whose zeros differ in sign, a parallel one, and four by themselves.
    assert compared == [31, 31]


@pytest.mark.parametrize("copies", [1, 4])
def test_queries_of_nearest_pages_compare_a_table_with_itself(spark, tmp_path, monkeypatch, copies):
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(60, 64)).astype(np.float32).tolist() * copies
    rows = [(7 * i, vecs[j], i % 5) for i, j in enumerate(rng.permutation(len(vecs)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    compared = []
    monkeypatch.setattr(vectors, "_pairs_within", lambda rows, *a, of=vectors._pairs_within: compared.append(rows.count()) or of(rows, *a))
    for name, n in (("page_outcomes", 5), ("page_update_status", len(rows)), ("page_best_match", len(rows))):
        assert same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) == n
    assert compared == [60] * 3


@pytest.mark.parametrize("copies", [1, 3])
def test_page_outcomes_ask_for_bands_only_and_rows_that_reach_the_first_meet_no_more(spark, tmp_path, monkeypatch, copies):
    rng = np.random.default_rng(12)
    vecs = rng.normal(size=(220, 64))
    # A third have a vector near them, some one at the edge of a band, all others none.
    vecs[:40] = vecs[180:] + 0.2 * rng.normal(size=(40, 64))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for i, c in enumerate([0.48, 0.4799994, 0.4799996, 0.40, 0.3999994, 0.3999996]):
        away = unit[100 + i] - (unit[100 + i] @ unit[120 + i]) * unit[120 + i]
        vecs[100 + i] = c * unit[120 + i] + (1 - c * c) ** 0.5 * away / np.linalg.norm(away)
    vecs = vecs.tolist() + vecs[150:170].tolist() * (copies - 1) * 4
    rows = [(7 * i, vecs[j], i % 5) for i, j in enumerate(rng.permutation(len(vecs)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    asked = []
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 64 * 30)
    monkeypatch.setattr(vectors, "_still_below", lambda rows, n, *a, of=vectors._still_below: asked.append(n) or of(rows, n, *a))
    assert same(QUERIES["page_outcomes"](spark, str(tmp_path)), con, ORACLES["page_outcomes"]) == 5
    # Copies aren't asked for, and each round asks for fewer rows.
    assert asked[0] == 220 - 20 * (copies > 1) and len(asked) > 2 and asked == sorted(asked, reverse=True) and asked[-1] < asked[0] - 40
    # Row by row, with rows that have no valid vector and lengths that can't be squared.
    odd = [(100_000, [1e-300] * 64), (100_001, [1e300] * 64), (100_002, None), (100_003, [0.0] * 64), (100_004, [float("nan")] * 64)]
    pages = spark.createDataFrame([(i, 0, v) for i, v, *_ in rows + odd], "id long, grp long, vec array<double>")
    levels = [0.48, 0.4, 0.3]
    best = {r.q_id: r.similarity for r in vectors.neighbours(pages, pages.select("*"), 1).collect()}
    want = {i: sum(best.get(i, -1.0) < x for x in levels) for i in [i for i, *_ in rows] + [100_000, 100_001]}
    for block_rows in (64, 1000):
        found = vectors.below(pages, levels, block_rows).collect()
        assert len(found) == len({r.id for r in found}) and {r.id: r.level for r in found} == {i: x for i, x in want.items() if x}


def test_blocks_grow_with_the_table(spark):
    n = 40 * vectors.BLOCK_ROWS
    rows = spark.range(n).select("id", F.lit(0).cast("long").alias("grp"), F.array(F.rand(1) - 0.5, F.rand(2) - 0.5).alias("vec"))
    plan = vectors.neighbours(rows.limit(0), rows, 1)._jdf.queryExecution().toString()
    assert f"sequence(0, {vectors.SIDE_BLOCKS - 1}" in plan


def test_word_pairs_are_found_whatever_orders_the_words_and_few_sets_are_compared(spark, monkeypatch):
    rng, words = random.Random(8), [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(0, 300, 3):
        texts[i] = rng.sample(words, rng.randint(1, 40))
        texts[i + 1] = texts[i][:-1] + rng.sample(words, 1)
        texts[i + 2] = rng.sample(texts[i][: len(texts[i]) // 5 * 4 + 1], len(texts[i]) // 5 * 4 + 1)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(900, ""), (901, None)], "id long, text string")
    first = {}
    for i, t in texts.items():
        first.setdefault(" ".join(t), i)
    kept = sorted((i, frozenset(t.split(" "))) for t, i in first.items())
    expected = {(i, j, round(len(a & b) / len(a | b), 6)) for i, a in kept for j, b in kept if i < j and len(a & b) / len(a | b) >= 0.8}
    assert len(expected) > 50
    made = {}
    keep = lambda df, name, *args: made.setdefault(name, materialize(df, name, *args))
    monkeypatch.setattr(chunking, "materialize", keep)
    for most in (1 << 20, 200, 0):
        made.clear()
        monkeypatch.setattr(chunking, "ORDERED", most)
        assert {tuple(r) for r in chunking.shared_word_pairs(df, 0.8).collect()} == expected
        # Whole sets travel for pairs that their parts leave over.
        assert len(expected) <= made["bounded"].count() <= 2 * len(expected)


def test_dropped_keys_take_no_whole_rows_along(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z"), ("c", None), ("a", "w")], "k string, t string")
    texts = lambda keys: sorted(str(r["t"]) for r in hot_join.drop_keys(rows, "k", spark.createDataFrame([(k,) for k in keys], "k string")).collect())
    for most in (10, 1):
        monkeypatch.setattr(hot_join, "BROADCAST_IDS", most)
        assert texts([]) == ["None", "w", "x", "y", "z"] and texts(["a", "q", "a", None]) == ["None", "y", "z"]
    monkeypatch.setattr(hot_join, "BROADCAST_IDS", 10)
    # A hash of the length lets other keys pass through the exact comparison.
    monkeypatch.setattr(hot_join.F, "xxhash64", lambda c: F.length(c).cast("long"))
    assert texts(["a"]) == ["None", "y", "z"]


def test_new_requirements_are_not_sent_to_rings(spark, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr("tesserae.operators.vector_index.materialize", lambda df, name, *a: names.append(name) or materialize(df, name, *a))
    rows = [(f"r{i}", i, f"d{i}", [1.0, i / 10]) for i in range(6)]
    df = spark.createDataFrame([*rows, ("odd", 9, "odd", [0.0, 0.0]), ("no", 10, "no", None)], "requirement_id string, number long, description string, embedding array<double>")
    found = nearest_stored(df.filter("number % 2 = 1"), df.filter("number % 2 = 0"), 2, DEFAULT).select("id", "old_id").collect()
    # Between two the nearer angle wins, which is the larger one's; a vector that is null or zero meets none.
    assert sorted(map(tuple, found)) == [("r1", "r2"), ("r3", "r4"), ("r5", "r4")] and names == []


def test_blocks_of_texts_are_bounded_at_once_and_no_pair_is_lost(monkeypatch):
    rng, parts = random.Random(4), "the of and tion ing ed er re ha st nt or th is in he ea es nd an on it ly sh wh as ou ble".split()
    word = lambda: "".join(rng.choices(parts, k=rng.choice((1, 1, 2, 3))))
    text = lambda n: " ".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    line = " The same line is in every text of them all, and it is longer than a gram. "
    a = [text(rng.randint(4, 11)) + line for _ in range(120)] + [text(1)[:k] for k in range(0, 60, 3)]
    b = [text(rng.randint(4, 11)) + line for _ in range(120)] + [t[:-30] + text(1) for t in a[:10]] + [t[::2] for t in a[:10]] + [t[1:] for t in a[120:]]
    calls = []
    monkeypatch.setattr(ratio_kernel.Matcher, "matched", lambda self, x, of=ratio_kernel.Matcher.matched: calls.append(1) or of(self, x))
    want = {(i, j): r for i, x in enumerate(a) for j, y in enumerate(b) if (m := difflib.SequenceMatcher(None, x, y)).quick_ratio() >= 0.7 and (r := m.ratio()) >= 0.7}
    assert len(want) > 20
    singly = []
    for owner, name in ((ratio_kernel, "common_subsequence"), (ratio_kernel.Index, "shared")):
        monkeypatch.setattr(owner, name, lambda *x, of=getattr(owner, name): singly.append(1) or of(*x))
    for sizes in ((1 << 20, 512, 1 << 13, 1024, 64), (50, 3, 7, 2, 64), (1 << 20, 512, 1 << 13, 1024, 1000)):
        for name, value in zip(("CELLS", "ROWS", "TOGETHER", "SHORT_TEXTS", "COMMON"), sizes):
            monkeypatch.setattr(ratio_kernel, name, value, raising=False)
        calls.clear()
        assert {(i, j): r for i, j, r in ratio_kernel.ratios(ratio_kernel.Texts(a), ratio_kernel.Texts(b), 0.7)} == want
        assert len(calls) < 1000 and not singly


@pytest.mark.parametrize("tile", [1024, 3])
def test_edited_passages_of_frequent_seeds_alone_are_found_whole(spark, monkeypatch, tile):
    monkeypatch.setattr(collinear, "PARTNERS", 1)
    rng = random.Random(3)
    filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    edited = lambda *at: [f"e{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(passage)]
    held = [(10, edited(14, 29, 44)), (50, edited(13, 28, 43))]
    # Quotes of 12 words, before and between the two.
    held += [(n, passage[k : k + 12]) for n0 in (0, 20) for n, k in enumerate(range(0, 49, 7), n0)]
    rows = [(n, " ".join([*filler(20), *words, *filler(20)])) for n, words in held]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pair = lambda **how: [(r["doc_id"], r["match_doc_id"], r["start"], r["n_words"]) for r in collinear.repeated_passages(df, **how).collect()]
    assert pair() == []
    if hasattr(collinear, "TILE_ROWS"):
        monkeypatch.setattr(collinear, "TILE_ROWS", tile)
    assert pair(whole=True) == [(50, 10, 20, 60)]


@pytest.mark.parametrize("block_texts", [8192, 40])
def test_compared_texts_are_not_sent_to_blocks(spark, monkeypatch, block_texts):
    for name, value in (("BLOCK_TEXTS", block_texts), ("ROW_GROUP", 1), ("LEFT_BLOCKS", 2)):
        monkeypatch.setattr(chunking, name, value, raising=False)
    rng = random.Random(6)
    of = [["".join(rng.choices("abcd ", k=rng.randint(3, 30))) for _ in range(250)] + ["", "long " * 90, "long " * 80 + "end"] for _ in range(2)]
    frames = [spark.createDataFrame([(t.encode(), t) for t in dict.fromkeys(ts)], "key binary, text string").coalesce(2) for ts in of]
    found = chunking.reaching_pairs(*frames, 0.7)
    want = {(x.encode(), y.encode()): r for x in of[0] for y in of[1] if (m := difflib.SequenceMatcher(None, x, y)).quick_ratio() >= 0.7 and (r := m.ratio()) >= 0.7}
    assert {(r["a"], r["b"]): r["ratio"] for r in found.collect()} == want and len(want) > 99
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Tasks get names of files; what is in these is read there.
    assert "CoGroup" not in plan and "text" not in plan


def test_short_vectors_meet_only_leaves_that_can_hold_a_nearer_one(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors_of = lambda n: rng.poisson(rng.choice([2.0, 30.0], (n, 6))).astype(float)
    new, old = vectors_of(3000), vectors_of(4000)
    old[2000:2400], new[:300], new[300:310], old[7] = old[:400], old[100:400] * 3, 0.0, [np.inf, 1, 1, 1, 1, 1]
    # An id of both sides is no match of itself.
    new_id, old_id = np.arange(3000) * 2 + 1, np.arange(4000) * 2
    for itself in (False, True):
        if itself:
            new_id[50:60], new[50:60] = old_id[1500:1510], old[1500:1510]
        frames = [spark.createDataFrame([(int(i), 0, v.tolist()) for i, v in zip(*x)], "id long, grp long, vec array<double>") for x in ((new_id, new), (old_id, old))]
        best = lambda **how: sorted((r["q_id"], r["r_id"], r["similarity"]) for r in vectors.neighbours(*frames, 1, **how).collect())
        want = [r for r in best() if r[2] >= 0.99]
        assert best(least=0.99) == want and best(least=0.99, block_rows=900) == want and len(want) > 1000
    units = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (new[310:], old[8:])]
    monkeypatch.setattr(vectors, "LEAF", 32)
    met = []
    monkeypatch.setattr(vectors.np, "rint", lambda x, of=np.rint: met.append(x.size) or of(x))
    vectors._nearest(*units, new_id[310:], old_id[8:], 0.99)
    assert sum(met) < units[0].shape[0] * units[1].shape[0] / 4
