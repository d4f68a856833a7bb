"""The divergence audit, byte-level BPE and delta Lloyd."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tesserae.llm import byte_bpe, delta_lloyd, divergence
from tesserae.llm.oracles import ORACLES

from ..oracle import connect, same

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def divergence_by_hand(rows, least):
    terms = [[m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")] for _, _, t in rows]
    in_docs, counts = Counter(), defaultdict(Counter)
    for (lang, source, _), own in zip(rows, terms):
        key = lang or "", source or ""
        in_docs.update((key[0], t) for t in set(own))
        counts[key].update(own)
    out = set()
    for lang in {k[0] for k in counts}:
        kept = sorted((t for (g, t), n in in_docs.items() if g == lang and n >= least), key=str.encode)
        sources = sorted((s for g, s in counts if g == lang), key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        q = share(whole) if kept else []
        p = {s: share(counts[lang, s]) if kept else [] for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted([(-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s])
            term = sorted([(-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b])[:10]
            out |= {(lang, s, part, item, -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("chunk_rows, slice_numbers", [(400_000, 1 << 20), (7, 4)])
def test_divergence_by_hand(spark, monkeypatch, chunk_rows, slice_numbers):
    monkeypatch.setattr(divergence, "SLICE", slice_numbers)
    r = random.Random(5)
    words = ["Zug", "zug", "éclair", "Éclair", "a", "b-c", "x1y", "\U0001f600", "ﬁn", "o'er", "\x00nul", "AÀa"]
    rows = [(r.choice(["en", "de", None]), r.choice(["s", "t", "", None, "ü"]), " ".join(r.choices(words, k=r.randint(0, 9)))) for _ in range(120)]
    rows += [("en", "none", None), ("xx", "s", "rare"), ("xx", "t", ""), ("en", "s", "tie " * 500), ("en", "s", "tie"), ("en", "t", "tie")]
    df = spark.createDataFrame([(*x, i, "k") for i, x in enumerate(rows)], "lang string, source string, text string, term long, value string").repartition(5)
    counts = divergence.term_counts(df)
    assert counts.filter("term = ''").agg(F.sum("docs")).first()[0] == len(rows)
    found = divergence.audit(df, chunk_rows=chunk_rows, least=3)
    assert {tuple(x) for x in found.select("lang", "source", "part", "item", "value", "rank").collect()} == divergence_by_hand(rows, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_parts_don_t_overflow():
    counts, total = np.array([0, 7, 10**15], np.int64), np.array([3 * 10**15], np.int64)
    assert divergence.parts(counts, total).tolist() == [1 + 10**9 * (c + 2) // (3 * 10**15) for c in counts.tolist()]


def test_byte_bpe_equals_the_library(spark, library):
    r = random.Random(2)
    odd = [None, "", "\n", " \n x", " a" * 5, "a  b", "\x00a\x85b  ", "x" * 200_000, "ab " * 400_000, "😀é 'll don't <|endoftext|>"]
    odd += ["".join(r.choices("ab '\n\tés1.,😀　中-_ lL", k=r.randint(0, 60))) for _ in range(500)]
    df = spark.createDataFrame([(i // 2 if i % 7 else None, t, "x", [i]) for i, t in enumerate(odd)], "doc_id long, text string, ids string, starts array<int>")
    found = byte_bpe.encode(df, RANKS)
    whole = defaultdict(list)
    for row in found.collect():
        whole[row.doc_id].append(row)
    want = defaultdict(list)
    for i, t in enumerate(odd):
        want[i // 2 if i % 7 else None].append(library.encode_ordinary(t or ""))
    assert {k: sorted(map(tuple, v)) for k, v in want.items()} == {k: sorted(tuple(x.ids) for x in v) for k, v in whole.items()}
    texts = [t or "" for t in odd]
    assert sorted(x.text for x in byte_bpe.decode(found, RANKS).collect()) == sorted(texts)
    digests = byte_bpe.round_trip(df, RANKS).collect()
    assert all(x.same for x in digests) and Counter(x.decoded_sha256 for x in digests) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert byte_bpe.encode(df.limit(0), RANKS).count() == 0


def test_byte_bpe_offsets_and_split_characters(spark):
    bpe = byte_bpe.ByteBpe(RANKS)
    texts = ["😀é don't  中中x", "", "ünï\U0001f600", "a\U00010348b"]
    for text in texts:
        told = bpe.tokenizer.encode(text, add_special_tokens=False)
        starts, ends = bpe.offsets(text, np.array(told.ids, np.int64))
        assert list(zip(starts.tolist(), ends.tolist())) == told.offsets
    ids = bpe.encode(["\U00010348"])[0].tolist()
    assert len(ids) > 1
    rows = spark.createDataFrame([("a", ids[:1]), ("b", ids), ("c", None)], "doc_id string, ids array<int>")
    found = {x.doc_id: (x.data, x.text) for x in byte_bpe.decode(rows, RANKS).collect()}
    assert found["a"][1] == "�" and found["b"] == ("\U00010348".encode(), "\U00010348") and found["c"] == (None, None)
    with pytest.raises(ValueError):
        bpe.decode(np.array([bpe.n_ids]))


def test_byte_bpe_query(spark, library):
    from tesserae.llm.queries import QUERIES

    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for x in rows:
        ids = library.encode_ordinary(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()


def lloyd_by_hand(rows, clusters, rounds, size):
    """Plain Lloyd with Python's integers."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (hashlib.sha256(f"3:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owned = defaultdict(list)
        for _, v in kept:
            owned[near(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*owned[j])] if owned[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    of = Counter()
    for _, c, d in found:
        of[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, of[c], sum(of.values()), sha[c]) for i, c, d in found)


@pytest.mark.parametrize("block_rows, rounds, size", [(4096, 4, 3), (5, 10, 3), (7, 0, 2)])
def test_lloyd_by_hand(spark, monkeypatch, block_rows, rounds, size):
    monkeypatch.setattr(delta_lloyd, "BLOCK_ROWS", block_rows)
    r = random.Random(block_rows)
    rows = [(i if i % 9 else None, [r.choice([-1.5, 0.25, 0.25, 3.0]) + r.random() / 50 for _ in range(size)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 12 + [(8, [1e4] * size), (8, [-1e5] * size)]
    rows += [(900, None), (901, []), (902, [1.0] * (size + 1)), (903, [None] + [1.0] * (size - 1)), (904, [float("nan")] * size), (905, [float("inf")] + [0.0] * (size - 1))]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, owners string").repartition(3)
    found = delta_lloyd.cluster(df, rounds=rounds, size=size)
    assert Counter(tuple(x) for x in found.collect()) == lloyd_by_hand(rows, 8, rounds, size)


def test_lloyd_of_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1e300]), (2, [float("nan"), 0.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.cluster, x.distance, x.inertia) for x in delta_lloyd.cluster(df, size=2).collect()] == [(1, 0, 0, 0)]
    assert delta_lloyd.cluster(df.limit(0), size=2).count() == 0


def test_lloyd_rounds_meet_without_a_shuffle(spark, monkeypatch):
    plans = []
    write = delta_lloyd._Buckets.write
    monkeypatch.setattr(delta_lloyd._Buckets, "write", lambda self, rows, name: (plans.append((name, rows._jdf.queryExecution().executedPlan().toString())), write(self, rows, name))[1])
    left = {x.name for x in spark.catalog.listTables()}
    found = delta_lloyd.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"), rounds=2)
    assert found.count() == 500 and {x.name for x in spark.catalog.listTables()} == left
    later = [p for n, p in plans if n in ("round_1", "round_2")]
    assert len(later) == 2 and not any("Exchange" in p for p in later)


def test_only_changed_centroids_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (400, 4)).astype(np.int64)
    old = rng.integers(-50, 50, (6, 4)).astype(np.int64)
    owner, near = delta_lloyd.assign(vectors, np.full(400, -1), np.zeros(400, np.int64), old, np.arange(6))
    new = old.copy()
    new[[1, 4]] += 9
    work = []
    plain = delta_lloyd.distances
    monkeypatch.setattr(delta_lloyd, "distances", lambda v, c: (work.append(len(v) * len(c)), plain(v, c))[1])
    found = delta_lloyd.assign(vectors, owner, near, new, np.array([1, 4]))
    want = plain(vectors, new)
    assert (found[0] == want.argmin(1)).all() and (found[1] == want.min(1)).all()
    moved = np.isin(owner, [1, 4]).sum()
    assert sum(work) == moved * 6 + (400 - moved) * 2
    told = delta_lloyd.transfers(vectors, owner, found[0])
    assert sum(n for n, _ in told.values()) == 0 and all(vectors[found[0] == c].sum(0).tolist() == (vectors[owner == c].sum(0) + s).tolist() for c, (_, s) in told.items())


def test_large_components_are_exact():
    v = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64)
    c = np.array([[-(1 << 26) + 1, 5]], np.int64)
    assert delta_lloyd.distances(v, c)[:, 0].tolist() == [sum((int(a) - int(b)) ** 2 for a, b in zip(x, c[0])) for x in v]


@pytest.mark.parametrize("name", ["op11_divergence", "op13_delta_lloyd"])
def test_sql(spark, name):
    from tesserae.llm.queries import QUERIES

    assert same(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) > 0
