import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import collinear, context_tree, dac, exact_dedup, mixing, packed, quality_rules, sentencepiece_lattice, simhash, toxicity, url_filters
from tesserae.llm.oracles import ORACLES
from tesserae.llm.queries import QUERIES

from ..oracle import connect, same

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Null in any column, empty and odd texts, ties, repeated rows; extra columns with clashing names.
ODD = [
    (1, "same text here", "a", 1),
    (2, "same text here", None, 2),
    (2, "same text here", "a", 2),
    (None, "same text here", "b", 3),
    (3, None, "b", 4),
    (4, "", "b", 5),
    (5, " \n\t ", None, 6),
    (6, "x", "c", None),
    (7, "word " * 3000, "c", 7),
    (8, "ünïcode ▁ text \U0001f600 here", "c", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, n, n, "k", i) for i, t, s, n in ODD], "doc_id long, text string, source string, row long, n long, key string, rid long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert same(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole_tables(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() == 200 or name == "op8_repeated_passages"


def test_severity_by_brute_force(spark, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {d["doc_id"]: d["text"] for d in docs.collect()}
    assert model.weights
    for r in QUERIES["op4_toxicity"](spark, SF).collect():
        words = collections.Counter(re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])))
        found = collections.Counter()
        for w, n in words.items():
            raw = w.encode()
            for f in {f"={w}", *(f"{w[:k]}-" for k in toxicity.PREFIXES if len(w) > k)}:
                found[f] += n
            assert raw.decode() == w
        z = sum(model.weights[f] * math.log1p(n) for f, n in found.items() if f in model.weights)
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(p)) and r["p_toxic"] == pytest.approx(p[0])
        assert (r["grade"], r["toxic"]) == (sum(x >= 0.5 for x in p), p[0] >= toxicity.THRESHOLD)


def test_fit_is_an_optimum():
    rng = random.Random(14)
    counts = [collections.Counter({f"={w}": rng.randint(1, 4) for w in rng.sample("abcde", 3)}) for _ in range(150)]
    grades = np.array([min(c["=a"] // 2 + rng.randint(0, 1), 3) for c in counts])
    names, l2 = [f"={w}" for w in "abcde"], 0.01
    model = toxicity.fit(counts, grades, names, l2=l2)

    def loss(weights, thresholds):
        above = sum(g > 0 for g in grades)
        total = 0.0
        for c, g in zip(counts, grades):
            z = sum(weights[f] * math.log1p(n) for f, n in c.items())
            own = sum(math.log1p(math.exp(t - z)) if g >= k else math.log1p(math.exp(z - t)) for k, t in enumerate(thresholds, 1))
            total += own * 0.5 / (above if g else len(grades) - above)
        return total + l2 / 2 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.thresholds)
    for f in names:
        for step in (-0.05, 0.05):
            assert loss(model.weights | {f: model.weights[f] + step}, model.thresholds) > best - 1e-6
    for k in range(3):
        for step in (-0.05, 0.05):
            moved = [t + step * (i == k) for i, t in enumerate(model.thresholds)]
            assert loss(model.weights, moved) > best - 1e-6


def ops(frame, labels):
    model = toxicity.train(frame, labels)
    return {
        "mix": mixing.mix(frame).drop("row"),
        "mixed": mixing.mixed_rows(frame),
        "ledger": quality_rules.apply_policy(quality_rules.ledger(frame)),
        "toxicity": toxicity.severity(frame, model),
        "clean": toxicity.drop_toxic(frame, model),
        "dac": dac.token_files(frame, BPE),
        "simhash": simhash.near_duplicates(frame),
        "simhash_rows": simhash.drop_near_duplicates(frame),
        "ctw": context_tree.score(frame),
        "passages": collinear.repeated_passages(frame),
        "pieces": sentencepiece_lattice.encode(frame, PIECES),
        "exact": exact_dedup.exact_dedup(frame),
        "exact_rows": exact_dedup.drop_copies(frame),
    }


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    found = {k: v.collect() for k, v in ops(odd, labels).items()}
    for k in ("mix", "mixed", "ledger", "toxicity", "dac", "simhash", "ctw", "pieces", "exact"):
        assert len(found[k]) == len(ODD), k
    copies = [r for r in found["exact"] if r["group_size"] > 1]
    assert sum(r["kept"] for r in copies) == 2 and all(r["keep_id"] in (2, 4) for r in copies)
    assert sorted(r["doc_id"] for r in found["exact_rows"]) == [2, 4, 5, 6, 7, 8]
    assert {r["fingerprint"] for r in found["simhash"] if r["doc_id"] in (3, 4, 5)} == {"0" * 16}
    assert sorted(r["position"] for r in found["mix"]) == sorted({r["position"] for r in found["mix"]})
    assert [r["n_tokens"] for r in sorted(found["dac"], key=lambda r: r["start"]) if r["doc_id"] in (3, 4)] == [1, 1]
    assert {r["doc_id"]: r["round_trip"] for r in found["pieces"]}[8] is False
    for k, df in ops(odd.limit(0), labels.limit(0)).items():
        assert df.count() == 0, k


def test_ledger_by_brute_force(docs):
    for r in quality_rules.ledger(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(words), len(covered))


def test_ablations(docs):
    rows = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in rows.collect()]
    mask = quality_rules.PRODUCTION.mask
    for r in quality_rules.ablations(rows).collect():
        own = 1 << [x.name for x in quality_rules.RULES].index(r["rule"])
        assert r["failed"] == sum(b & own > 0 for b in bits)
        assert r["only_rejected_by"] == sum(b & mask == own for b in bits)
        assert r["kept_without"] == sum(b & mask & ~own == 0 for b in bits)


def deviation(plan, weights):
    """The most that a source is away from its share after any slot of the first phase."""
    total, ran, worst = sum(weights.values()), dict.fromkeys(weights, 0), 0.0
    for t, (s, _, slot, phase) in enumerate(plan, 1):
        if phase:
            break
        assert slot == t - 1
        ran[s] += 1
        worst = max(worst, *(abs(ran[x] - w / total * t) for x, w in weights.items()))
    return worst


def test_schedule_deviates_by_less_than_a_block():
    rng = random.Random(1)
    for _ in range(50):
        weights = {f"s{i}": rng.random() ** 3 + 1e-4 for i in range(rng.randint(2, 9))}
        blocks = {s: rng.randint(1, 300) for s in weights}
        plan = mixing.schedule(blocks, weights)
        assert sorted((s, b) for s, b, _, _ in plan) == sorted((s, b) for s, n in blocks.items() for b in range(n))
        assert deviation(plan, weights) < 1
    weights = {"a": 0.12345, "b": 0.87655}
    assert deviation(mixing.schedule({"a": 123_450, "b": 876_550}, weights), weights) < 1


def plain_schedule(blocks, weights):
    """Slot by slot: of the released next blocks of all sources the one that is due first."""
    from fractions import Fraction

    done, out = dict.fromkeys(blocks, 0), []
    while live := sorted((s for s in blocks if done[s] < blocks[s]), key=lambda s: (s is None, s or "")):
        share = {s: Fraction(weights[s]) / sum(Fraction(weights[x]) for x in live) for s in live}
        start, now = dict(done), 0
        while all(done[s] < blocks[s] for s in live):
            i = {s: done[s] - start[s] for s in live}
            able = [s for s in live if math.floor(i[s] / share[s]) <= now]
            s = min(able, key=lambda s: math.ceil((i[s] + 1) / share[s]))
            out.append((s, done[s]))
            done[s] += 1
            now += 1
    return out


def test_mixing_by_brute_force(spark, odd):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = df.select("*", F.xxhash64("doc_id").alias("_h"), F.xxhash64(*df.columns).alias("_w")).collect()
        of = collections.defaultdict(list)
        for r in rows:
            key = r["_w"] if r["doc_id"] is None else r["_h"]
            of[r["source"]].append((key % 2**64 >> 33, key, r["doc_id"] or 0, r["_w"], r["doc_id"]))
        weights = mixing.default_weights({s: len(x) for s, x in of.items()})
        plan = plain_schedule({s: -(-len(x) // 3) for s, x in of.items()}, weights)
        told = [r[4] for s, b in plan for r in sorted(of[s])[3 * b : 3 * b + 3]]
        found = mixing.mix(df, block_rows=3).orderBy("position").collect()
        assert [r["doc_id"] for r in found] == told


def test_mixing_keeps_all_rows_at_target(docs):
    rows = mixing.mix(docs, {f"src{i}": 1.0 + i for i in range(20)}, block_rows=1).orderBy("position").collect()
    assert len({r["doc_id"] for r in rows}) == 200
    first = [r for r in rows if r["phase"] == 0]
    counts = collections.Counter(r["source"] for r in first)
    assert all(abs(counts[f"src{i}"] - len(first) * (1 + i) / 210) < 1.5 for i in range(20))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 1.0})


def test_list_entries_act_from_their_date_on(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.bad.com/x", "2024-01-01"), (2, "http://a.bad.com/x", "2024-02-01"), (3, "http://a.bad.com/ok/y", "2024-02-01"), (4, "http://BAD.com", "2024-04-01"), (5, None, "2024-02-01"), (6, "http://bad.com", None), (7, "no url", "2024-02-01")],
        "id int, url string, at string",
    )
    events = spark.createDataFrame(
        [("bad.com", "block", "2024-01-15"), ("bad.com", "remove", "2024-03-01"), ("a.bad.com/ok", "allow", "2024-01-20"), (None, "block", "2024-01-01"), ("z.com", "odd", "2024-01-01")],
        "entry string, action string, since string",
    ).withColumn("since", F.to_timestamp("since"))
    found = {r["id"]: r["verdict"] for r in url_filters.filter_captures(pages, events, "id", "url", "at").collect()}
    assert found == {1: "pass", 2: "block", 3: "allow", 4: "pass", 5: "pass", 6: "pass", 7: "pass"}
    assert {r["verdict"] for r in url_filters.filter_captures(pages, events.limit(0), "id", "url", "at").collect()} == {"pass"}


def test_deep_list_entries_act(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/a/b/c/d/e?q", "2024-02-01"), (2, "http://bad.com/a/b/c/x", "2024-02-01"), (3, "http://bad.com/a/b", "2024-02-01")], "id int, url string, at string")
    events = spark.createDataFrame([("bad.com/a/b/c", "block", "2024-01-15"), ("bad.com/a/b/c/d/e", "allow", "2024-01-15")], "entry string, action string, since string").withColumn("since", F.to_timestamp("since"))
    found = {r["id"]: r["verdict"] for r in url_filters.filter_captures(pages, events, "id", "url", "at").collect()}
    assert found == {1: "allow", 2: "block", 3: "pass"}


def test_paths_keep_their_case_and_ties_have_an_order(spark):
    rows = [(1, "http://A.com/Docs/x", "2024-02-01"), (2, "http://a.com/docs/x", "2024-02-01"), (2, "http://a.com/docs/x", "2024-02-01"), (None, "http://u:p@b.com:80//p//q/?x#y", "2024-02-01"), (3, "http://c.com/" + "s/" * 3000, "2024-02-01"), (4, "", None)]
    pages = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "id int, url string, at string, key string, rank int, rid int")
    events = [("A.com/Docs/", "block", "2024-01-15"), ("b.com/p/q", "block", "2024-01-15"), ("b.com/p/q", "allow", "2024-01-15"), ("c.com/" + "s/" * 2000, "block", "2024-01-15")]
    listed = spark.createDataFrame(events, "entry string, action string, since string").withColumn("since", F.to_timestamp("since"))
    found = sorted((r["id"] or 0, r["verdict"]) for r in url_filters.filter_captures(pages, listed, "id", "url", "at").collect())
    assert found == [(0, "allow"), (1, "block"), (2, "pass"), (2, "pass"), (3, "block"), (4, "pass")]
    assert url_filters.filter_captures(pages.limit(0), listed, "id", "url", "at").count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    held = toxicity.severity(docs, model).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id")
    n = {(r["y"], r["toxic"]): r["n"] for r in held.groupBy("y", "toxic").agg(F.count("*").alias("n")).collect()}
    assert n[(1, True)] / (n[(1, True)] + n.get((1, False), 0)) > 0.85
    assert n.get((0, True), 0) / (n[(0, False)] + n.get((0, True), 0)) < 0.03


def test_grades_are_ordered():
    texts = [b"nice day", b"you fool", b"fool fool fool fool", b"fool " * 20] * 20
    grades = np.array([0, 1, 2, 3] * 20)
    model = toxicity.fit([toxicity.feature_counts(t, {"=fool"}) for t in texts], grades, ["=fool"])
    score = model.scorer()
    assert [round(float(score(t).sum())) for t in texts[:4]] == [0, 1, 2, 3]


def test_dac_gives_any_token():
    rng = random.Random(2)
    ids = np.array([rng.choice([0, 5, 255, 256, 65_535, 65_536, 10**9]) for _ in range(3000)], np.uint32)
    f = dac.DacFile(dac.file_bytes([1, None], [1000, 2000], ids))
    assert all(f.token(i) == ids[i] for i in range(0, 3000, 7)) and (f.tokens(777, 2345) == ids[777:2345]).all() and f.doc_ids == [1, None]


def test_dac_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(BPE), 0
    found = sorted(dac.token_files(docs, BPE).collect())
    for r, d in zip(found, sorted(docs.select("doc_id", "text").collect())):
        ids = [*library.encode(d["text"], add_special_tokens=False).ids, 2]
        assert tuple(r)[:4] == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    texts = ["x\ny z, ab. Q", "a\n", "don't 12's  ", "", "  ", " \n x", "日本 語", "a<|endoftext|>b", "é£x\x00y"]
    assert [x.tolist() for x in dac.Encoder(BPE).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tiled", [False, True])
def test_simhash_by_brute_force(spark, docs, monkeypatch, tiled):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in prints[:60]:
        for _ in range(4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    if tiled:
        monkeypatch.setattr(simhash, "TILE_ROWS", 16)
        monkeypatch.setattr(simhash, "SHORT_RUN", 3)
        monkeypatch.setattr(simhash, "BROADCAST_TILED", 0)
    found = simhash.connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    root = {p: p for p in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                a, b = top(signed[i]), top(signed[j])
                root[max(a, b)] = min(a, b)
    assert {r["node"]: r["root"] for r in found.collect()} == {p: top(p) for p in signed if top(p) != p}
    if not tiled:
        texts = {d["doc_id"]: d["text"] for d in docs.collect()}
        assert all(int(r["fingerprint"], 16) == brute_fingerprint(texts[r["doc_id"]]) for r in simhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("edges", [200_000, 3])
def test_components_by_rounds(spark, monkeypatch, edges):
    from tesserae.operators import components

    monkeypatch.setattr(components, "ONE_TASK_EDGES", edges)
    rng = random.Random(12)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = components.connected_components(spark.createDataFrame([*pairs, (None, 7), (5, 5)], "u long, v long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: top(x) for x in root if top(x) != x}


def test_near_duplicates_go_by_row(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "first of all texts is this", "a"), (5, text, "b"), (7, text, "c"), (7, "a text of its own that has seven words", "d"), (None, text, "e"), (9, "nobody else says nine", "f"), (9, "nobody else says nine", "g"), (None, "an id is missing here but the text is new", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fp2 string")
    found = sorted((r["doc_id"] or 0, r["_fp2"]) for r in simhash.drop_near_duplicates(df).collect())
    assert [x for x in found if x[0] != 9] == [(0, "h"), (1, "a"), (5, "b"), (7, "d")]
    assert len(found) == 5 and df.columns == simhash.drop_near_duplicates(df).columns


def test_context_tree_by_brute_force():
    rng, depth = random.Random(4), 2
    texts = [bytes(rng.choice(b"abca") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    grams = collections.Counter(context_tree.sequences(texts, depth)[1].tolist())
    rows = []
    for d in range(depth + 1):
        own = collections.Counter()
        for g, n in grams.items():
            own[g & ((1 << 8 * (d + 1)) - 1)] += n
        rows += [(d, g >> 8, g & 255, n) for g, n in own.items()]
    tree = context_tree.ContextTree.build(*[np.array([r[k] for r in rows], t) for k, t in enumerate((int, np.uint64, int, int))], depth)
    known = {(d, c) for d, c, _, _ in rows}

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def counts(d, c, node):
        both = [0, 0]
        for dd, cc, s, n in rows:
            if (dd, cc) == (d, c):
                v = 256 + s
                while v > 1:
                    if v >> 1 == node:
                        both[v & 1] += n
                    v >>= 1
        return both

    def log_pw(d, c, node):
        pe = log_kt(*counts(d, c, node))
        kids = [x for dd, x in known if dd == d + 1 and x & ((1 << 8 * d) - 1) == c]
        return np.logaddexp(pe, sum(log_pw(d + 1, k, node) for k in kids)) - math.log(2) if kids else pe

    def one(context, node):
        q = 0.5
        for d in range(depth, -1, -1):
            c = context & ((1 << 8 * d) - 1)
            if (d, c) in known:
                a, b = counts(d, c, node)
                w = 1 if d == depth else math.exp(log_kt(a, b) - math.log(2) - log_pw(d, c, node))
                q = w * (b + 0.5) / (a + b + 1) + (1 - w) * q
        return q

    for gram in [*list(grams)[:8], 97 << 16 | 98 << 8 | 100]:
        node, total = 1, 0.0
        for bit in range(7, -1, -1):
            x = gram >> bit & 1
            p = one(gram >> 8, node)
            total += math.log2(p if x else 1 - p)
            node = 2 * node + x
        assert tree.log2(np.array([gram], np.uint64))[0] == pytest.approx(total, abs=1e-4)


def test_all_contexts_are_nodes(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    size = context_tree.DEPTH
    grams = collections.Counter(context_tree.sequences([t.encode() for t, h in zip(texts, held) if not h], size)[1].tolist())
    assert len({g >> 8 for g in grams}) > 100_000
    keys = np.array(list(grams), np.uint64)
    tree = context_tree.ContextTree.build(np.full(len(keys), size), keys >> np.uint64(8), (keys & np.uint64(255)).astype(int), np.array(list(grams.values())), size)
    for r in context_tree.score(df).collect():
        own = tree.log2(context_tree.sequences([texts[r["doc_id"]].encode()], size)[1])
        assert r["score"] == pytest.approx(own.sum() * math.log10(2), rel=1e-5)


def test_unseen_bytes_after_frequent_contexts():
    rows = np.array([(0, 0, 97, 10**8), (1, 97, 97, 10**8)])
    tree = context_tree.ContextTree.build(rows[:, 0], rows[:, 1].astype(np.uint64), rows[:, 2], rows[:, 3], 1)
    found = tree.log2(np.array([97 << 8 | s for s in range(256)], np.uint64))
    assert np.isfinite(found).all() and (2.0**found).sum() == pytest.approx(1)
    assert found[0] == pytest.approx(math.log2(0.5 / (10**8 + 1)) - 6, abs=1)


@pytest.mark.parametrize("share", [1 << 21, 20])
def test_base_scores(docs, monkeypatch, share):
    monkeypatch.setattr(context_tree, "HEAD_SHARE", share)
    texts = {d["doc_id"]: d["text"] for d in docs.collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    gain = 0.0
    for r in context_tree.score(docs).collect():
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert 0 < r["bits_per_byte"] < 8
        gain += r["score"]
    assert gain < 0


def slow_distance(x, y):
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (u != v))
    return row[-1]


def test_alignment():
    rng = random.Random(5)
    for _ in range(500):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert collinear.edit_distance(x, y) == slow_distance(x, y)


def test_chains_are_best():
    rng = random.Random(6)
    for _ in range(50):
        points = sorted({(rng.randrange(60), rng.randrange(60)): rng.randint(1, 9) for _ in range(25)}.items())
        a, b, size = (np.array(x) for x in zip(*[(p[0], p[1], w) for p, w in points]))
        best = []
        for i in range(len(a)):
            left = [j for j in range(i) if a[j] < a[i] and b[j] < b[i]]
            gains = [best[j] - collinear.GAP_COST * (a[i] + b[i] - a[j] - b[j] - 2 * size[j]) for j in left]
            best.append(size[i] + max([0.0, *gains]))
        path = collinear.chain(a, b, size)[0]
        told = sum(int(size[j]) for j in path) - collinear.GAP_COST * sum(a[j] + b[j] - a[i] - b[i] - 2 * size[i] for i, j in zip(path, path[1:]))
        assert told == pytest.approx(max(best))


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        columns = [rng.integers(-(2**63), 2**63 - 1, n), np.sort(rng.integers(0, 10**6, n)), np.full(n, 5), rng.integers(0, 2**32, n), np.zeros(n, np.int64), np.arange(n) - 7]
        assert all((x == y).all() for x, y in zip(packed.unpack(packed.pack(columns)), columns))


@pytest.mark.parametrize("hot", [10_000, 8])
def test_planted_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(collinear, "HOT_ROWS", hot)
    monkeypatch.setattr(collinear, "HOT_SAMPLE", 1 if hot == 8 else 16)
    monkeypatch.setattr(collinear, "LEAST_SEEN", 1)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    rows, planted = [], set()
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        k = rng.randint(0, 5)
        if k < 4:
            p = list(passages[k])
            for _ in range(rng.choice([0, 5])):
                p[rng.randrange(60)] = f"edit{rng.randrange(10**6)}"
            at = rng.randint(0, len(words))
            words[at:at] = p
            planted.add(i)
        rows.append((i, " ".join(words)))
    copied = next(i for i in range(120) if i not in planted)
    rows.append((200, rows[copied][1]))
    found = collinear.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[k] for r in found for k in ("doc_id", "match_doc_id")} == planted | {200, copied}
    assert min(r["identity"] for r in found) >= 0.8


@pytest.mark.parametrize("partners", [32, 1])
@pytest.mark.parametrize("hot", [10_000, 2])
def test_passages_among_partial_quotes(spark, monkeypatch, partners, hot):
    monkeypatch.setattr(collinear, "PARTNERS", partners)
    monkeypatch.setattr(collinear, "HOT_ROWS", hot)
    monkeypatch.setattr(collinear, "HOT_SAMPLE", 1 if hot == 2 else 16)
    monkeypatch.setattr(collinear, "LEAST_SEEN", 1)
    rng = random.Random(9)
    filler = lambda: [f"f{rng.randrange(10**9)}" for _ in range(50)]
    rows, pairs = [], set()
    for base in range(0, 200, 10):
        passage = [f"p{base}x{i}" for i in range(60)]
        part = {5: (0, 60), 9: (0, 60), 1: (0, 39), 2: (21, 60), 7: (0, 39), 8: (21, 60)}
        rows += [(base + k, " ".join([*filler(), *passage[s:e], *filler()])) for k, (s, e) in part.items()]
        pairs.add((base + 9, base + 5, 50, 110, 50, 110))
    found = collinear.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r)[:1] + (r["match_doc_id"], r["start"], r["end"], r["match_start"], r["match_end"]) for r in found} == pairs


def test_passages_of_repeated_ids(spark):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    copied, unique, shared = words("t", 200), words("u", 200), words("s", 80)
    texts = [(5, copied), (7, copied), (5, unique), (9, [*words("x", 30), *shared]), (9, [*words("y", 10), *shared]), (9, [*words("y", 10), *shared]), (None, shared)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    found = {tuple(r) for r in collinear.repeated_passages(df).collect()}
    assert (5, 0, 200, 7, 0, 200, 200, 1.0) in found
    rest = {r for r in found if r[0] != 5}
    assert len(rest) == 1 and len(found) == 2
    assert {next(iter(rest))[k] for k in (0, 3)} == {9} and {next(iter(rest))[k] for k in (1, 4)} == {10, 30}


def equal_runs(texts):
    """Places (document, first word) of each run of MIN_WORDS words."""
    holders = collections.defaultdict(dict)
    for i, words in texts.items():
        for k in range(len(words) - collinear.MIN_WORDS + 1):
            holders[tuple(words[k : k + collinear.MIN_WORDS])].setdefault(i, k)
    return [x for x in holders.values() if len(x) > 1]


def test_query_finds_all_equal_runs(spark, docs):
    texts = {d["doc_id"]: collinear.words_of(d["text"]) for d in docs.collect()}
    found = QUERIES["op8_repeated_passages"](spark, SF).collect()
    of = {(r["doc_id"], r["match_doc_id"]) for r in found}
    covered = collections.defaultdict(set)
    for r in found:
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
        x, y = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["match_doc_id"]][r["match_start"] : r["match_end"]]
        assert len(x) == r["n_words"] >= collinear.MIN_WORDS
        assert r["identity"] == pytest.approx(1 - collinear.edit_distance(x, y) / max(len(x), len(y))) and r["identity"] >= collinear.MIN_IDENTITY
    assert of
    for places in equal_runs(texts):
        assert sum(covered[i].issuperset(range(k, k + collinear.MIN_WORDS)) for i, k in places.items()) >= len(places) - 1


def test_passages_in_templates_and_with_edits(spark):
    rng = random.Random(10)
    other = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    blocks = [[f"b{k}x{i}" for i in range(51)] for k in range(8)]
    forms = [[w for b in blocks for w in [*b, *other(15)]] for _ in range(2)]
    rows = [(1, " ".join(forms[0])), (2, " ".join(forms[1]))]
    for k in range(50):
        passage = [f"e{k}x{i}" for i in range(100)]
        edited = [w if i % 10 else other(1)[0] for i, w in enumerate(passage)]
        rows += [(10 + 2 * k, " ".join([*other(30), *passage, *other(30)])), (11 + 2 * k, " ".join([*other(30), *edited, *other(30)]))]
    found = collinear.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for r in found if r["doc_id"] == 2 for w in range(r["start"], r["end"])}
    assert covered >= {w for k in range(8) for w in range(66 * k, 66 * k + 51)}
    assert {r["doc_id"] for r in found if r["doc_id"] > 9} == {11 + 2 * k for k in range(50)}
    assert min(r["identity"] for r in found) >= 0.8


@pytest.mark.parametrize("shipped", [1 << 20, 50])
def test_pieces_equal_the_library(spark, monkeypatch, shipped):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_lattice.shipped_threshold, "__defaults__", (shipped,))
    rng = random.Random(8)
    texts = ["".join(rng.choice("  aabtheingION.,\n\téß日1²-'▁\" x") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["a" * 300 + "the" * 100, "", "  ", "\n", "x ", "a\n\n b", " lead", "the  quick   brown", "\n x\n", "nul\x00 byte"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepiece_lattice.encode(df, PIECES)
    for r in rows.collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])
        assert r["round_trip"] or "▁" in texts[r["doc_id"]]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_lattice.decode(rows, PIECES).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if "▁" not in t)


def test_exact_dedup_by_brute_force(docs):
    groups = collections.defaultdict(list)
    for d in docs.collect():
        groups[d["text"]].append(d["doc_id"])
    for r in exact_dedup.exact_dedup(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        own = groups[r["text"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    score = toxicity.train(docs, labels).scorer()
    left = {d["doc_id"]: d["text"] for d in docs.collect() if score(d["text"].encode())[0] < toxicity.THRESHOLD}
    newest = {}
    for i, t in left.items():
        newest[t] = max(i, newest.get(t, -1))
    left = {i: t for t, i in newest.items()}
    prints = {i: simhash.fingerprint(t.encode()) & (2**64 - 1) for i, t in left.items()}
    root = {i: i for i in left}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in left:
        for j in left:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    kept = {i for i in left if top(i) == i}
    table = sentencepiece_lattice.PieceTable(PIECES)
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in found} == kept and len(found) == len(kept)
    assert all(table.decode(list(r["ids"])) == left[r["doc_id"]] and r["round_trip"] for r in found)


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, odd):
    import corpus_pipeline
    from tesserae.sources.scratch import materialize

    start = odd.select("doc_id", "text", "source", F.col("key").alias("lang"), F.col("n").alias("n_chars"))
    for docs, kept in ((start, [2, 4, 6, 7, 8]), (start.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES:
            made = materialize(stage(spark, docs, SF), name)
            if name != "encoding":
                assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
            docs = made
        rows = docs.collect()
        assert sorted(r["doc_id"] for r in rows) == kept
        assert [r["round_trip"] for r in rows if r["doc_id"] == 8] == [False] * (8 in kept)
