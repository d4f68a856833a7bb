"""Character ratios by brute force: the kernel, the alignment and the fallback."""

import difflib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.functions import ratio_kernel
from tesserae.operators import chunking
from tesserae.plans.queries import QUERIES, sentence_chunks
from tesserae.thresholds import DEFAULT

SF = "/root/testdata/sf0.001"


def edited(rng, text, share):
    return "".join(rng.choice("abcXYZ é.") if rng.random() < share else c for c in text)


def texts(seed, n):
    rng = random.Random(seed)
    words = "the of and pump valve shall store Record within Seconds zygote quiz jinx Ängström naïve 12 7.5 x_y (see)".split()
    out = ["", "a", "?!" * 30, "a" * 250, "ab" * 150, "\U0001f600" * 5]
    for _ in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(1, 120)))
        out += [text, edited(rng, text, 0.1), edited(rng, text, 0.3), text[: len(text) * 2 // 3], text[::-1]]
    return out


def test_no_pair_is_lost():
    a, b = texts(1, 12), texts(1, 9) + texts(2, 4)
    for least in (0.7, 0.95, 0.3):
        want = {(i, j): r for i, x in enumerate(a) for j, y in enumerate(b) if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= least}
        found = {(i, j): r for i, j, r in ratio_kernel.ratios(ratio_kernel.Texts(a), ratio_kernel.Texts(b), least)}
        assert found == want


def test_matches_are_difflibs():
    rng = random.Random(8)
    every = texts(5, 14)
    pairs = [(rng.choice(every), rng.choice(every)) for _ in range(1500)]
    pairs += [(x[:k] + y, x[:k] + z) for x, y, z in [rng.sample(every, 3) for _ in range(300)] for k in (1, 30)]
    for x, y in pairs:
        plain = difflib.SequenceMatcher(None, x, y)
        assert ratio_kernel.Matcher(y).ratio(x) == plain.ratio()
        if len(y) >= ratio_kernel.LONG:
            # Matches that start at no unpopular character: the beginning alone.
            a, b = ratio_kernel.Texts([x]), ratio_kernel.Texts([y])
            shared = ratio_kernel.Index(*b.grams(), 1).shared(a.grams()[1])[0]
            starts = sum(min(p, q) for p, q in zip(a.counts[0].tolist(), b.rare[0].tolist()))
            assert sum(m.size for m in plain.get_matching_blocks()) <= shared + (ratio_kernel.GRAM - 1) * (starts + 1)


def similarity(x, y):
    u, v = (set(re.findall(r"\w+", t.lower())) for t in (x, y))
    w = len(u & v) / len(u | v) if u and v else 0.0
    most = difflib.SequenceMatcher(None, x, y).quick_ratio()
    if most < DEFAULT.near_identical and 0.7 * most + 0.3 * w < DEFAULT.text_review:
        return 0.0
    r = difflib.SequenceMatcher(None, x, y).ratio()
    return r if r >= DEFAULT.near_identical else 0.7 * r + 0.3 * w


@pytest.mark.parametrize("blocks", [(512, 2048, 4096, 16), (4, 3, 10, 0)])
def test_pairs_and_first_matches_by_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("NEW_BLOCK", "OLD_BLOCK", "KEY_BLOCK"), blocks):
        monkeypatch.setattr(chunking, name, value)
    monkeypatch.setattr(ratio_kernel, "MANY", blocks[3])
    new = [(i % 4, f"n{i}", i, t) for i, t in enumerate(texts(3, 6))] + [(None, "n-", 0, "x"), (9, "n9", 0, "only here"), (1, "nn", 0, None)]
    old = [(i % 4, f"o{i}", 7 * i % 5, t) for i, t in enumerate(texts(3, 5) + texts(4, 2))] + [(None, "o-", 0, "x"), (1, "on", 0, None)]
    frame = lambda rows: spark.createDataFrame(rows, "d long, id string, seq long, text string")
    want = {(x[1], y[1]): similarity(x[3], y[3]) for x in new for y in old if x[0] is not None and x[0] == y[0] and x[3] is not None and y[3] is not None}
    want = {k: s for k, s in want.items() if s >= DEFAULT.text_review}
    found = chunking.similar_pairs(frame(new), frame(old), "d").collect()
    assert {(x["new_id"], x["old_id"]): pytest.approx(x["similarity"]) for x in found} == want
    first = defaultdict(list)
    for (n, o), s in want.items():
        first[n].append((next(y[2] for y in old if y[1] == o), o, s))
    told = {x["chunk_id"]: (x["status"], x["matched_chunk_id"]) for x in chunking.align_first_match(frame(new), frame(old), "d").collect()}
    assert told == {x[1]: (("duplicate" if min(first[x[1]])[2] >= DEFAULT.text_duplicate else "updated"), min(first[x[1]])[1]) if x[1] in first else ("new", None) for x in new}


def test_alignment_query_by_brute_force(spark):
    """The whole query over sf0.001, by a search that stops at the first crossing."""
    by_document = defaultdict(list)
    for x in sentence_chunks(spark, SF).select("document_id", "chunk_id", "chunk_index", "chunk_text").collect():
        by_document[x["document_id"]].append((x["chunk_index"], x["chunk_id"], x["chunk_text"]))
    want = {}
    for rows in by_document.values():
        rows.sort()
        for seq, chunk_id, text in rows:
            new = text + " It was changed." if seq % 3 == 1 else text[::-1] if seq % 3 == 2 else text
            hit = next(((o, s) for _, o, old in rows if (s := similarity(new, old)) >= DEFAULT.text_review), None)
            want[chunk_id] = ("new", None) if hit is None else ("duplicate" if hit[1] >= DEFAULT.text_duplicate else "updated", hit[0])
    found = QUERIES["chunk_align_first_match"](spark, SF).collect()
    assert {x["chunk_id"]: (x["status"], x["matched_chunk_id"]) for x in found} == want


def fallback_by_hand(docs, rows):
    ids = defaultdict(list)
    for i, t in docs:
        ids[t].append(i)
    hits, total = Counter(), Counter(r[0] for r in rows)
    for text, of in ids.items():
        if text is None:
            continue
        for other, _, chunk in rows:
            if chunk is None or (other == min(of) and len(of) == 1) or 2 * min(len(text), len(chunk)) < DEFAULT.chunk_ratio * (len(text) + len(chunk)) - 1e-6:
                continue
            m = difflib.SequenceMatcher(None, text, chunk)
            hits[min(of), other] += m.quick_ratio() >= DEFAULT.chunk_ratio and m.ratio() >= DEFAULT.chunk_ratio
    return {k: round(n / total[k[1]], 6) for k, n in hits.items() if n and n / total[k[1]] >= DEFAULT.chunk_fraction}


@pytest.mark.parametrize("block_texts", [8192, 3])
def test_fallback_by_brute_force(spark, monkeypatch, block_texts):
    monkeypatch.setattr(chunking, "BLOCK_TEXTS", block_texts)
    rng = random.Random(5)
    docs = [(i, t) for i, t in enumerate(texts(6, 8))]
    docs += [(500, docs[20][1]), (501, docs[20][1]), (502, None)]
    rows = [(i, f"{i}_{k}", t) for i, t in docs if t is not None for k, t in enumerate([edited(rng, t, 0.05), t[:40]][: 1 + i % 2])] + [(502, "502_0", None)]
    found = chunking.overlap_fallback(spark.createDataFrame(docs, "document_id long, text string"), spark.createDataFrame(rows, "document_id long, chunk_id string, chunk_text string"))
    want = fallback_by_hand(docs, rows)
    assert {(r["document_id"], r["other_id"]): r["fraction"] for r in found.collect()} == want and len(want) > 9


def test_fallback_query_by_brute_force(spark):
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [tuple(x) for x in sentence_chunks(spark, SF).select("document_id", "chunk_id", "chunk_text").collect()]
    found = QUERIES["overlap_fallback"](spark, SF)
    assert {(r["document_id"], r["other_id"]): r["fraction"] for r in found.collect()} == fallback_by_hand(docs, rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
