"""Language-model scoring by context-tree weighting over bytes.

A text's words, lower-cased, joined by spaces and closed by an end symbol, are predicted byte by
byte.  A byte is eight binary decisions; each has a tree of contexts, the preceding bytes up to
a depth.  A node holds a Krichevsky-Trofimov estimate of its counts, and the weighted
probability P_w = (P_e + product of the children's P_w) / 2 mixes all depths: what is predicted
is, along the path of the context, w * KT + (1 - w) * the child's prediction with
w = P_e / (2 P_w).

The counts cover all training text, and every context seen in it is a node.  Subtrees below the
contexts of TOP bytes are built apart, twice: up for the weights, and down, once the few nodes
above are known, for the probabilities of all grams (context and byte) that occur in any text.
Scoring reads that table in slices.

The base score beside it is a word unigram with add-one smoothing.  Counts of frequent words go
to the workers; all others are joined by shuffle, where no key is frequent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import byte_runs, distinct, spans
from ..functions.worker import release_memory, worker_store
from ..sources.scratch import materialize, scratch_path
from ..sources.shared import file_system

#: Bytes of context at most; a context and its next byte must fit 7 bytes.
DEPTH = 5
#: The subtrees of contexts of so many bytes are built apart; the nodes above, at most 255 for each
#: of up to 256 contexts, are summed on the driver.
TOP = 2
#: Grams of a task that builds subtrees, about.
TASK_GRAMS = 200_000
#: The table of probabilities is read in slices of so many grams (12 bytes each).
SLICE_ROWS = 1 << 20
#: Words of over 1 / HEAD_SHARE of the training tokens are frequent: there are fewer than
#: HEAD_SHARE of them, whose counts go to the workers (16 bytes each).
HEAD_SHARE = 1 << 21
#: Never in UTF-8: ends a text, and stands before its start.
END = 0xFF
#: Texts are taken together up to about so many bytes.
CHUNK_CHARS = 2_000_000
#: The same for scoring: the table is read once for each such run of texts.
SCORE_CHARS = 6_000_000
#: A task's counts are passed on when there are so many distinct keys.
HELD_KEYS = 700_000
#: The end token's key: no word holds a space.
END_KEY = int.from_bytes(xxhash.xxh64_digest(b" "), "big", signed=True)
WORD, GRAM = 0, 1


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 7."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def normalized(text: str | None) -> bytes:
    """Words of a text, lower-cased (A-Z), joined by single spaces."""
    return b" ".join((text or "").encode().lower().split())


def sequences(texts: list[bytes], depth: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one buffer, each with its end before and after; the grams (context and byte) of
    all their bytes with the end, the texts' first gram, and the buffer's text starts."""
    lead = bytes([END]) * depth
    data = b"".join([lead + t + lead[:1] for t in texts])
    size = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(size + depth) - size
    front = b"\0" * 7 + data
    eight = np.ndarray((len(data),), ">u8", front, strides=(1,))
    real = np.ones(len(data), bool)
    real[(starts[:, None] - np.arange(1, depth + 1)).ravel()] = False
    grams = eight[real].astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1)
    return data, grams, np.cumsum(size) - size, starts


def word_keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">i8").astype(np.int64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' keys, the number of the distinct word of each token, and its text."""
    data = b"\0".join(texts)
    starts, ends = spans(data, b" \0") if texts else (np.zeros(0, int), np.zeros(0, int))
    size = np.array([t.count(b" ") + t.count(b"\0") + 1 for t in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), size)
    full = ends > starts
    codes, words = distinct(data, starts[full], ends[full])
    return word_keys(words), codes, own[full]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts (column 1), normalized."""
    for batch in batches:
        for a, b in byte_runs(batch.column(1), size):
            part = batch.slice(a, b - a)
            yield part, [normalized(t.as_py()) for t in part.column(1)]


def _counter(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], GRAM: []}

        def folded(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[kind]])
            codes, distinct_ = pd.factorize(keys)
            return distinct_, np.bincount(codes, weights=np.concatenate([n for _, n in held[kind]])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (WORD, GRAM):
                if held[kind]:
                    keys, n = folded(kind)
                    held[kind] = []
                    for at in range(0, len(keys), 100_000):
                        part = keys[at : at + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind)), pa.array(part.astype(np.int64)), pa.array(n[at : at + 100_000])], ["kind", "key", "n"])

        for part, texts in _chunks(batches):
            _, grams, first, _ = sequences(texts, depth)
            train = ~part.column(2).to_numpy(zero_copy_only=False)
            codes, keys = pd.factorize(grams)
            held[GRAM].append((keys, np.bincount(codes, weights=np.repeat(train, np.diff(np.r_[first, len(grams)])))))
            texts = [t for t, x in zip(texts, train) if x]
            if not texts:
                continue
            words, of, _ = words_of(texts)
            held[WORD].append((np.r_[words, END_KEY], np.r_[np.bincount(of, minlength=len(words)), len(texts)]))
            for kind in (WORD, GRAM):
                if len(held[kind]) > 4:
                    held[kind] = [folded(kind)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD_KEYS:
                yield from flush()
        yield from flush()
        release_memory()

    return count


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series at x + 7."""
    shift = np.ones_like(x)
    for k in range(7):
        shift *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


class Level:
    """Binary nodes of all contexts of one depth: key (context, node), counts, estimates, weights."""

    def __init__(self, keys: np.ndarray, zero: np.ndarray, one: np.ndarray, split: np.ndarray | None):
        self.keys, self.zero, self.one = keys, zero, one
        log_pe = _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - _log_gamma(zero + one + 1) - np.log(np.pi)
        if split is None:
            self.log_pw, self.own, self.rest = log_pe, np.ones(len(keys)), np.zeros(len(keys))
        else:
            self.log_pw = np.logaddexp(log_pe, split) - np.log(2)
            self.own, self.rest = (np.exp(x - np.log(2) - self.log_pw) for x in (log_pe, split))

    def above(self, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys of the parents, at ``depth``, the parent of each node, and the parents' sums: counts and log P_w."""
        context = (self.keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
        keys, of = np.unique(context << np.uint64(8) | self.keys & np.uint64(255), return_inverse=True)
        return keys, of, tuple(np.bincount(of, weights=x, minlength=len(keys)) for x in (self.zero, self.one, self.log_pw))

    def mixed(self, given: np.ndarray) -> np.ndarray:
        """What is settled down to this level: P(0), P(1) and the share left to the children."""
        left, both = given[2], self.zero + self.one + 1
        return np.stack([given[0] + left * self.own * (self.zero + 0.5) / both, given[1] + left * self.own * (self.one + 0.5) / both, left * self.rest])


def _levels(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels from ``depth`` to ``top`` of all grams of some contexts of length ``top``, the parents
    between them, and each gram's eight nodes.  A gram of count 0 only gives nodes to ask for."""
    leaf = (grams & np.uint64(255)) + np.uint64(256)
    nodes = np.stack([leaf >> np.uint64(8 - i) for i in range(8)], 1)
    keys, at = np.unique((grams >> np.uint64(8) << np.uint64(8))[:, None] | nodes, return_inverse=True)
    at = at.reshape(-1, 8)
    bits = np.stack([leaf >> np.uint64(7 - i) & np.uint64(1) for i in range(8)], 1).astype(bool)
    weight = np.repeat(n.astype(np.float64), 8).reshape(-1, 8)
    zero, one = (np.bincount(at.ravel(), weights=np.where(hit, weight, 0).ravel(), minlength=len(keys)) for hit in (~bits, bits))
    levels, parents = [Level(keys, zero, one, None)], []
    for d in range(depth - 1, top - 1, -1):
        keys, of, sums = levels[-1].above(d)
        parents.append(of)
        levels.append(Level(keys, *sums))
    return levels, parents, at


def _log2(levels: list[Level], parents: list[np.ndarray], at: np.ndarray, grams: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Log2 probability of each gram's last byte; ``given``: ``mixed`` above the last level."""
    for level, of in zip(levels[::-1], [*parents[::-1], None]):
        given = level.mixed(given)
        if of is not None:
            given = given[:, of]
    logs, out = np.log2(given[:2]), np.zeros(len(grams))
    for i in range(8):
        bit = (grams >> np.uint64(7 - i) & np.uint64(1)).astype(np.int64)
        out += logs[bit, at[:, i]]
    return out


def _start(n: int) -> np.ndarray:
    return np.stack([np.zeros(n), np.zeros(n), np.ones(n)])


class ContextTree:
    """The model of few grams, in memory."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        self.grams, self.n, self.depth = grams, n, depth

    @staticmethod
    def build(depths: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, depth: int) -> ContextTree:
        """From rows (depth, context, byte, count), of which those of the full depth are read."""
        at = depths == depth
        return ContextTree(contexts[at] << np.uint64(8) | symbols[at].astype(np.uint64), counts[at], depth)

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """Log2 probability of each gram's last byte after its other bytes."""
        every, of = np.unique(np.r_[self.grams, grams], return_inverse=True)
        levels, parents, at = _levels(every, np.bincount(of[: len(self.grams)], weights=self.n, minlength=len(every)), self.depth, 0)
        return _log2(levels, parents, at, every, _start(len(levels[-1].keys)))[of[len(self.grams) :]]


def _place(grams: np.ndarray) -> np.ndarray:
    """Grams with their last TOP context bytes in front: what a table slice is ordered by."""
    return grams >> np.uint64(8) << np.uint64(64 - 8 * TOP) | grams


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = list(batches)
    keys, n = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held] or [np.zeros(0, np.int64)]) for i in range(2))
    return keys.astype(np.uint64), n


def _summed(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over whole contexts of length TOP for the nodes of the next shorter ones."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _rows(batches)
        if len(grams):
            keys, _, sums = _levels(grams, n, depth, TOP)[0][-1].above(TOP - 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *[pa.array(x) for x in sums]], ["key", "zero", "one", "split"])
        release_memory()

    return up


def _tabled(folder: str, depth: int, keys: np.ndarray, given: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes log2 probabilities of all grams as slices, ordered by place."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _rows(batches)
        if len(grams):
            grams, n = (x[np.argsort(_place(grams))] for x in (grams, n))
            levels, parents, at = _levels(grams, n, depth, TOP)
            asked, of, _ = levels[-1].above(TOP - 1)
            log2 = _log2(levels, parents, at, grams, given[:, np.searchsorted(keys, asked)[of]]).astype(np.float32)
            place, out = _place(grams), []
            for i in range(0, len(grams), SLICE_ROWS):
                fs, path = file_system(f"{folder}-{uuid.uuid4().hex}")
                part = place[i : i + SLICE_ROWS]
                with fs.open_output_stream(path) as f:
                    f.write(part.tobytes() + log2[i : i + SLICE_ROWS].tobytes())
                out.append((path, int(part[0]), int(part[-1]), len(part)))
            # unsigned places travel as text
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([str(r[1]) for r in out]), pa.array([str(r[2]) for r in out]), pa.array([r[3] for r in out], pa.int64())], ["path", "first", "last", "n"])
        release_memory()

    return down


class Table:
    """Log2 probabilities of grams, read by slices of SLICE_ROWS at most."""

    def __init__(self, folder: str, slices: list[tuple[str, int, int, int]]):
        self.fs, self.slices = file_system(folder)[0], slices

    def log2(self, grams: np.ndarray) -> np.ndarray:
        codes, own = pd.factorize(_place(grams))
        order = np.argsort(own)
        asked, found = own[order], np.zeros(len(own))
        for path, first, last, n in self.slices:
            i, j = np.searchsorted(asked, np.uint64(first)), np.searchsorted(asked, np.uint64(last), "right")
            if i < j:
                with self.fs.open_input_file(path) as f:
                    data = f.read()
                at = np.searchsorted(np.frombuffer(data, np.uint64, n), asked[i:j])
                found[order[i:j]] = np.frombuffer(data, np.float32, n, 8 * n)[at]
        return found[codes]


def _uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def build_tree(grams: DataFrame, folder: str, depth: int = DEPTH) -> list[tuple[str, int, int, int]]:
    """Write the probabilities of all gram counts ``key, n`` below ``folder``; gives the slices.

    A task has all grams of some contexts of length TOP, and with them their whole subtrees.
    """
    dealt = grams.select("key", "n").repartitionByRange(grams.count() // TASK_GRAMS + 1, F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)))
    part = dealt.mapInArrow(_summed(depth), "key long, zero double, one double, split double")
    rows = part.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "split")]).toPandas().sort_values("key")
    levels = [Level(rows["key"].to_numpy().astype(np.uint64), *[rows[c].to_numpy() for c in ("zero", "one", "split")])]
    parents = []
    for d in range(TOP - 2, -1, -1):
        keys, of, sums = levels[-1].above(d)
        parents.append(of)
        levels.append(Level(keys, *sums))
    given = _start(len(levels[-1].keys))
    for level, of in zip(levels[::-1], [*parents[::-1], None]):
        given = level.mixed(given)
        given = given if of is None else given[:, of]
    slices = dealt.mapInArrow(_tabled(folder, depth, levels[0].keys, given), "path string, first string, last string, n long").collect()
    return sorted((r["path"], int(r["first"]), int(r["last"]), r["n"]) for r in slices)


class WordCounts:
    """Counts of frequent words by key."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        rows = pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=["key", "n"])
        keys = rows["key"].to_numpy()
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], rows["n"].to_numpy()[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts; -1 for a key that isn't in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], -1)


_SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, log2 double, n_bytes long, tail array<long>"


def _scorer(folder: str, slices: list[tuple[str, int, int, int]], head: str, depth: int, total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores rows (doc_id, text, held_out); ``total`` is the base model's denominator."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = Table(folder, slices), worker_store("words", head, lambda: WordCounts(head))
        for batch, texts in _chunks(batches, SCORE_CHARS):
            n = len(texts)
            _, grams, first, _ = sequences(texts, depth)
            log2 = np.add.reduceat(tree.log2(grams), first) if n else np.zeros(0)
            keys, codes, own = words_of(texts)
            found = counts.find(np.r_[keys, END_KEY])
            of, end = found[:-1][codes], max(int(found[-1]), 0)
            in_head = of >= 0
            base = np.bincount(own[in_head], weights=np.log10((of[in_head] + 1) / total), minlength=n) + np.log10((end + 1) / total)
            known = np.bincount(own[in_head & (of > 0)], minlength=n) + (end > 0)
            tail, at = keys[codes[~in_head]], own[~in_head]
            offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=n))].astype(np.int32)
            size = np.diff(np.r_[first, len(grams)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.bincount(own, minlength=n) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(log2), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tail))],
                [x.split()[0] for x in _SCORED.split(", ")],
            )
        release_memory()

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``score`` is the log10 probability of the whole text, ``bits_per_byte`` its code length by
    byte, the end symbol included.  A null text is an empty one, of which the end is
    predicted; a null id counts as the empty text.  Rows that repeat give rows that repeat; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    partial = rows.select("doc_id", "text", "held_out").mapInArrow(_counter(depth), "kind long, key long, n long")
    counts = materialize(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    folder, head = _uri(scratch_path(spark, "slice")), _uri(scratch_path(spark, "head"))
    slices = build_tree(counts.filter(F.col("kind") == GRAM).select("key", "n"), folder, depth)
    is_head = (F.col("n") > n // HEAD_SHARE) | (F.col("key") == END_KEY)
    words.filter(is_head).write.parquet(head)
    total = n + v + 1
    scored = rows.select("doc_id", "text", "held_out").mapInArrow(_scorer(folder, slices, head, depth, total), _SCORED)
    scored = materialize(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    tail = scored.select("rid", F.explode("tail").alias("key"))
    looked = tail.join(words.filter(~is_head), "key", "left").select("rid", F.coalesce("n", F.lit(0)).alias("c"))
    sums = looked.groupBy(F.col("rid").alias("_rid")).agg(F.sum(F.log10((F.col("c") + 1) / F.lit(total))).alias("tail_base"), F.sum((F.col("c") > 0).cast("long")).alias("tail_known"))
    joined = scored.drop("tail").join(sums, F.col("rid") == F.col("_rid"), "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("log2") * float(np.log10(2))).alias("score"),
        (-F.col("log2") / F.col("n_bytes")).alias("bits_per_byte"),
    )
