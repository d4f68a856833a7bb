"""SentencePiece encoding and decoding over a relational lattice.

A text falls into units that no merge crosses: words with the marker of the space before
them, runs of spaces, marks after a word, line ends.  The distinct units of the corpus are
exploded to their substrings of bounded length, equi-joined to the piece table and grouped
again: the lattice of each unit is the array of its edges.  A fold with the SQL function
``aggregate`` then walks the lattice, and its paths are looked up when texts are encoded.

The fold is not Viterbi's: the piece table at hand is that of a byte-pair model, whose scores
order merges and don't add up along a path, so that the path of the best sum is not the
library's encoding.  The state is the set of boundaries as a bitmask; each step takes the best
scored edge that spans exactly two of the present symbols, leftmost first, and removes the
boundary between them.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import byte_runs, distinct, look_up, spans
from ..functions.worker import no_collection, release_memory, worker_store
from ..sources.scratch import materialize, scratch_path
from ..sources.shared import file_system

SPACE = "▁"
MARKS = ".,"
#: Boundaries of a unit are bits of a long: longer units are merged where they occur.
MAX_UNIT = 61
#: At most so many units' paths are given to each worker (about 30 bytes each): the most
#: frequent ones.  Rarer ones are merged where they occur.
MAX_SHIPPED = 1 << 20
#: A worker's memo of looked-up parts and a task's counts are emptied at this many.
MEMO_PARTS = 200_000
#: Texts are taken together up to about so many bytes.
CHUNK_CHARS = 1_000_000
SEED = 42


class PieceTable:
    """Pieces of a model file: what may be merged, what bytes are, what ids say."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {names[i]: (-float(model.get_score(i)), i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.max_length = max(map(len, self.pieces))
        self.bytes_of = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                self.bytes_of[i] = b""
        joined = "\n".join(x for x in self.pieces if len(x) > 1 and "\n" not in x)
        self.whole_lines = any("\n" in x for x in self.pieces)
        self.cuts_marks = not any(a.isalpha() and b in MARKS for x in self.pieces for a, b in zip(x, x[1:]))
        if re.search(rf"[^\n{SPACE}]{SPACE}", joined):
            raise ValueError("a piece goes on after a space: words aren't units")

    def fall_back(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit of any length, by the same merges with a heap."""
        symbols: list[str | None] = list(unit)
        left, right = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (known := self.pieces.get(pair := symbols[i] + symbols[right[i]])):
                heapq.heappush(heap, (known[0], i, pair))

        for i in range(len(unit)):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if symbols[i] is None or right[i] < 0 or symbols[i] + symbols[right[i]] != pair:
                continue
            j = right[i]
            symbols[i], symbols[j], right[i] = pair, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                ids += [self.pieces[s][1]] if s in self.pieces else [x for c in s for x in self.fall_back(c)]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text: pieces and bytes joined, without the marker put before the text."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def cut(self, part: str) -> tuple[str, str]:
        """A part as stem and marks, between which nothing merges."""
        stem = part.rstrip(MARKS) if self.cuts_marks else part
        return (stem, part[len(stem) :]) if stem and stem[-1].isalpha() else (part, "")


def _runs(text: str, first: bool) -> list[str]:
    """Units of a line whose spaces may be runs."""
    return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", (SPACE if first else "") + text.replace(" ", SPACE))


def _plain(text: str, table: PieceTable) -> bytes | None:
    """A text with the space put before it, if its parts between spaces and line ends are units."""
    if not text or table.whole_lines or "  " in text or text[0] == " " or SPACE in text or "\0" in text:
        return None
    return b" " + text.encode()


def _odd_units(text: str, table: PieceTable) -> list[str]:
    """All units of a text with runs of spaces or markers."""
    if table.whole_lines:
        return _runs(text, True)
    units: list[str] = []
    for i, line in enumerate(text.split("\n")):
        units += (["\n"] if i else []) + _runs(line, not i)
    return units


def _chunks(batches: Iterator[pa.RecordBatch], column: int, with_keys: bool = False) -> Iterator:
    """Texts (null as empty) in lists of about CHUNK_CHARS bytes, with their first column."""
    for batch in batches:
        for a, b in byte_runs(batch.column(column), CHUNK_CHARS):
            texts = [t.as_py() or "" for t in batch.column(column).slice(a, b - a)]
            yield (batch.column(0).slice(a, b - a), texts) if with_keys else texts


def _table(path: str) -> PieceTable:
    return worker_store("pieces", path, lambda: PieceTable(path))


def _count_units(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        parts: Counter = Counter()
        odd: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            units: Counter = Counter(odd)
            for part, n in parts.items():
                stem, marks = table.cut(part.decode())
                units[stem] += n
                if marks:
                    units[marks] += n
            units.pop("", None)
            items = list(units.items())
            for at in range(0, len(items), 50_000):
                some = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["unit", "n"])
            parts.clear()
            odd.clear()

        for texts in _chunks(batches, 0):
            plain = [_plain(t, table) for t in texts]
            data = b"\0".join([x for x in plain if x is not None])
            starts, ends = spans(data, b" \n\0")
            lead = np.r_[np.uint8(0), np.frombuffer(data, np.uint8)[starts[1:] - 1]]
            for value, prefix in ((32, SPACE.encode()), (10, b"")):
                at = np.flatnonzero(lead == value)
                codes, words = distinct(data, starts[at], ends[at])
                for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                    parts[prefix + w] += n
                if value == 10 and len(at):
                    odd["\n"] += len(at)
            for t, x in zip(texts, plain):
                if t and x is None:
                    odd.update(_odd_units(t, table))
            if len(parts) + len(odd) > MEMO_PARTS:
                yield from flush()
        yield from flush()
        release_memory()

    return count


def count_units(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``unit, n`` of the whole corpus."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count_units(model), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, pieces: DataFrame, max_length: int) -> DataFrame:
    """``uid, edges`` of units ``uid, unit``: edges are packed longs, best first.

    An edge holds its cost's rank (bits 40 and up), start (34), length (28) and id.  Rows stay
    in the partition that ``units`` has by ``uid``.
    """
    size = F.length("unit")
    starts = units.select("uid", "unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    substrings = starts.select("uid", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_length), size - F.col("s")))).alias("k"), "unit")
    keyed = substrings.select("uid", "s", "k", F.expr("substring(unit, s + 1, k)").alias("part"))
    found = keyed.join(F.broadcast(pieces), (F.xxhash64("part") == F.col("hash")) & (F.col("part") == F.col("piece")))
    edge = F.expr("(cast(rank as bigint) << 40) | (cast(s as bigint) << 34) | (cast(k as bigint) << 28) | id")
    return found.select("uid", edge.alias("edge")).groupBy("uid").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def paths(units: DataFrame, table: PieceTable) -> DataFrame:
    """``unit, ids`` of units ``uid, unit`` of up to MAX_UNIT characters, without any Python code on executors."""
    spark = units.sparkSession
    ranks = {c: r for r, c in enumerate(sorted({c for c, _ in table.pieces.values()}))}
    pieces = spark.createDataFrame([(p, ranks[c], i) for p, (c, i) in table.pieces.items()], "piece string, rank int, id int").withColumn("hash", F.xxhash64("piece"))
    own = units.filter(F.length("unit").between(1, MAX_UNIT)).select("uid", "unit").repartition("uid")
    rows = own.join(lattice(own, pieces, table.max_length), "uid", "left")
    unpacked = """transform(coalesce(edges, cast(array() as array<bigint>)), e -> transform(array(cast(shiftright(e, 34) & 63 as int)), s -> transform(array(s + cast(shiftright(e, 28) & 63 as int)),
        t -> struct(shiftleft(1L, s) | shiftleft(1L, t) AS ends, shiftleft(1L, t) - shiftleft(1L, s + 1) AS inner, cast(e & 268435455 as int) AS id))[0])[0])"""
    merged = """aggregate(
        sequence(1, length(unit) - 1),
        named_struct('b', shiftleft(1L, length(unit) + 1) - 1L, 'live', filter(edges, e -> e.inner <> 0)),
        (state, i) -> transform(array(get(filter(state.live, e -> bit_count(state.b & e.inner) = 1), 0)),
            best -> if(best IS NULL, state, transform(array(state.b & ~best.inner),
                b -> named_struct('b', b, 'live', filter(state.live, e -> (b & e.ends) = e.ends AND (b & e.inner) <> 0L)))[0]))[0],
        state -> state.b)"""
    state = f"if(length(unit) = 1, 3L, {merged})"
    on_path = "array_sort(filter(edges, e -> (b & e.ends) = e.ends AND (b & e.inner) = 0L))"
    # A symbol without an edge is a character that is no piece: its place is found, and its bytes spelled.
    cuts = "filter(sequence(0, length(unit)), i -> (b & shiftleft(1L, i)) <> 0)"
    spelled = """transform(array(hex(substring(unit, s + 1, t - s))), h -> transform(sequence(1, length(h), 2),
        j -> element_at(byte_ids, cast(conv(substring(h, j, 2), 16, 10) as int) + 1)))[0]"""
    one = f"transform(array(get(filter(path, e -> e.ends = (shiftleft(1L, s) | shiftleft(1L, t))), 0).id), id -> if(id IS NOT NULL, array(id), {spelled}))[0]"
    with_bytes = f"transform(array({cuts}), cuts -> flatten(transform(slice(cuts, 1, size(cuts) - 1), (s, i) -> transform(array(cuts[i + 1]), t -> {one})[0])))[0]"
    ids = f"transform(array({on_path}), path -> if(size(path) = bit_count(b) - 1, transform(path, e -> e.id), {with_bytes}))[0]"
    whole = f"transform(array({unpacked}), edges -> transform(array({state}), b -> {ids})[0])[0]"
    return rows.withColumn("byte_ids", F.lit(table.byte_ids)).select("unit", F.expr(whole).alias("ids"))


def shipped_threshold(units: DataFrame, limit: int = MAX_SHIPPED) -> int:
    """The least power of two such that at most ``limit`` units occur that often."""
    counts = {r["k"]: r["c"] for r in units.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    k = 0
    while sum(c for x, c in counts.items() if x >= k) > limit:
        k += 1
    return 1 << k


class Dictionary:
    """Paths of units by the hash of the unit, from the table in the shared folder."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        keys, size, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
        for batch in pads.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["hash", "ids"]):
            keys.append(batch.column(0).to_numpy())
            size.append(np.diff(batch.column(1).offsets.to_numpy()))
            values.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        hashes, sizes = np.concatenate(keys), np.concatenate(size)
        order = np.argsort(hashes, kind="stable")
        ends = np.cumsum(sizes, dtype=np.int64)
        self.keys, self.end, self.size = hashes[order], ends[order].astype(np.uint32), sizes[order].astype(np.uint8)
        self.values = b"".join(values)
        del keys, size, values, hashes, sizes, order, ends
        release_memory()

    def find(self, units: list[str]) -> list[bytes | None]:
        """Packed ids of each unit; None for one that isn't in the table."""
        if not units or not len(self.keys):
            return [None] * len(units)
        digest = xxhash.xxh64_digest
        hashes = np.frombuffer(b"".join([digest(u.encode(), SEED) for u in units]), ">i8").astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        ends, values = 4 * self.end[at].astype(np.int64), self.values
        return [values[x:y] if ok else None for x, y, ok in zip((ends - 4 * self.size[at].astype(np.int64)).tolist(), ends.tolist(), known.tolist())]


class Encoder:
    """Texts to ids by looking up the paths of their units."""

    def __init__(self, table: PieceTable, dictionary: Dictionary):
        self.table, self.dictionary = table, dictionary
        self.line_end = self._units(["\n"])[0]
        self.of_marks: dict[str, bytes] = {"": b""}

    def _units(self, units: list[str]) -> list[bytes]:
        found = self.dictionary.find(units)
        return [x if x is not None else np.array(self.table.merge(u), "<u4").tobytes() for u, x in zip(units, found)]

    def _table(self, lead: int, words: list[bytes]) -> list[bytes]:
        """Ids of parts after a space, or after a line end with its id; none before the text."""
        cut = [self.table.cut(w.decode()) for w in words]
        prefix = SPACE if lead == 32 else ""
        stems = self._units([prefix + s for s, _ in cut])
        for m in {m for _, m in cut}.difference(self.of_marks):
            self.of_marks[m] = self._units([m])[0]
        first = self.line_end if lead == 10 else b""
        return [first + stem + self.of_marks[m] for stem, (_, m) in zip(stems, cut)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; none for an empty one."""
        if len(self.of_marks) > MEMO_PARTS:
            self.of_marks = {"": b""}
        plain = [_plain(t, self.table) for t in texts]
        found = iter(look_up([x for x in plain if x is not None], b" \n", self._table))
        return [next(found) if x is not None else np.frombuffer(b"".join(self._units(_odd_units(t, self.table))) if t else b"", "<u4") for t, x in zip(texts, plain)]


def _encode_rows(model: str, dictionary: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        encoder = worker_store("units", dictionary, lambda: Encoder(table, Dictionary(dictionary)))
        with no_collection():
            for keys, texts in _chunks(batches, 1, with_keys=True):
                ids = encoder.encode(texts)
                size = pa.array([len(x) for x in ids], pa.int64())
                same = pa.array([table.decode(x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_())
                if whole:
                    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(flat)), size, same], ["doc_id", "ids", "n_ids", "round_trip"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, size, pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), same], ["doc_id", "n_ids", "ids_crc32", "round_trip"])
        release_memory()

    return encode


def _ship(docs: DataFrame, model: str, text_col: str) -> str:
    """Write the paths of the corpus' units to the shared folder; returns the folder."""
    table = PieceTable(model)
    units = materialize(count_units(docs, model, text_col).withColumn("uid", F.monotonically_increasing_id()), "units")
    often = units.filter(F.col("n") >= shipped_threshold(units))
    folder = scratch_path(docs.sparkSession, "paths")
    paths(often, table).select(F.xxhash64("unit").alias("hash"), "ids").write.parquet(folder)
    return folder if ":" in folder else f"file://{folder}"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_ids, round_trip`` of every row's whole text.

    ``ids`` are those of the library.  ``round_trip`` tells whether decoding gives the text
    again; it doesn't for a text that holds the marker character itself.  Null and empty texts
    have no ids.  Rows that repeat give rows that repeat; an empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode_rows(model, _ship(docs, model, text_col), True), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with the crc32 of the packed ids in place of them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode_rows(model, _ship(docs, model, text_col), False), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


def _decode_rows(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            texts = [table.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with ids; null ids give an empty text."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decode_rows(model), "doc_id long, text string")
