"""Directly addressable codes: token ids in files that give any token without block decoding.

An id is split into 8-bit chunks, lowest first.  Level 0 holds the first chunk of every
token, level k the chunk k of those that have one, in order.  A continuation bitmap per level
tells which tokens go on, and a rank directory counts the set bits before every 512th, so
that a token's place in the next level is one directory entry and the bits of one block.

A file has, little-endian: ``DAC1``; n_levels (u32); n_docs, n_tokens (u64); doc ids (i64);
null flags of doc ids (u8); starts of the documents and the end (u64); then per level the
number of chunks (u64), the chunks (u8), the bitmap (lowest bit first) and the directory (u64).
"""

from __future__ import annotations

import array
import json
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import look_up
from ..functions.worker import no_collection, worker_store
from ..sources.scratch import materialize, scratch_path
from ..sources.shared import file_system

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BLOCK = 512
END_ID = 2
#: Files are read back by at most so many tasks.
MAX_READERS = 10_000
#: A file is closed at the document that brings it to this many tokens (4 bytes each in memory).
SEGMENT_TOKENS = 4_000_000
#: Texts are encoded together up to this many characters.
ENCODE_CHARS = 8_000_000
#: A memo of encoded parts is set aside at this many entries, and what is used again is kept.
MEMO_ENTRIES = 600_000

#: Characters whose class is the same in every version of Unicode; other texts aren't memoized.
STABLE_ASCII, UNSTABLE = b"\n" + bytes(range(0x20, 0x7F)), r"[^À-ɏ–—‘’“”…€]"
#: Texts with such white space aren't cut.
UNCUT = ("  ", " \n", "\n ", "\n\n")
#: So many parts are encoded as one text, and so many of these texts in one call: what the library
#: gives for a token is larger than its id.
JOINED, TOGETHER = 500, 40


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level the chunks, the packed continuation bitmap and the rank directory."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest >> CHUNK_BITS > 0
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        directory = np.r_[np.uint64(0), np.cumsum(blocks, dtype=np.uint64)]
        levels.append(((rest & 255).astype(np.uint8), np.packbits(more, bitorder="little"), directory))
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            return levels


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file with the documents in the given order."""
    levels = encode_levels(ids)
    parts = [MAGIC, struct.pack("<IQQ", len(levels), len(doc_ids), len(ids))]
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes()]
    parts.append(np.r_[0, np.cumsum(np.array(lengths, np.int64))].astype("<u8").tobytes())
    for chunks, bitmap, directory in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), directory.astype("<u8").tobytes()]
    return b"".join(parts)


class DacFile:
    """Random access to the tokens of one file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC file")
        n_levels, n_docs, self.n_tokens = struct.unpack_from("<IQQ", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls)]
        self.starts = take("<u8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // RANK_BLOCK) + 1)))

    def rank(self, level: int, i: int) -> int:
        """How many of the first ``i`` bits of a level's bitmap are set."""
        _, bitmap, directory = self.levels[level]
        block = i // RANK_BLOCK
        inside = np.unpackbits(bitmap[block * RANK_BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * RANK_BLOCK]
        return int(directory[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        """The ``i``-th token: one chunk and one bit per level."""
        value, level = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[i]) << CHUNK_BITS * level
            if not bitmap[i // 8] >> i % 8 & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end``; each level is read as one range."""
        out = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            lead = start % 8
            more = np.unpackbits(bitmap[start // 8 : -(-end // 8)], bitorder="little")[lead : lead + end - start].astype(bool)
            where = where[more]
            if not len(where):
                break
            start = self.rank(level, start)
            end = start + len(where)
        return out


def _packed(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Texts to ids with the tokenizers library, each distinct part once.

    Byte-level BPE merges within pre-tokens only, so a text's ids are those of its
    pre-tokens.  Where spaces and line ends are single and don't meet, a pre-token holds a
    space at its start only, and a line end is a pre-token: such texts are cut there, and the
    distinct parts are looked up in a memo.  New parts are encoded joined: after a space, or
    with line ends between, nothing merges with what stands before.  Texts with other characters than the stable ones
    or with a special token's string, and all texts under another kind of tokenizer, are
    encoded whole.
    """

    def __init__(self, path: str):
        import regex

        self.tokenizer = self.load(path)
        told = json.loads(self.tokenizer.to_str())
        kind = told.get("pre_tokenizer") or {}
        self.memoized = told.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.unstable = regex.compile(UNSTABLE).search
        self.memo: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}
        self.line_end = self._whole(["\n"])[0]
        known = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = np.array([t.startswith("Ġ") for t in known])
        self.line_ends = np.array([t == "Ċ" for t in known])

    @staticmethod
    def load(path: str):
        """The library's tokenizer of a file."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[bytes], between: str, leads: np.ndarray) -> list[bytes]:
        """Ids of parts encoded as one text, in which the ids in ``leads`` begin a new part."""
        found = []
        for at in range(0, len(parts), JOINED * TOGETHER):
            some = parts[at : at + JOINED * TOGETHER]
            joined = [between.join([p.decode() for p in some[i : i + JOINED]]) for i in range(0, len(some), JOINED)]
            for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                packed = _packed(e.ids)
                cuts = (4 * np.flatnonzero(leads[np.frombuffer(packed, np.uint32)])).tolist()
                if between:
                    found += [packed[a:b] for a, b in zip([0, *[x + 4 for x in cuts]], [*cuts, len(packed)])]
                else:
                    found += [packed[a:b] for a, b in zip(cuts, [*cuts[1:], len(packed)])]
        return found

    def _table(self, lead: int, words: list[bytes]) -> list[bytes]:
        """Ids of parts after a space, after a line end (with its id) or at a text's start."""
        parts = [b" " + w for w in words] if lead == 32 else words
        memo, past = self.memo, self.past
        new = [p for p in parts if p not in memo]
        again = [p for p in new if p in past]
        memo.update([(p, past[p]) for p in again])
        new = [p for p in new if p not in memo]
        memo.update(zip(new, self._joined(new, "", self.spaced) if lead == 32 else self._joined(new, "\n", self.line_ends), strict=True))
        found = list(map(memo.__getitem__, parts))
        return [self.line_end + x for x in found] if lead == 10 else found

    def _cut(self, text: str) -> bytes | None:
        """The text in UTF-8 if it may be cut at spaces and line ends."""
        if not self.memoized or not text or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in UNCUT) or any(s in text for s in self.special):
            return None
        data = text.encode()
        rest = data.translate(None, STABLE_ASCII)
        return None if rest and self.unstable(rest.decode()) else data

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.past = {}, self.memo
        cut = [self._cut(t) for t in texts]
        ids = iter(look_up([x for x in cut if x is not None], b" \n", self._table))
        rest = iter(self._whole([t for t, x in zip(texts, cut) if x is None]))
        return [next(ids) if x is not None else np.frombuffer(next(rest), "<u4") for x in cut]


def _some(rows: Iterable[tuple], chars: int) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def _writer(tokenizer: str, folder: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = worker_store("dac", tokenizer, lambda: Encoder(tokenizer))
        task = TaskContext.get()
        fs, root = file_system(folder)
        end, made = np.array([end_id], np.uint32), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            name = f"part-{task.partitionId():06d}-{made:05d}-{task.taskAttemptId()}.dac"
            ids = np.concatenate([x for own in held for x in (own, end)])
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(doc_ids, [len(x) + 1 for x in held], ids))
            made += 1
            row = [task.partitionId(), made - 1, f"{folder}/{name}", len(doc_ids), len(ids)]
            doc_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "segment", "path", "n_docs", "n_tokens"])

        rows = ((i.as_py(), t.as_py() or "") for b in batches for i, t in zip(b.column(0), b.column(1)))
        n = 0
        with no_collection():
            for some in _some(rows, ENCODE_CHARS):
                for (doc_id, _), ids in zip(some, encoder.encode([t for _, t in some])):
                    doc_ids.append(doc_id)
                    held.append(ids)
                    n += len(ids) + 1
                    if n >= SEGMENT_TOKENS:
                        yield flush()
                        n = 0
            if doc_ids:
                yield flush()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode every text and write the ids to ``folder`` in ascending id order.

    Returns the manifest ``part, segment, path, n_docs, n_tokens, base``; ``base`` is the
    number of tokens in all files before.  A file's name holds the attempt that wrote it,
    and the manifest names the files of the attempts that succeeded.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_writer(tokenizer, folder, end_id), "part long, segment long, path string, n_docs long, n_tokens long")
    manifest = materialize(written, "manifest")
    own = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = manifest.withColumn("_own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(parts, F.col("part") == F.col("_part"))
    return placed.withColumn("base", F.col("_before") + F.col("_own")).drop("_part", "_before", "_own")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, at = file_system(path)
            with fs.open_input_file(at) as f:
                dac = DacFile(f.read())
            starts = dac.starts.astype(np.int64)
            crcs = [zlib.crc32(dac.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(dac.doc_ids, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    files = manifest.select("path", "base").repartition(min(max(manifest.count(), 1), MAX_READERS))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder, and read every document back.

    A null text is an empty one, which has the end id only.  Null ids come first; rows that
    repeat an id stay next to each other, ordered by text.  An empty table writes no file and
    gives no row; other columns are not read.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    jvm = docs.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)
    return read_documents(write_tokens(docs, tokenizer, folder, id_col, text_col))
