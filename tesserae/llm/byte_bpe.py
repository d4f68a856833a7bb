"""Byte-level BPE: ids and offsets from a file of ranks, and bytes again from ids.

The file gives tokens as bytes with their ranks.  The tokenizers library wants characters and
merges: every byte is written as one printable character, and a token's merge is the last step
of merging its own bytes by rank.  No other pair can ever become the token: when two neighbours
that make it up meet, no merge has crossed its ends, so inside them the same steps were taken.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import byte_runs, gather
from ..functions.worker import no_collection, release_memory, worker_store
from .dac import Encoder

#: Texts are encoded together up to this many characters.
RUN_CHARS = 4_000_000
#: Above all ranks.
NO_RANK = 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are left before a token is whole; none if merging its bytes stops earlier."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NO_RANK:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe(Encoder):
    """Encodes as the ranks say, and decodes ids to bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = read_ranks(path)
        self.n_ids = max(ranks.values(), default=-1) + 1
        held: list[bytes] = [b""] * self.n_ids
        for token, rank in ranks.items():
            held[rank] = token
        self.bytes_of = _table(held)
        self.known = np.diff(self.bytes_of[1]) > 0
        self.decimal_of = _table([b"%d," % i for i in range(self.n_ids)])

    @staticmethod
    def load(path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, character = read_ranks(path), byte_characters()
        written = lambda token: "".join(map(character.__getitem__, token))
        merges = [last_merge(token, ranks) for token in sorted(ranks, key=ranks.__getitem__) if len(token) > 1]
        pairs = [(written(a), written(b)) for a, b in filter(None, merges)]
        tokenizer = Tokenizer(models.BPE({written(t): r for t, r in ranks.items()}, pairs, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return tokenizer

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the characters from start to end (0-based, end outside) that its bytes are
        of; tokens that share the bytes of a character all have it."""
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum(data & 0xC0 != 0x80) - 1
        ends = np.cumsum(np.diff(self.bytes_of[1])[ids])
        starts = np.r_[0, ends[:-1]].astype(np.int64)[: len(ids)]
        return character[starts], character[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids in order; an unknown id is an error, and so is a null among them."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.n_ids and self.known[ids].all()):
            raise ValueError("ids that the vocabulary lacks")
        return gather(*self.bytes_of, ids)[0].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(*self.decimal_of, ids)[0].tobytes()[:-1]


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def _bpe(path: str) -> ByteBpe:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return worker_store("byte_bpe", path, lambda: ByteBpe(path))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch in slices of about RUN_CHARS characters."""
    for a, b in byte_runs(batch.column(1), RUN_CHARS):
        yield batch.column(0).slice(a, b - a), [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _ints(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends``: a text's tokens, with the characters that each covers.

    One row per row of ``docs``; ids of any type stay as they are, null too, and may repeat.  A null
    text is empty, and an empty one has no tokens.  A text is encoded whole, however long it is.  An
    empty table gives no row; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks)
        for batch in batches:
            for doc_ids, texts in _runs(batch):
                ids = bpe.encode(texts)
                at = [bpe.offsets(t, x) for t, x in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([doc_ids, _ints(ids), _ints([s for s, _ in at]), _ints([e for _, e in at])], ["doc_id", "ids", "starts", "ends"])

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(rows: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, data, text``: the bytes of a row's ids, and these as text.

    Tokens may end inside a character: bytes are joined before they are read as UTF-8, and what is no
    whole character, as at the ends of a slice of a text, becomes U+FFFD.  Null ids give nulls; an id
    that the vocabulary lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks)
        for batch in batches:
            data = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            texts = [None if x is None else x.decode(errors="replace") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "data", "text"])

    slim = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<long>").alias("ids"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, data binary, text string")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, same``: digests of each text's ids and of the bytes
    that they decode to, and whether these are the text's.

    Rows are treated as in ``encode``; ids stay in the worker that makes and decodes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for doc_ids, texts in _runs(batch):
                with no_collection():
                    ids = bpe.encode(texts)
                    data = [bpe.decode(x) for x in ids]
                    columns = [[len(x) for x in ids], [sha(bpe.decimals(x)) for x in ids], list(map(sha, data)), [t.encode() == x for t, x in zip(texts, data)]]
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])
        release_memory()

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
