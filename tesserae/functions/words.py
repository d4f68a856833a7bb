"""Words of large byte buffers with numpy: a few passes over arrays, no loop over words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Words up to this many bytes are compared byte by byte, longer ones by 128-bit hashes.
EXACT_BYTES = 16


def byte_runs(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Consecutive slices of an array of texts of about ``limit`` bytes each."""
    if not len(texts):
        return []
    of = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:]))


def spans(data: bytes, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all parts between separator bytes, empty ones included."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    at = np.flatnonzero(table[np.frombuffer(data, np.uint8)])
    return np.r_[0, at + 1], np.r_[at, len(data)]


def distinct(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each part the number of its distinct word, and these words by first occurrence."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    length = ends - starts
    padded = data + b"\0" * EXACT_BYTES
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    first = eight[starts] & _KEEP[np.minimum(length, 8)]
    second = eight[starts + 8 * (length > 8)] & _KEEP[np.clip(length - 8, 0, 8)]
    for i in np.flatnonzero(length > EXACT_BYTES).tolist():
        digest = xxhash.xxh128_digest(data[starts[i] : ends[i]])
        first[i], second[i] = np.frombuffer(digest, "<u8")
    mixed = first * _MIX[0]
    mixed ^= mixed >> np.uint64(32)
    mixed += second * _MIX[1]
    mixed ^= mixed >> np.uint64(29)
    mixed += length.astype(np.uint64) * _MIX[2]
    codes = pd.factorize(mixed)[0]
    leader = np.zeros(int(codes.max()) + 1, np.int64)
    leader[codes[::-1]] = np.arange(len(codes))[::-1]
    of = leader[codes]
    if not ((first[of] == first) & (second[of] == second) & (length[of] == length)).all():
        known: dict[bytes, int] = {}
        codes = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        return codes, list(known)
    return codes, [data[a:b] for a, b in zip(starts[leader].tolist(), ends[leader].tolist())]


def gather(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[offsets[c]:offsets[c + 1]]`` for each code, joined, and the lengths."""
    size = np.diff(offsets)[codes]
    ends = np.cumsum(size)
    at = np.repeat(offsets[:-1][codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], size


def look_up(texts: list[bytes], separators: bytes, table: Callable[[int, list[bytes]], list[bytes]]) -> list[np.ndarray]:
    """Each text's parts replaced by unsigned 32-bit integers, looked up once per distinct part.

    ``table(lead, words)`` gives the packed integers of words that follow the separator
    ``lead``, or 0 for a text's first part.  Texts must not hold the byte 0.
    """
    if not texts:
        return []
    data = b"\0".join(texts)
    starts, ends = spans(data, separators + b"\0")
    lead = np.r_[np.uint8(0), np.frombuffer(data, np.uint8)[starts[1:] - 1]]
    codes, packed = np.zeros(len(starts), np.int64), []
    for value in sorted({0, *separators}):
        at = np.flatnonzero(lead == value)
        own, words = distinct(data, starts[at], ends[at])
        codes[at] = own + len(packed)
        packed += table(value, words)
    offsets = np.r_[0, np.cumsum([len(x) // 4 for x in packed])].astype(np.int64)
    values, size = gather(np.frombuffer(b"".join(packed), "<u4"), offsets, codes)
    cuts = np.r_[0, np.cumsum(size)][np.r_[np.flatnonzero(lead == 0), len(starts)]]
    return [values[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
