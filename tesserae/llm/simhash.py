"""SimHash near-deduplication by anchor-point covering.

Fingerprints of 64 bits link at 3 or fewer differing bits, so in one of their two 32-bit
halves they differ in at most one.  In a half, the anchors are the words of the [31,26]
Hamming code, extended by one free bit: every half lies within the covering radius 1 of
exactly one anchor, its home.  A fingerprint is replicated to every anchor within covering
radius plus threshold, 1 + 1, of its half; two fingerprints that link meet at the home of
either, and are compared there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.hot_join import drop_ids, fresh, join_counted
from ..sources.scratch import materialize

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: An anchor with more rows than this is compared in tiles of slices of about this many.
TILE_ROWS = 20_000
#: Up to so many tiled anchors are broadcast, more are joined.
BROADCAST_TILED = 100_000
#: Hot anchors are found among one of this many fingerprints; it only balances the work.
HOT_SAMPLE = 16
#: Runs up to this length are compared by shifting, without a loop over runs.
SHORT_RUN = 32

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_BYTE_BASE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        digests = digest(b" ".join(words), SEED)
    else:
        digests = b"".join([digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))])
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((rows + _BYTE_BASE).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (counts @ _BIT_OF_BYTE) > len(rows)
    return int.from_bytes(np.packbits(bits.ravel().astype(np.uint8)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = pa.array([fingerprint(x.as_py() or b"") for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _parity_masks() -> list[int]:
    """For each of the 5 syndrome bits, the code positions (1 to 31) whose number has it."""
    return [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _flips() -> list[list[int]]:
    """For each syndrome, the changes to a half that lead to all anchors within distance 2.

    The first one leads home.  Bit 31 is the free bit, which is part of the anchor.
    """
    at = lambda p: 1 << (p - 1) if p else 0
    found = []
    for s in range(32):
        pairs = [at(p) ^ at(p ^ s) for p in range(1, 32) if s and p < p ^ s and p != s]
        found.append([at(s), *pairs, at(s) ^ 1 << 31])
    return found


def _replicas(fp: Column) -> Column:
    """All ``(anchor, home)`` of a fingerprint, of both halves; ``anchor`` has the half's number in bit 32."""
    table = F.lit(_flips())

    def anchors(value: Column, half: int) -> Column:
        syndrome = F.lit(0)
        for j, mask in enumerate(_parity_masks()):
            syndrome = syndrome + F.bit_count(value.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << j)
        flips = F.element_at(table, (syndrome + 1).cast("int"))
        return F.transform(flips, lambda flip, i: F.struct((value.bitwiseXOR(flip) + F.lit(half << 32)).alias("anchor"), (i == 0).alias("home")))

    return F.concat(anchors(fp.bitwiseAND(F.lit(0xFFFFFFFF)), 0), anchors(F.shiftrightunsigned(fp, 32), 1))


def _differing(x: np.ndarray) -> np.ndarray:
    """How many bits are set; numpy counts those of the magnitude of signed numbers."""
    return np.bitwise_count(x.view(np.uint64))


def _spanning(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is linked within one run: a search that visits each print once."""
    links, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _differing(rest ^ at) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each anchor; rows are sorted by ``(anchor, tile)``."""

    def linked(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        worth = (sizes > 1) & (np.add.reduceat(home, starts) > 0)
        us, vs = [], []
        for s, n in zip(starts[worth & (sizes > SHORT_RUN)], sizes[worth & (sizes > SHORT_RUN)]):
            if links := _spanning(np.unique(fp[s : s + n])):
                us.append(np.array([x for x, _ in links], np.int64))
                vs.append(np.array([x for _, x in links], np.int64))
        take = np.repeat(worth & (sizes <= SHORT_RUN), sizes)
        k, f, h = key[take], fp[take], home[take]
        for lag in range(1, SHORT_RUN):
            same = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else ()
            if not len(same):
                break
            same = same[(h[same] | h[same + lag]).astype(bool)]
            near = same[_differing(f[same] ^ f[same + lag]) <= MAX_BITS]
            us.append(f[near])
            vs.append(f[near + lag])
        if us:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
        return None

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = (batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int8))
        if held and held[-1][0][-1] == cols[0][0] == cols[0][-1]:
            held.append(cols)
            continue
        key, fp, home = (np.concatenate(x) for x in zip(*held, cols))
        cut = int(np.searchsorted(key, key[-1]))
        held = [(key[cut:], fp[cut:], home[cut:])]
        if cut and (out := linked(key[:cut], fp[:cut], home[:cut])):
            yield out
    if held and (out := linked(*(np.concatenate(x) for x in zip(*held)))):
        yield out


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp`` that connect all that link.

    Links within one anchor are thinned to a spanning set when it has many rows, so that a
    large group doesn't give all its pairs; no connection is lost.
    """
    rows = prints.select("fp", F.inline(_replicas(F.col("fp"))))
    sample = rows.filter(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0)
    hot = sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE_ROWS // HOT_SAMPLE)
    hot = materialize(hot.select("anchor", F.ceil(F.col("n") * HOT_SAMPLE / TILE_ROWS).cast("int").alias("slices")), "tiled", BROADCAST_TILED)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_TILED else hot
    own = F.pmod(F.xxhash64("fp", F.lit("slice")), F.col("slices")).cast("int")
    tiles = F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.least(own, j) * F.col("slices") + F.greatest(own, j)))
    dealt = rows.join(hot, "anchor", "left").select("fp", "home", "anchor", F.explode(tiles).alias("tile"))
    key = F.when(F.col("tile") == 0, F.col("anchor")).otherwise(F.xxhash64("anchor", "tile").bitwiseOR(F.lit(1 << 40)))
    keyed = dealt.select(key.alias("key"), "fp", "home")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "u long, v long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` of every row, and these with their component: its smallest id, and the
    least fingerprint of a row with that id."""
    table = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    total = table.count()
    grouped = table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(grouped, "distinct", total)
    roots = materialize(connected_components(links(distinct)), "roots", total)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first"))
    found = rooted.join(named, "root").select("fp", "n", F.col("first.least").alias("component_id"), F.col("first.fp").alias("keep_fp"))
    classes = materialize(found, "classes", total)
    return table, join_counted(table, classes, "fp", "n", total)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id that links of 3 or
    fewer bits reach.  Null and empty texts, and texts without a word, have fingerprint zero
    and link like any other; a very long text is hashed whole.  Rows that repeat give rows that
    repeat; a null id never names a component unless it has no other; an empty table gives an
    empty result; other columns are not read.  Ids are integers.
    """
    joined = _classes(docs, id_col, text_col)[1]
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(column: int, name: str):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).cast(pa.binary())
            yield batch.append_column(name, pa.array([fingerprint(x.as_py() or b"") for x in texts], pa.int64()))

    return told


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the row of the smallest id.

    A row is told by its id, and where an id repeats or is null by its id and fingerprint: of
    rows with the same of both one stays if any does.  A null id is larger than all others.  Ids are
    integers.  Null and empty texts are one class, and a text of any length is hashed whole; an empty
    table stays empty, and other columns may have any name and type.
    """
    joined = _classes(docs, id_col, text_col)[1]
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp"))
    decided = materialize(joined.select("doc_id", "fp", keep.alias("keep")), "decided", docs.count())
    per_id = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("int")).alias("k"))
    dropped = materialize(per_id.filter("doc_id IS NULL OR k = 0 OR n > 1"), "dropped", decided.count())
    mark, print_ = fresh(docs, "_again"), fresh(docs, "_fp")
    again = dropped.filter("doc_id IS NULL OR k > 0").select(F.col("doc_id").alias(mark))
    plain = drop_ids(docs.filter(F.col(f"`{id_col}`").isNotNull()), id_col, dropped.select(F.col("doc_id").alias(id_col)))
    if again.isEmpty():
        return plain
    own = F.col(f"`{id_col}`").cast("long")
    rows = docs.join(again, own.eqNullSafe(F.col(mark)), "left_semi")
    schema = T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())])
    told = rows.mapInArrow(_with_fingerprint(docs.columns.index(text_col), print_), schema)
    packed = told.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("_id"), F.col(print_).alias("_fp"))
    kept = decided.filter("keep").select(F.col("doc_id").alias("_kept"), F.col("fp").alias("_of")).distinct()
    stay = packed.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_fp") == F.col("_of")), "left_semi")
    one = stay.groupBy("_id", "_fp").agg(F.first("row").alias("row"))
    return plain.unionByName(one.select("row.*"))
