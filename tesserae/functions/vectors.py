"""Vector expressions, and exact neighbours in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Vectors of a block: a cell of the grid multiplies two blocks.
BLOCK_ROWS = 4096
#: A larger table has so many blocks a side, of up to so many numbers each (32 MB).
SIDE_BLOCKS, BLOCK_VALUES = 12, 1 << 22
#: Queries and references that are multiplied at once.
TILE = (512, 4096)
#: The same for two blocks that both ask, and rows of the other side that bound a row's best first.
BOTH_TILE, BOUND_ROWS = (1024, 1024), 512
#: A table with fewer different vectors than this share of its rows is compared by different vectors.
DIFFERENT = 0.8
#: Vectors of up to so many numbers are searched by leaves of so many rows, so many leaves at once, in so many cells at least.
LOW, LEAF, LEAVES, LOW_CELLS = 16, 128, 16, 12
#: Rows that ask and references that are multiplied at once where only levels are asked for, and blocks of rows that ask.
LEVEL_TILE, ASKING_BLOCKS = (1024, 2048), 24


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is zero, an error if the dimensions differ."""
    both = norm(a) * norm(b)
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double"))
    return F.coalesce(same, F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both))


def cosine_or_nan(a: Column, b: Column) -> Column:
    """Cosine; not a number if either vector is zero, null if the dimensions differ."""
    both = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).otherwise(F.when(both == 0, F.lit(float("nan"))).otherwise(dot(a, b) / both))


def valid(v: Column, size: int | None = None) -> Column:
    """Not null, not empty, not all zero, without NaN, and of the given size."""
    sized = F.size(v) == size if size else F.size(v) > 0
    return F.coalesce(v.isNotNull() & sized & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: F.isnan(x) | x.isNull()), F.lit(False))


def mean_vector(v: str, size: int) -> Column:
    """Aggregate: the mean of vectors of ``size`` numbers."""
    return F.array(*[F.avg(F.col(v)[i].cast("double")) for i in range(size)])


def neighbours(queries: DataFrame, refs: DataFrame, k: int, same_group: bool = True, block_rows: int | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` most similar references of each query: ``q_id, r_id, similarity, rank``.

    Both inputs are ``id, grp, vec``.  Similarities are cosines rounded to 6 places; ties go
    to the smaller id.  A query never meets itself; with ``same_group`` false, nor its group.
    Both sides are dealt into blocks, every cell of the grid compares two blocks and passes
    on k rows per query, so that no task sees more than two blocks.  Blocks grow with the table
    up to BLOCK_VALUES numbers, as a row goes to as many cells as the other side has blocks.
    A table that is compared with itself has cells for unordered pairs of blocks only.
    Similarities below ``least`` aren't asked for.  Where it is given, and ``k`` is 1, short vectors
    don't meet all references of a cell, see ``_nearest``.
    """

    if queries is refs and same_group:
        return _neighbours_within(queries, k, block_rows)

    (q_n, q_size), (r_n, r_size) = (rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first() for rows in (queries, refs))
    low = k == 1 and same_group and least is not None and max(q_size or 1, r_size or 1) <= LOW
    q_blocks, r_blocks = _blocks(q_n, q_size, block_rows), _blocks(r_n, r_size, block_rows)
    if low and not block_rows:
        # The more references a block has, the fewer of them a query meets.
        most = BLOCK_VALUES // max(q_size or 1, r_size or 1, 1)
        r_blocks = -(-r_n // most) or 1
        q_blocks = max(-(-q_n // most), min(-(-LOW_CELLS // r_blocks), -(-q_n // BLOCK_ROWS)), 1)

    def side(rows: DataFrame, is_query: bool) -> DataFrame:
        own, other = (q_blocks, r_blocks) if is_query else (r_blocks, q_blocks)
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        whole = rows.filter(valid(F.col("vec"))).select(F.col("id").cast("long").alias("id"), "grp", "vec")
        dealt = whole.select("id", "grp", "vec", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        qb, rb = ("mine", "other") if is_query else ("other", "mine")
        # New column ids, as both sides may come from one table.
        return dealt.select(F.col("id").alias("id"), F.col("grp").alias("grp"), F.col("vec").alias("vec"), F.col(qb).alias("qb"), F.col(rb).alias("rb"))

    def cell(q: pa.Table, r: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(q) and len(r):
            r = r.sort_by("id")
            q_id, r_id = (t.column("id").combine_chunks().to_numpy() for t in (q, r))
            apart = None
            if not same_group:
                codes = pa.chunked_array([*q.column("grp").chunks, *r.column("grp").chunks]).combine_chunks().dictionary_encode().indices
                # A null group is no other row's.
                codes = codes.fill_null(-1).to_numpy()
                apart = np.where(codes[: len(q)] < 0, -2, codes[: len(q)]), codes[len(q) :]
            units = unit_rows(q.column("vec")), unit_rows(r.column("vec"))
            i, at, similarity = _nearest(*units, q_id, r_id, least) if low else _top(*units, k, q_id, r_id, apart)
            enough = similarity >= (-np.inf if least is None else least)
            found = [q_id[i[enough]], r_id[at[enough]], similarity[enough]]
        return pa.table([pa.array(x) for x in found], ["q_id", "r_id", "similarity"])

    sides = side(queries, True), side(refs, False)
    if low:
        # Twice as many partitions as cells: few tasks get two, whatever the session's number is.
        sides = tuple(rows.repartition(2 * q_blocks * r_blocks, "qb", "rb") for rows in sides)
    pairs = sides[0].groupBy("qb", "rb").cogroup(sides[1].groupBy("qb", "rb")).applyInArrow(cell, "q_id long, r_id long, similarity double")
    return _ranked(pairs, k)


def _blocks(n: int, size: int | None, block_rows: int | None) -> int:
    most = max(BLOCK_VALUES // max(size or 1, 1), 1)
    return -(-n // (block_rows or min(max(-(-n // SIDE_BLOCKS), BLOCK_ROWS), most))) if n else 1


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "r_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _neighbours_within(rows: DataFrame, k: int, block_rows: int | None) -> DataFrame:
    """``neighbours`` of a table in itself.

    Where many vectors have copies, only different ones are compared, each under its smallest id.  A row's best
    are among the first copies of its own vector and of the k vectors nearest to that one.
    """
    whole = rows.filter(valid(F.col("vec"))).select(F.col("id").cast("long").alias("id"), "vec")
    n, size, different = whole.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.approx_count_distinct(F.xxhash64("vec"))).first()
    if different >= DIFFERENT * n or whole.select("id").distinct().count() < n:
        return _ranked(_pairs_within(whole, k, _blocks(n, size, block_rows)), k)
    classes = _classes(whole)
    near = _ranked(_pairs_within(classes.select("id", "vec"), k, _blocks(classes.count(), size, block_rows)), k)
    copied = classes.filter("n > 1").select("vec", F.col("id").alias("first"))
    of = materialize(whole.join(copied, "vec", "left").select("id", F.coalesce("first", "id").alias("first")), "copies")
    place = F.row_number().over(Window.partitionBy("first").orderBy("id"))
    some = of.withColumn("place", place).filter(F.col("place") <= k + 1).select(F.col("first").alias("of"), F.col("id").alias("r_id"))
    others = near.select("q_id", F.col("r_id").alias("of"), "similarity").join(some, "of").select("q_id", "r_id", "similarity")
    # A row is among its own copies too, and is left out below.
    best = _ranked(others.union(some.select(F.col("of").alias("q_id"), "r_id", F.lit(1.0).alias("similarity"))), k + 1)
    found = of.join(best.select(F.col("q_id").alias("first"), "r_id", "similarity"), "first").filter(F.col("id") != F.col("r_id"))
    return _ranked(found.select(F.col("id").alias("q_id"), "r_id", "similarity"), k)


def _classes(whole: DataFrame) -> DataFrame:
    """Different vectors, under their smallest id, and how many rows ``n`` have each."""
    # Cosines of lengths near what a number can hold are left to the comparison.
    apart = F.when(~norm(F.col("vec")).between(1e-100, 1e100), F.col("id"))
    classes = whole.groupBy("vec", apart.alias("apart")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return materialize(classes, "classes")


def _pairs_within(rows: DataFrame, k: int, blocks: int) -> DataFrame:
    """``q_id, r_id, similarity``: of each two blocks, every row's ``k`` best of the other block, from one comparison for both."""
    mine, other = F.col("mine"), F.col("other")
    whole = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("mine"))
    dealt = whole.select("id", "vec", "mine", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("id", "vec", (mine <= other).alias("low"), F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"))

    def cell(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sides = []
        units = unit_rows(rows.column("vec"))
        ids, low, known = rows.column("id").to_numpy(), rows.column("low").to_numpy(), np.isfinite(units).all(axis=1)
        for of in (low, ~low):
            at = np.flatnonzero(of & known)
            at = at[np.argsort(ids[at], kind="stable")]
            sides.append((ids[at], units[at]))
        (l_id, left), (r_id, right) = sides
        del units, sides
        # On the diagonal one block meets itself; elsewhere either may have no rows.
        if key[0] == key[1]:
            r_id, right = l_id, None
        parts = [(l_id[i], r_id[at], s) if of_left else (r_id[i], l_id[at], s) for of_left, (i, at, s) in zip((True, False), _top_both(left, right, k, l_id, r_id))]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], ["q_id", "r_id", "similarity"])

    # Twice as many partitions as cells: few tasks get two, whatever the session's number is.
    return dealt.repartition(blocks * (blocks + 1), "a", "b").groupBy("a", "b").applyInArrow(cell, "q_id long, r_id long, similarity double")


def below(rows: DataFrame, levels: list[float], block_rows: int | None = None) -> DataFrame:
    """``id, level``: rows ``id, vec`` of unique ids whose best cosine with another valid row doesn't reach the
    first of falling ``levels``, and the number of the first one that it reaches, or how many levels there are.

    Cosines are rounded to 6 places.  Valid rows that aren't returned reach the first level; which row they reach it
    with isn't sought, so that a row meets others only until it does.  In a round those that haven't reached it meet
    further blocks of rows; the last of them meet all.  A row with a copy reaches it by that; a small table has its
    best matches found.
    """
    whole = rows.filter(valid(F.col("vec"))).select(F.col("id").cast("long").alias("id"), "vec")
    n, size, different = whole.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.approx_count_distinct(F.xxhash64("vec"))).first()
    block_rows = block_rows or max(BLOCK_VALUES // max(size or 1, 1), 1)
    if n <= min(block_rows, BLOCK_ROWS):
        best = _neighbours_within(rows.select("id", "vec"), 1, None).select(F.col("q_id").alias("id"), "similarity")
        level = F.lit(len(levels))
        for i in reversed(range(len(levels))):
            level = F.when(F.col("similarity") >= levels[i], i).otherwise(level)
        return whole.select("id").join(best, "id", "left").select("id", level.alias("level")).filter("level > 0")
    refs, asking = rows.select(F.col("id").cast("long").alias("id"), "vec"), whole
    if different < DIFFERENT * n and levels[0] <= 1:
        refs = _classes(whole)
        asking = refs.filter("n = 1")
        n = refs.count()
    asking = asking.select("id", "vec", F.lit(len(levels)).alias("level"))
    first = left = asking.count()
    blocks, met = -(-n // block_rows), 0
    while left and met < blocks:
        # As many blocks as have been met, or what takes a fourth of the first round's comparisons.
        more = min(max(1, met, first // (4 * left)), blocks - met)
        asking = materialize(_still_below(asking, left, refs, (met, more, blocks), levels, block_rows), "below")
        left, met = asking.count(), met + more
    return asking.select("id", "level")


def _still_below(asking: DataFrame, n: int, refs: DataFrame, of: tuple[int, int, int], levels: list[float], block_rows: int) -> DataFrame:
    """Of ``n`` rows ``id, vec, level`` those that still don't reach the first level after they met ``more`` blocks of ``refs``."""
    met, more, blocks = of
    own = max(-(-n // block_rows), min(-(-n // BLOCK_ROWS), -(-ASKING_BLOCKS // more)))
    block, there = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda a, m: F.explode(F.sequence(F.lit(a), F.lit(a + m - 1)))
    asks = asking.select("id", "vec", "level", block.alias("a"), every(met, more).alias("b"))
    # References have no level.  Blocks come first, as it takes more to tell whether a vector is valid.
    known = refs.filter(there.between(met, met + more - 1)).filter(valid(F.col("vec"))).select("id", "vec", F.lit(None).cast("int").alias("level"), every(0, own).alias("a"), there.alias("b"))

    def cell(rows: pa.Table) -> pa.Table:
        units, ids = unit_rows(rows.column("vec")), rows.column("id").to_numpy()
        level = rows.column("level").combine_chunks()
        asks, finite = level.is_valid().to_numpy(zero_copy_only=False), np.isfinite(units).all(axis=1)
        level = level.fill_null(0).to_numpy().copy()
        left, right = np.flatnonzero(asks & finite), np.flatnonzero(~asks & finite)
        level[left] = _level(units[left], units[right], ids[left], ids[right], levels, level[left])
        at = np.flatnonzero(asks & (level > 0))
        return pa.table([rows.column("id").take(at), rows.column("vec").take(at), pa.array(level[at])], ["id", "vec", "level"])

    # Twice as many partitions as cells, as above.
    both = asks.unionByName(known).repartition(2 * own * more, "a", "b")
    kind = asking.schema["vec"].dataType.simpleString()
    found = both.groupBy("a", "b").applyInArrow(cell, f"id long, vec {kind}, level int")
    if more > 1:
        found = found.groupBy("id").agg(F.first("vec").alias("vec"), F.min("level").alias("level"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == more)
    return found.select("id", "vec", "level")


def _level(left: np.ndarray, right: np.ndarray, l_id: np.ndarray, r_id: np.ndarray, levels: list[float], level: np.ndarray) -> np.ndarray:
    """The numbers of the first ``levels`` that rows of ``left`` reach with rows of ``right`` of other ids, or reached before.

    The highest cosine of a row in a tile is found in single precision; only where that is too near to a level are
    the row's cosines computed in double.
    """
    level, values = level.copy(), np.array(levels)
    slack = (left.shape[1] + 8) * 2.0**-24 + 1e-6
    left_32, right_32 = left.astype(np.float32), right.astype(np.float32)
    order = np.argsort(r_id)
    at = np.minimum(np.searchsorted(r_id[order], l_id), max(len(right) - 1, 0))
    itself = np.where(r_id[order][at] == l_id, order[at], -1) if len(right) else np.full(len(left), -1)
    room = np.empty(LEVEL_TILE[0] * LEVEL_TILE[1], np.float32)

    def reached(best: np.ndarray, more: float) -> np.ndarray:
        return (best[:, None] < values + more).sum(axis=1).astype(level.dtype)

    for b in range(0, len(right), LEVEL_TILE[1]):
        there = slice(b, b + LEVEL_TILE[1])
        width = len(right[there])
        left_over = np.flatnonzero(level > 0)
        for a in range(0, len(left_over), LEVEL_TILE[0]):
            own = left_over[a : a + LEVEL_TILE[0]]
            s = np.matmul(left_32[own], right_32[there].T, out=room[: len(own) * width].reshape(len(own), width))
            to = itself[own] - b
            met = np.flatnonzero((to >= 0) & (to < width))
            s[met, to[met]] = -np.inf
            best = s.max(axis=1)
            at = np.flatnonzero(best >= values[level[own] - 1] - slack)
            rows, best = own[at], best[at].astype(np.float64)
            level[rows] = np.minimum(level[rows], reached(best, slack))
            rows = rows[reached(best, -slack) < level[rows]]
            if len(rows):
                s = np.rint(left[rows] @ right[there].T * 1e6) / 1e6
                s[r_id[None, there] == l_id[rows, None]] = -np.inf
                level[rows] = np.minimum(level[rows], reached(s.max(axis=1), 0.0))
    return level


def unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of lists, which must have one size."""
    lists = vectors.combine_chunks()
    if len(np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))) > 1:
        raise ValueError("vectors of different dimensions")
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _top(left: np.ndarray, right: np.ndarray, k: int, l_id: np.ndarray, r_id: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``left``, their ``k`` best rows of ``right`` (sorted by id) and the rounded cosines.

    A tile of the matrix is computed in single precision first.  Its error has a bound, so that only
    places within it of a row's k best so far are computed in double precision; a tile with many such
    places is computed whole, as is the first, which is narrow; the next ones double in width.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = left.shape[1]
    # Each of size + 2 operations on numbers of up to 1 errs by 2^-24 of it at most, rounding to 6 places by half a millionth.
    slack = (size + 8) * 2.0**-24 + 1e-6
    left_32, right_32 = left.astype(np.float32), right.astype(np.float32)
    for a in range(0, len(left), TILE[0]):
        own = slice(a, a + TILE[0])
        rows = len(left[own])
        # Cosines are held in millionths, whole numbers.
        best, place = np.full((rows, k), -np.inf), np.full((rows, k), -1)
        end = 0
        while end < len(right):
            b, end = end, min(end + min(max(128 * k, end), TILE[1]), len(right))
            there, width, least = slice(b, end), end - b, best[:, -1]
            if np.isinf(least).any():
                i = None
            else:
                i = np.flatnonzero(left_32[own] @ right_32[there].T >= (least * 1e-6 - slack).astype(np.float32)[:, None])
                if not len(i):
                    continue
            if i is None or len(i) > min(rows * width // 64, BLOCK_VALUES // 2 // size):
                i, j, s = _whole_tile(left[own], right[there], k, l_id[own], r_id[there], apart and (apart[0][own], apart[1][there]))
            else:
                i, j = np.divmod(i, width)
                met = l_id[a + i] != r_id[b + j]
                if apart:
                    met &= apart[0][a + i] != apart[1][b + j]
                i, j = i[met], j[met]
                s = np.rint(np.einsum("ij,ij->i", left[a + i], right[b + j]) * 1e6)
            near = s >= least[i]
            i, j, s = i[near], j[near], s[near]
            if len(i):
                _keep_best(best, place, i, b + j, s)
        i, j = np.nonzero(best > -np.inf)
        out.append((a + i, place[i, j], best[i, j] / 1e6))
    return tuple(np.concatenate(x) for x in zip(*out))


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Places of points in leaves of LEAF at most, each half of one more by the number in which that spreads most."""
    todo, found = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            found.append(at)
            continue
        own = points[at]
        half = len(at) // 2
        order = np.argpartition(own[:, own.var(axis=0).argmax()], half)
        todo += [at[order[half:]], at[order[:half]]]
    return found


def _distinct(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal rows, in order, and for each row the number of its first."""
    mixed = np.zeros(len(units), np.uint64)
    for column in np.ascontiguousarray(units.T + 0.0).view(np.uint64):
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, of = np.unique(mixed, return_index=True, return_inverse=True)
    if not (units[first[of]] == units).all():
        return np.arange(len(units)), np.arange(len(units))
    order = np.argsort(first)
    number = np.empty(len(first), np.int64)
    number[order] = np.arange(len(first))
    return first[order], number[of]


def _nearest(left: np.ndarray, right: np.ndarray, l_id: np.ndarray, r_id: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_top`` for one best row, where that reaches ``least``, of vectors of few numbers.

    Both sides lie in leaves of near rows, in boxes along the axes on which the references spread.  Rows of a leaf
    meet leaves of the other side in order of the boxes' distance, as long as a row can have a cosine there that isn't
    below its best so far: it is no nearer to a row than to that one's box.  Equal rows are one, under the smallest id.
    """
    l_at, r_at = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (left, right))
    place = np.minimum(np.searchsorted(r_id, l_id), len(r_id) - 1)
    itself = np.where(r_id[place] == l_id, place, -1)
    of = np.arange(len(l_at))
    if (itself < 0).all():
        (l_first, of), (r_first, _) = _distinct(left[l_at]), _distinct(right[r_at])
        l_kept, r_kept = l_at[l_first], r_at[r_first]
    else:
        l_kept, r_kept = l_at, r_at
    if not len(l_kept) or not len(r_kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    turn = np.linalg.eigh(np.cov(right[r_kept].T, bias=True).reshape(right.shape[1], -1))[1]
    l_turned, r_turned = left[l_kept] @ turn, right[r_kept] @ turn
    l_leaves, r_leaves = _leaves(l_turned), _leaves(r_turned)
    low, high = (np.array([of_all(r_turned[leaf], axis=0) for leaf in r_leaves]) for of_all in (np.min, np.max))
    starts, sizes = np.cumsum([0, *map(len, r_leaves)]), np.array([*map(len, r_leaves)])
    order = r_kept[np.concatenate(r_leaves)]
    rows = right[order]
    # Cosines are held in millionths, whole numbers.
    best, found = np.full(len(l_kept), np.ceil(least * 1e6 - 1e-6)), np.full(len(l_kept), -1)
    for leaf in l_leaves:
        turned, own, ids = l_turned[leaf], left[l_kept[leaf]], itself[l_kept[leaf]]
        most, place, far = best[leaf], found[leaf], _farthest(best[leaf])
        gap = np.sqrt((np.maximum(np.maximum(low - turned.max(axis=0), turned.min(axis=0) - high), 0) ** 2).sum(axis=1))
        able = np.flatnonzero(gap <= far.max())
        able = able[np.argsort(gap[able])]
        met, step = 0, 1
        while met < len(able) and gap[able[met]] <= far.max():
            some = able[met : met + step]
            met, step = met + step, min(2 * step, LEAVES)
            apart = np.maximum(np.maximum(low[some] - turned[:, None], turned[:, None] - high[some]), 0)
            asks = np.einsum("ijk,ijk->ij", apart, apart) <= (far**2)[:, None]
            asking, some = np.flatnonzero(asks.any(axis=1)), some[asks.any(axis=0)]
            if not len(asking):
                continue
            at = np.repeat(starts[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())
            s = own[asking] @ rows[at].T
            if (ids[asking] >= 0).any():
                s[ids[asking, None] == order[at]] = -np.inf
            near = np.flatnonzero(np.rint(s.max(axis=1) * 1e6) >= most[asking])
            asking, s = asking[near], np.rint(s[near] * 1e6)
            if len(asking):
                top = s.max(axis=1)
                first = np.where(s == top[:, None], order[at], len(right)).min(axis=1)
                same = (top == most[asking]) & (place[asking] >= 0)
                place[asking] = np.where(same, np.minimum(first, place[asking]), first)
                most[asking] = top
                far[asking] = _farthest(top)
        best[leaf], found[leaf] = most, place
    met = np.flatnonzero(found[of] >= 0)
    return l_at[met], found[of[met]], best[of[met]] / 1e6


def _farthest(best: np.ndarray) -> np.ndarray:
    """How far apart unit vectors are at most whose rounded cosine, in millionths, is ``best`` or more."""
    # Half a millionth is rounded; the rest is for float rounding.
    return np.sqrt(np.maximum(2 - 2e-6 * (best - 0.6), 0)) + 1e-7


def _keep_best(best: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Put places ``j`` with cosines ``s`` among the best of rows ``i``; the rows that were given any."""
    k = best.shape[1]
    rows, of = np.unique(i, return_inverse=True)
    of = np.r_[np.repeat(np.arange(len(rows)), k), of]
    held, at = np.r_[best[rows].ravel(), s], np.r_[place[rows].ravel(), j]
    order = np.lexsort((at, -held, of))
    count = np.bincount(of)
    first = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
    best[rows], place[rows] = held[first], at[first]
    return rows


def _places(s: np.ndarray, limit: np.float32, most: int) -> np.ndarray | None:
    """Places of the flat matrix from ``limit`` on, if there are no more than ``most``."""
    # Eight places are one number, and few of these are not zero.
    hit = np.zeros(-(-s.size // 8) * 8, bool)
    np.greater_equal(s, limit, out=hit[: s.size].reshape(s.shape))
    if np.count_nonzero(hit) > most:
        return None
    eights = np.flatnonzero(hit.view(np.uint64) != 0)
    i, j = np.nonzero(hit.reshape(-1, 8)[eights])
    return eights[i] * 8 + j


def _least_of_best(left: np.ndarray, right: np.ndarray, k: int, l_id: np.ndarray, r_id: np.ndarray, within: bool) -> np.ndarray:
    """What the k-th best cosine of each row of ``left`` is at least, from some rows of ``right``, in single precision.

    These rows are dealt into k groups, each of which has a cosine as high as its own highest.
    """
    some = np.linspace(0, len(right) - 1, min(len(right), BOUND_ROWS)).astype(np.int64)
    each = len(some) // k
    if not each:
        return np.full(len(left), -np.inf)
    some = some[: each * k]
    least = np.empty(len(left))
    for a in range(0, len(left), BOTH_TILE[0]):
        own = slice(a, a + BOTH_TILE[0])
        s = left[own] @ right[some].T
        if within:
            s[l_id[own, None] == r_id[None, some]] = -np.inf
        least[own] = s.reshape(len(s), k, each).max(axis=2).min(axis=1)
    return least - (left.shape[1] + 8) * 2.0**-24


def _top_both(left: np.ndarray, right: np.ndarray | None, k: int, l_id: np.ndarray, r_id: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_top``, for the rows of ``left`` among ``right`` and for those of ``right`` among ``left``, both sorted by id.

    Without ``right`` the rows of ``left`` meet each other, and there is one result.  Each tile is computed once,
    in single precision; places near neither its row's nor its column's k best so far go no further.  What a row's
    best is at least comes from a few rows first, and rows lie in its order, so that one limit does for a tile.
    """
    within = right is None
    if not len(left) or not within and not len(right):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * (1 if within else 2)
    size = left.shape[1]
    slack = (size + 8) * 2.0**-24 + 1e-6

    def ordered(own: np.ndarray, other: np.ndarray, own_id: np.ndarray, other_id: np.ndarray) -> tuple[np.ndarray, ...]:
        least = _least_of_best(own, other, k, own_id, other_id, within)
        order = np.argsort(-least, kind="stable")
        # The rows' places by id, limits, best cosines in millionths, and their places by id.
        return order, least[order], np.full((len(own), k), -np.inf), np.full((len(own), k), -1)

    left_32 = left.astype(np.float32)
    right_32 = left_32 if within else right.astype(np.float32)
    l_side = ordered(left_32, right_32, l_id, r_id)
    r_side = l_side if within else ordered(right_32, left_32, r_id, l_id)
    right = left if within else right
    (l_order, l_least, *_), (r_order, r_least, *_) = l_side, r_side
    left_32, right_32 = left_32[l_order], right_32[r_order]
    room = np.empty(BOTH_TILE[0] * max(BOTH_TILE), np.float32)

    def keep(side: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        _, least, best, place = side
        near = s >= best[i, -1]
        if near.any():
            rows = _keep_best(best, place, i[near], j[near], s[near])
            least[rows] = np.maximum(least[rows], best[rows, -1] * 1e-6)

    def whole(own: np.ndarray, other: np.ndarray, a_side: tuple[np.ndarray, ...], b_side: tuple[np.ndarray, ...], a: int, b: int, m: int, n: int, a_id: np.ndarray, b_id: np.ndarray) -> None:
        rows, columns = a_side[0][a : a + m], np.sort(b_side[0][b : b + n])
        i, j, s = _whole_tile(own[rows], other[columns], k, a_id[rows], b_id[columns], None)
        keep(a_side, a + i, columns[j], s)

    for a in range(0, len(left), BOTH_TILE[0]):
        m = min(BOTH_TILE[0], len(left) - a)
        b = a if within else 0
        while b < len(right):
            # On the diagonal a square, whose places lie on both sides of it.
            square = within and b == a
            n = m if square else min(BOTH_TILE[1], len(right) - b)
            limit = np.float32(min(l_least[a : a + m].min(), r_least[b : b + n].min()) - slack)
            s = np.matmul(left_32[a : a + m], right_32[b : b + n].T, out=room[: m * n].reshape(m, n))
            rows = np.flatnonzero(s.max(axis=1) >= limit)
            if len(rows):
                hit = _places(s if len(rows) == m else s[rows], limit, m * n // 64)
                if hit is None:
                    whole(left, right, l_side, r_side, a, b, m, n, l_id, r_id)
                    if not square:
                        whole(right, left, r_side, l_side, b, a, n, m, r_id, l_id)
                else:
                    i, j = np.divmod(hit, n)
                    i = rows[i]
                    c = s[i, j]
                    i, j = a + i, b + j
                    near = (c >= l_least[i] - slack) | (c >= r_least[j] - slack)
                    if within:
                        near &= l_id[l_order[i]] != l_id[l_order[j]]
                    if square:
                        near &= i < j
                    i, j = i[near], j[near]
                    at, to = l_order[i], r_order[j]
                    exact = np.rint(np.einsum("ij,ij->i", left[at], right[to]) * 1e6)
                    if len(i):
                        keep(l_side, i, to, exact)
                        keep(r_side, j, at, exact)
            b += n
    out = []
    for order, _, best, place in (l_side,) if within else (l_side, r_side):
        i, j = np.nonzero(best > -np.inf)
        out.append((order[i], place[i, j], best[i, j] / 1e6))
    return out


def _whole_tile(left: np.ndarray, right: np.ndarray, k: int, l_id: np.ndarray, r_id: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of a tile: row, column, cosine in millionths."""
    s = np.rint(left @ right.T * 1e6)
    none = (l_id[:, None] == r_id[None, :]) | ~np.isfinite(s)
    if apart:
        none |= apart[0][:, None] == apart[1][None, :]
    s[none] = -2e6
    width = s.shape[1]
    # Equal cosines go by the column: no two places of a row have one key.
    key = s.astype(np.int64) * -width + np.arange(width)
    columns = np.argpartition(key, k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), s.shape)
    i, j = np.repeat(np.arange(len(s)), columns.shape[1]), columns.ravel()
    met = ~none[i, j]
    i, j = i[met], j[met]
    return i, j, s[i, j]
