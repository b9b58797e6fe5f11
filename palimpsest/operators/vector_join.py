"""All pairs of vectors within an angle, exactly, folded where they are found.

The vectors lie in blocks, sorted so that near ones share a block: by the nearest
of some pivots, and in a block by the nearest of its own. A block is one row of a
table in the shared folder. Every two blocks meet in a task that reads both from
that table, so no vector is shuffled again and none is copied for its partners.
In a block the vectors of one pivot are a cell; two cells are compared unless
their centres are farther apart than both radii and the angle (the triangle
inequality on the sphere), so no pair is dropped.

What is asked for is seldom the pairs: a fold gets the pairs of a block of
vectors piece by piece, from all blocks of a task, and keeps a bounded number of
rows for each vector (a count, a maximum, the best few). ``cosine_join`` lists them.

Defined results: null and zero vectors, NaN entries and null ids have no
partners; an id must occur once; vectors must have one length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.common import checkpoint, partitions_for, release

#: Vectors of a block; vectors of a cell on average; rows of a block's vectors that are compared at once.
BLOCK, CELL, ROWS = 4_000, 64, 256


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Rows:
    """Rows of a table with id and v; those without a vector have zeros."""

    def __init__(self, table: pa.Table):
        self.table, self.id = table, table["id"].combine_chunks()
        v = table["v"].combine_chunks()
        some = np.flatnonzero(pc.is_valid(v).to_numpy(zero_copy_only=False))
        part = _unit(v.take(pa.array(some))) if len(some) else np.zeros((0, 1))
        self.x = part if len(some) == len(v) else np.zeros((len(v), part.shape[1]))
        self.x[some] = part

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()

    def codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists of the column ``codes``: where each begins, its length, all entries; and a mask of 64 bits for each row."""
        if not hasattr(self, "_codes"):
            c = self.table["codes"].combine_chunks()
            size = np.diff(c.offsets.to_numpy())
            flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            mask = np.zeros(len(size), np.uint64)
            np.bitwise_or.at(mask, np.repeat(np.arange(len(size)), size), np.uint64(1) << (flat.view(np.uint64) % np.uint64(64)))
            self._codes = np.cumsum(np.r_[0, size[:-1]]), size, flat, mask
        return self._codes


class Block(Rows):
    """Vectors of one block with their cells; ``table`` has the other columns."""

    def __init__(self, blob: pa.Buffer):
        super().__init__(pa.ipc.open_stream(blob).read_all().combine_chunks())
        cell = self.table["cell"].to_numpy()
        self.start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.size = np.diff(np.r_[self.start, len(cell)])
        centre = np.add.reduceat(self.x, self.start, axis=0)
        self.centre = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)
        near = np.einsum("ij,ij->i", self.x, np.repeat(self.centre, self.size, axis=0))
        # where the centre is no direction its radius is half a turn: nothing is ruled out
        self.radius = np.where(np.linalg.norm(self.centre, axis=1) > 0.5, np.arccos(np.clip(np.minimum.reduceat(near, self.start), -1, 1)), np.pi)
        w = self.table["w"].combine_chunks().take(pa.array(self.start))
        self.w = np.array(w.to_pylist(), object)


def shared_codes(left: Rows, right: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many entries the lists ``codes`` of left's rows i and right's rows j have in common."""
    start, size, flat, mask = left.codes()
    _, size2, flat2, mask2 = right.codes()
    out = np.zeros(len(i), np.int64)
    some = np.flatnonzero(mask[i] & mask2[j])
    if len(some):
        if getattr(right, "_other", None) is not left:
            both, at = np.unique(np.r_[flat, flat2], return_inverse=True)
            right._other, right._at, right._many = left, at[: len(flat)], len(both)
            right._keys = np.sort(np.repeat(np.arange(len(size2)), size2) * len(both) + at[len(flat) :])
        n = size[i[some]]
        pair = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + start[i[some]][pair]
        key = j[some][pair] * right._many + right._at[place]
        at = np.minimum(np.searchsorted(right._keys, key), len(right._keys) - 1)
        out[some] = np.bincount(pair[right._keys[at] == key], minlength=len(some))
    return out


def jaccard(left: Rows, right: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    both = shared_codes(left, right, i, j)
    union = left.codes()[1][i] + right.codes()[1][j] - both
    return np.where(union > 0, both / np.maximum(union, 1), 0.0)


class Best:
    """The ``most`` partners with the highest score of each row of a block; ties go to the smaller id. ``also`` names other columns of a pair."""

    also: tuple[str, ...] = ()

    def __init__(self, left: Rows, most: np.ndarray | int):
        self.left, self.most = left, np.broadcast_to(most, len(left.id))
        self.row, self.score, self.other, self.more = np.array([], np.int64), np.array([]), np.array([], object), [np.array([]) for _ in self.also]
        self.bar = np.full(len(left.id), -np.inf)

    def add(self, right: Rows, i: np.ndarray, j: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        keep = np.flatnonzero(score >= self.bar[i])
        if not len(keep):
            return
        i, j, score = i[keep], j[keep], score[keep]
        if not hasattr(right, "_place"):
            right._ids = np.array(right.id.to_pylist(), object)
            right._place = np.unique(right._ids, return_inverse=True)[1]
        at = self._first(i, score, right._place[j])
        self.row, self.score, self.other = np.r_[self.row, i[at]], np.r_[self.score, score[at]], np.r_[self.other, right._ids[j[at]]]
        self.more = [np.r_[m, x[keep][at]] for m, x in zip(self.more, more)]
        if len(self.row) > 4 * self.most.sum() + 10_000:
            self._cut()

    def _first(self, row: np.ndarray, score: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Places of the best of each row; a row that has enough raises its bar."""
        at = np.lexsort((order, -score, row))
        r = row[at]
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        rank = np.arange(len(r)) - np.repeat(head, np.diff(np.r_[head, len(r)]))
        last = rank == self.most[r] - 1
        self.bar[r[last]] = np.maximum(self.bar[r[last]], score[at][last])
        return at[rank < self.most[r]]

    def _cut(self) -> None:
        at = self._first(self.row, self.score, np.unique(self.other, return_inverse=True)[1])
        self.row, self.score, self.other, self.more = self.row[at], self.score[at], self.other[at], [m[at] for m in self.more]

    def result(self) -> pa.RecordBatch:
        if len(self.row):
            self._cut()
        return pa.RecordBatch.from_arrays([self.left.id.take(pa.array(self.row)), pa.array(self.other, pa.string()), pa.array(self.score), *map(pa.array, self.more)], ["id", "other", "score", *self.also])


def blocks(vectors: DataFrame, *, pivots: int = 256, block: int | None = None, within: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame | None:
    """(k, low, high, blob): ``vectors`` (id, v, the columns ``within`` that pairs share, and ``extra``) in blocks of near ones; None if there are less than two."""
    spark, block = vectors.sparkSession, block or BLOCK
    ok = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    shared = F.to_json(F.array(*[F.col(c).cast("string") for c in within])) if within else F.lit("")
    x = checkpoint(vectors.filter(ok & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<float>").alias("v"), shared.alias("w"), *extra))
    total = x.count()
    if total < 2:
        return None
    many = max(1, min(pivots, math.isqrt(total)))
    chosen = x.orderBy(F.xxhash64("id"), "id").limit(many).select("v").toArrow()
    centre = spark.sparkContext.broadcast(_unit(chosen.column(0).combine_chunks()))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = (_unit(batch.column("v")) @ centre.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], [*batch.schema.names, "home"])

    def pack(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        w = part["w"].combine_chunks()
        v = _unit(part["v"].combine_chunks())
        own = v[np.random.default_rng(0).permutation(len(v))[: max(1, len(v) // CELL)]]
        code = np.unique(np.array(w.to_pylist()), return_inverse=True)[1]
        cell = code * len(own) + (v @ own.T).argmax(1)
        order = np.argsort(cell, kind="stable")
        out = part.drop_columns(["home"]).append_column("cell", pa.array(cell)).take(pa.array(order)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema) as writer:
            writer.write_table(out)
        ws = w.to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([min(ws)]), pa.array([max(ws)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["low", "high", "blob"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                held.append(batch.slice(lo, block))
                n += held[-1].num_rows
                while n >= block:
                    t = pa.Table.from_batches(held)
                    yield pack(t.slice(0, block))
                    held, n = t.slice(block).to_batches(), n - block
        if n:
            yield pack(pa.Table.from_batches(held))

    kinds = ", ".join(f"{c} {t}" for c, t in x.dtypes)
    placed = x.mapInArrow(homes, f"{kinds}, home int").repartitionByRange(partitions_for(total, 4 * block, 1), "w", "home", F.xxhash64("id")).sortWithinPartitions("w", "home")
    out = checkpoint(placed.mapInArrow(packs, "low string, high string, blob binary").withColumn("k", F.monotonically_increasing_id()))
    release(x)
    return out


def fold_pairs(packed: DataFrame, least: float, fold: Callable[[Block], object], schema: str, once: bool = False, back: bool = False) -> DataFrame:
    """What the folds give: fold(block) has add(other block, i, j, cosine) and result(), either of which may return a batch of ``schema``.

    It gets all ordered pairs of different vectors from ``least`` on. With
    ``back`` two blocks meet once and both are folded, which saves half of the
    comparisons at the price of a result for each meeting; with ``once`` each
    pair is given once. A block's fold ends with its task, so there are some
    rows for each vector, to be folded again.
    """
    reach = math.acos(max(-1.0, min(1.0, least))) + 1e-6

    def meet(left: Block, right: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        apart = np.arccos(np.clip(left.centre @ right.centre.T, -1, 1)) - left.radius[:, None] - right.radius[None, :]
        may = (apart <= reach) & (left.w[:, None] == right.w[None, :])
        one = bool((left.w == right.w[0]).all() and (right.w == left.w[0]).all())
        # cells that lie together are compared at once, up to ROWS vectors
        part = (left.start + left.size - 1) // ROWS
        for p in np.unique(part):
            cells = np.flatnonzero(part == p)
            for group in [cells] if one else [cells[left.w[cells] == w] for w in dict.fromkeys(left.w[cells])]:
                to = np.flatnonzero(may[group].any(0))
                if not len(to):
                    continue
                many = int(right.size[to].sum())
                whole = one and 2 * many > len(right.id)
                cols = None if whole else np.repeat(right.start[to] - np.r_[0, np.cumsum(right.size[to])[:-1]], right.size[to]) + np.arange(many)
                y = (right.x if whole else right.x[cols]).T
                for c in np.split(group, np.flatnonzero(np.diff(group) > 1) + 1):
                    first, end = left.start[c[0]], left.start[c[-1]] + left.size[c[-1]]
                    for lo in range(first, end, ROWS):
                        sim = (left.x[lo : min(lo + ROWS, end)] @ y).ravel()
                        at = np.flatnonzero(sim >= least)
                        if not len(at):
                            continue
                        i, j = np.divmod(at, y.shape[1])
                        cos, i, j = sim[at], i + lo, j if whole else cols[j]
                        if same:
                            keep = i < j if once else i != j
                            cos, i, j = cos[keep], i[keep], j[keep]
                        if len(i):
                            yield i, j, cos

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, state = None, None, None
        for batch in batches:
            for k, a, k2, b in zip(*(batch.column(c) for c in ("k", "blob", "k2", "blob2"))):
                if k.as_py() != key:
                    if state is not None and (out := state.result()) is not None:
                        yield out
                    key, left = k.as_py(), Block(a.as_buffer())
                    state = fold(left)
                same = k2.as_py() == key
                right = left if same else Block(b.as_buffer())
                other = fold(right) if back and not same else None
                for i, j, cos in meet(left, right, same):
                    out = state.add(right, i, j, cos)
                    if out is not None:
                        yield out
                    if other is not None:
                        other.add(left, j, i, cos)
                if other is not None and (out := other.result()) is not None:
                    yield out
        if state is not None and (out := state.result()) is not None:
            yield out

    other = packed.select(*[F.col(c).alias(c + "2") for c in packed.columns])
    overlap = (F.col("low") <= F.col("high2")) & (F.col("low2") <= F.col("high"))
    both = packed.hint("shuffle_replicate_nl").join(other, overlap & (F.col("k") <= F.col("k2")) if once or back else overlap)
    # a row is two blocks, so a batch holds a few
    return checkpoint(both.select("k", "blob", "k2", "blob2").mapInArrow(run, schema), spark__sql__execution__arrow__maxRecordsPerBatch="8")


def cosine_join(vectors: DataFrame, least: float, *, pivots: int = 256, block: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, cosine): pairs of ids of ``vectors`` (id, v, and the columns ``within`` that pairs share) with a < b and at least that cosine."""
    packed = blocks(vectors, pivots=pivots, block=block, within=within)
    if packed is None:
        return vectors.sparkSession.createDataFrame([], "a string, b string, cosine double")

    class Listed:
        def __init__(self, left: Block):
            self.left = left

        def add(self, right: Block, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
            x, y = self.left.id.take(pa.array(i)), right.id.take(pa.array(j))
            first = pc.less(x, y)
            return pa.RecordBatch.from_arrays([pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(cos)], ["a", "b", "cosine"])

        def result(self) -> None:
            return None

    return fold_pairs(packed, least, Listed, "a string, b string, cosine double", once=True)
